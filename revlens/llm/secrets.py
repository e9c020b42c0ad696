"""Secret scans with corpus-wide ownership frequency.

One pass over every whole text finds spans: the base kinds (``assign``,
``access``, ``hex``) and further ones (``pem`` private key blocks,
``vendor`` tokens with a known prefix, and ``echo``, long mixed tokens that
count only if the corpus shows the same value assigned to a secret's name
elsewhere).  Values leave the pass as hashes only.

The hashes are then aggregated over the corpus by distinct repositories and
owners.  A value that many owners hold, or that many repositories hold in the
same surroundings, is a copied example (documentation, tutorials, test keys); a
value that few owners hold, each time in other surroundings, and that looks
random is a live-looking credential, however often its owner uses it.  Exact
copies of a text count as one repository, so a credential does not become an example because
its document was copied.  The aggregates go in steps (per value and owner, or
value, surroundings and text, then per value) with map-side partial sums, so no task gets
all rows of a value that stands in a third of all documents."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import small_side, stored

KINDS = ("assign", "access", "hex", "pem", "vendor", "echo")
BASE = 3  # the first so many kinds are the base ones
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs shorter than the limits are dropped anyway, so they are part of the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
VENDOR = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
VENDOR_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ")
ECHO = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DUMMY = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|x{4,}|1234|(.)\1{5,}", re.I)

SPAN = "struct<kind:tinyint,start:int,end:int,vstart:int,vend:int,value:string,around:string,random:boolean>"
#: Words on either side of a value that count as its surroundings, and characters in which they are looked for.
AROUND, REACH = 2, 64


def looks_random(value: str) -> bool:
    """Whether a value has the entropy of a credential and none of the marks of a placeholder."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0
    return entropy >= 2.5 and any(c.isdigit() for c in value) and not DUMMY.search(value)


def surroundings(text: str, start: int, end: int) -> str:
    """Hash of the words beside a value, white space aside."""
    beside = [*text[max(0, start - REACH):start].split()[-AROUND:], "", *text[end:end + REACH].split()[:AROUND]]
    return hashlib.blake2b(" ".join(beside).encode(), digest_size=8).hexdigest()


def find_spans(text: str) -> list[tuple]:
    """Spans (kind, start, end, value start, value end) of a text, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(3, *m.span(), *m.span()) for m in PEM.finditer(text)]
    if any(mark in text for mark in VENDOR_MARKS):
        found += [(4, *m.span(), *m.span()) for m in VENDOR.finditer(text)]
    taken = {(s[3], s[4]) for s in found}
    for m in ECHO.finditer(text):
        word = m[0]
        if m.span() not in taken and not word.isalpha() and any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            found.append((5, *m.span(), *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def scan(df: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """(row, id, repo, owner, copy, spans), one row per row of ``df``; ``row`` tells repeated ids apart
    and ``copy``, a hash of the text, is equal for exact copies (null without spans)."""
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("vstart", pa.int32()),
                                   ("vend", pa.int32()), ("value", pa.string()), ("around", pa.string()), ("random", pa.bool_())]))
        for b in batches:
            out, copies = [], []
            for text in b.column(3).to_pylist():
                spans = []
                for k, s, e, vs, ve in find_spans(text or ""):
                    value = text[vs:ve]
                    spans.append({"kind": k, "start": s, "end": e, "vstart": vs, "vend": ve, "random": looks_random(value),
                                  "value": hashlib.blake2b(value.encode(), digest_size=16).hexdigest(), "around": surroundings(text, vs, ve)})
                out.append(spans)
                copies.append(hashlib.blake2b(text.encode(), digest_size=16).hexdigest() if spans else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(copies, pa.string()), pa.array(out, kind)],
                                             names=["id", "repo", "owner", "copy", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
                      F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, repo string, owner string, copy string, spans array<{SPAN}>")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def ownership(spans: DataFrame) -> DataFrame:
    """(value, named, n_repos, n_copies, n_owners) of every candidate value of the corpus.

    Exact copies of a text stand for one repository, the first in the alphabet
    of those that hold it; an owner counts whatever it holds.  ``n_copies``: repositories
    that hold the value in the surroundings that most of them share."""
    by_owner = spans.groupBy("value", "owner").agg(F.max((F.col("s.kind") < F.lit(KINDS.index("echo"))).cast("int")).alias("named"))
    owners = by_owner.groupBy("value").agg(F.max("named").alias("named"), F.count(F.lit(1)).alias("n_owners"))
    by_text = spans.groupBy("value", "around", "copy").agg(F.min("repo").alias("repo"))
    copies = by_text.groupBy("value", "around", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("value", "around").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("value").agg(F.max("n").alias("n_copies"))
    repos = (by_text.groupBy("value", "copy").agg(F.min("repo").alias("repo")).groupBy("value", "repo").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("value").agg(F.count(F.lit(1)).alias("n_repos")))
    return owners.join(repos, "value").join(copies, "value").select("value", "named", "n_repos", "n_copies", "n_owners")


def judged_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None,
                 owner_col: str = "source", example_owners: int = 3, example_copies: int = 10) -> tuple[DataFrame, DataFrame]:
    """(scan, spans): the scan of every row, and its spans with the corpus' verdict.

    spans: (row, kind, start, end, vstart, vend, n_repos, n_owners, live).
    A value is an example if ``example_owners`` or more owners hold it, or
    ``example_copies`` or more repositories (exact copies of a text counted
    once) hold it in equal surroundings, or it does not look random; else it is live.  ``repo_col`` defaults to the id:
    a document is a repository of its own.  Null repositories and owners
    count as one each.  ``echo`` spans stay only if their value is named."""
    repo = F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in df.columns else F.lit("")
    found = stored(scan(df, id_col, text_col, repo, owner))
    each = found.where(F.size("spans") > 0).select("row", "repo", "owner", "copy", F.explode("spans").alias("s")).withColumns({"value": F.col("s.value"), "around": F.col("s.around")})
    held = stored(ownership(each))
    live = (F.col("n_owners") < example_owners) & (F.col("n_copies") < example_copies) & F.col("s.random")
    judged = each.join(held, "value").where((F.col("s.kind") < KINDS.index("echo")) | (F.col("named") == 1)).select(
        "row", "s.kind", "s.start", "s.end", "s.vstart", "s.vend", "n_repos", "n_owners", live.alias("live"))
    return found, judged


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def report(df: DataFrame, **settings) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans as text,
    how many are live-looking or examples, and the widest counts of owners and
    repositories of its values.  Null and empty texts have none; repeated rows and
    ids are rows of their own; spans are listed by start, then kind; other columns
    are ignored; an empty table gives an empty result."""
    found, judged = judged_spans(df, **settings)
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.join(per_row, "row", "left").select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        (F.coalesce(F.size("all"), F.lit(0)) - F.coalesce("n_live", F.lit(0))).cast("long").alias("n_example"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **settings) -> DataFrame:
    """``df`` with the values of live-looking credentials replaced by ``mark``; all rows and columns stay.

    Overlapping values are replaced as one; null texts stay null.  Rows are
    matched to their spans by id and a hash of the text, so repeated ids with
    other texts keep apart and null ids are treated like any other."""
    key = F.to_json(F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h")))
    found, judged = judged_spans(df.withColumn("__key", key), "__key", text_col, repo_col=id_col, **settings)
    cuts = judged.where("live").join(found.where(F.size("spans") > 0).select("row", F.col("id").alias("__key")), "row")
    cuts = stored(cuts.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("vstart", "vend"))).alias("__cuts")))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["vstart"] >= a["at"], F.struct(s["vend"].alias("at"), F.concat(
        a["out"], F.substring(text, a["at"] + 1, s["vstart"] - a["at"]), F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["vend"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate("__cuts", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = df.withColumn("__key", key).join(small_side(cuts, 100_000), "__key", "left")
    return out.withColumn(text_col, F.when(F.col("__cuts").isNull(), text).otherwise(done)).select(*df.columns)


def with_length(df: DataFrame, column: str, text_col: str = "text") -> DataFrame:
    """Renew a length column where the table has it, keeping its type."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.when(F.col(text_col).isNull(), F.col(column)).otherwise(F.length(text_col)).cast(df.schema[column].dataType))
