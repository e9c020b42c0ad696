"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Measures of every whole text are taken once.  For every language and source a
quantile sketch of each measure is kept: a histogram over buckets that are
exact below 64 and have 32 steps per doubling above (3 % relative error).
Sketches merge by adding counts, in any order, with the same result.  From
the quantiles of its own group a document gets its thresholds:

    upper = q75 + spread * max(q75 - q50, floor),  lower = q25 - spread * max(q50 - q25, floor)

so a cutoff follows what is usual in that language and source, up to a
quarter of odd documents does not move it, and a group of usual documents
loses none to a fixed share.  A group's sketch is merged with its language's,
scaled to the weight of ``prior`` rows, and that one likewise with the sketch of
all rows: a group of few rows leans on its language, a large one on itself, and
nothing switches at any size.  The weighted counts are whole numbers, so the merge is exact.
The thresholds are then joined to the measures by language and source.

Everything is DataFrame functions; all counts are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revlens.llm.common import SPACE_CHARS, small_side, stored, words

#: Measure -> (numerator, denominator, scale, floor of the spread, whether a lower cutoff holds too).
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbols": ("n_symbols", "n_words", 1000, 40, False),
    "capitals": ("n_capitals", "word_chars", 1000, 50, False),
    "marks": ("n_marks", "n_words", 1000, 60, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 60, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 60, False),
    "sameness": ("n_same_words", "n_words", 1000, 60, False),
}
SYMBOLS, MARKS = "#*$%&|<>", "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a generator, so that it is computed once per row however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are none of ``characters``."""
    return F.length(F.translate(text, characters, ""))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more (long)."""
    text = F.col("text")
    d = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                  F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = step(d, "w", words(text))
    d = step(d, "lines", F.filter(F.split("text", "\n"), lambda x: without(x, SPACE_CHARS) > 0))
    d = d.select("doc_id", "lang", "source", "w", F.size("w").alias("n_words"), without(text, SPACE_CHARS).alias("word_chars"),
                 (F.length("text") - without(text, SYMBOLS)).alias("n_symbols"), (F.length("text") - without(text, MARKS)).alias("n_marks"),
                 (F.length("text") - without(text, CAPITALS)).alias("n_capitals"), F.size("lines").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    same = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: a == b)
    d = d.withColumn("n_same_words", F.size(F.filter(same, lambda x: x)))
    # words in windows that the text holds twice: equal hashes stand side by side after a sort
    # (whole arrays are shifted, since a slice inside a lambda would copy the array for every window)
    m = F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0))
    windows = F.arrays_zip(*[F.slice("w", k + 1, m).alias(f"w{k}") for k in range(WINDOW)])
    part = lambda x: [x[f"w{k}"] for k in range(WINDOW)]
    d = step(d, "hashes", F.transform(windows, lambda x: F.xxhash64(*part(x))))
    twice = F.size("hashes") > F.size(F.array_distinct("hashes"))  # texts without a repeated window need no more
    other = F.transform(windows, lambda x: F.hash(*part(x)))  # equal windows agree on 96 bits of two hashes
    both = F.zip_with("hashes", other, lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    d = step(d, "sorted", F.when(twice, F.sort_array(F.transform(both, lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), (i + 1).alias("i")))))
             .otherwise(F.array().cast("array<struct<h:bigint,g:int,i:int>>")))
    at = lambda k: F.element_at("sorted", k)
    equal = lambda a, b: (at(a)["h"] == at(b)["h"]) & (at(a)["g"] == at(b)["g"])
    n = F.size("sorted")
    repeated = F.filter(F.sequence(F.lit(1), n), lambda k: F.when(k > 1, equal(k, k - 1)).otherwise(False) | F.when(k < n, equal(k, k + 1)).otherwise(False))
    d = step(d, "starts", F.when(n > 0, F.sort_array(F.transform(repeated, lambda k: at(k)["i"]))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
        (i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n")), lambda a: a["n"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks", "n_capitals", "n_lines", "n_same_words"]
    return d.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in counts], covered.cast("long").alias("n_repeat_words"))


def values() -> list[Column]:
    """The measures as integers; zero where the denominator is."""
    return [F.when(F.col(b) > 0, F.floor(F.col(a) * scale / F.col(b))).otherwise(0).cast("long").alias(name)
            for name, (a, b, scale, _, _) in MEASURES.items()]


def leaning(own: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], prior: int) -> DataFrame:
    """Sketch ``own`` (keys, measure, bucket, n) with the parent's sketch added at the weight of ``prior`` rows.

    All counts are multiplied by the parent's total, so that its share of each bucket stays a whole number."""
    n = F.col("n").cast("decimal(38,0)")
    total = parent.groupBy(*parent_keys, "measure").agg(F.sum(n).alias("total"))
    up = own.join(total, [*parent_keys, "measure"]).select(*keys, "measure", "bucket", (n * F.col("total")).cast("decimal(38,0)").alias("n"))
    groups = own.select(*keys, "measure").distinct()
    lean = groups.join(parent, [*parent_keys, "measure"]).select(*keys, "measure", "bucket", (n * F.lit(prior).cast("decimal(10,0)")).cast("decimal(38,0)").alias("n"))
    return up.unionByName(lean).groupBy(*keys, "measure", "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def thresholds(measured: DataFrame, prior: int, spread: int) -> DataFrame:
    """One row per language and source: the lower and upper cutoff of every measure."""
    bucket = F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 6, 0)) + 1, greatest(length(bin(v)) - 6, 0)) - 1")
    long = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x"))
    sketch = stored(long.select("lang", "source", "x.*").groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    by = lambda *keys: sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    lang = stored(leaning(by("lang"), ["lang"], by(), [], prior))
    merged = leaning(sketch, ["lang", "source"], lang, ["lang"], prior)
    whole = Window.partitionBy("lang", "source", "measure")
    run = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("total", F.sum("n").over(whole))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    cut = run.groupBy("lang", "source", "measure").agg(q(25).alias("q25"), q(50).alias("q50"), q(75).alias("q75"))
    floor = F.element_at(F.create_map(*[F.lit(x) for m, s in MEASURES.items() for x in (m, s[3])]), F.col("measure"))
    cut = cut.select("lang", "source", "measure", (F.col("q75") + spread * F.greatest(F.col("q75") - F.col("q50"), floor)).alias("upper"),
                     (F.col("q25") - spread * F.greatest(F.col("q50") - F.col("q25"), floor)).alias("lower"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return stored(cut.groupBy("lang", "source").agg(*[pick(m, c) for m in MEASURES for c in ("lower", "upper")]))


def apply_rules(df: DataFrame, prior: int = 500, spread: int = 6, **columns) -> DataFrame:
    """(doc_id, counts, base_failed, kept, failed): one row per row of ``df``.

    ``kept`` is false if the base rule fails or any measure is beyond its
    cutoff; ``failed`` names those measures.  Null and empty texts have no
    words and fail the base rule; null languages and sources are the group
    ''; repeated rows get equal results; other columns are ignored."""
    counted = stored(measures(df, **columns))
    measured = counted.select("*", *values())
    limits = thresholds(measured, prior, spread)
    joined = measured.join(small_side(limits, 100_000), ["lang", "source"], "left")
    beyond = [F.when((F.col(m) > F.col(f"{m}_upper")) | (F.col(m) < F.col(f"{m}_lower") if two else F.lit(False)), F.lit(m)) for m, (*_, two) in MEASURES.items()]
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.concat_ws(",", *beyond)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                         (~base_failed & (failed == "")).alias("kept"), failed.alias("failed"))


def rules_sql(prior: int = 500, spread: int = 6) -> str:
    """DuckDB form of ``apply_rules`` over ``documents``."""
    value = {m: f"CASE WHEN {b} > 0 THEN {a} * {scale} // {b} ELSE 0 END" for m, (a, b, scale, _, _) in MEASURES.items()}
    floor = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s[3]}" for m, s in MEASURES.items()) + " END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM v" for m in MEASURES)
    sides = [(m, c) for m in MEASURES for c in ("lower", "upper")]
    def lean(name, own, keys, parent, on):
        """CTEs: sketch ``own`` with its parent's added at the weight of ``prior`` rows."""
        k = "".join(f"{c}, " for c in keys)
        same = " AND ".join(f"x.{c} = y.{c}" for c in [*on, "measure"])
        xk = "".join(f"x.{c}, " for c in keys)
        p = "".join(f"{c}, " for c in on)
        return f"""
{name} AS (SELECT {k}measure, bucket, sum(n) AS n FROM (
  SELECT {xk}x.measure, x.bucket, x.n::HUGEINT * y.total AS n FROM {own} x JOIN (SELECT {p}measure, sum(n)::HUGEINT AS total FROM {parent} GROUP BY ALL) y ON {same}
  UNION ALL SELECT {xk}x.measure, y.bucket, y.n::HUGEINT * {prior} FROM (SELECT DISTINCT {k}measure FROM {own}) x JOIN {parent} y ON {same}) GROUP BY {k}measure, bucket),"""

    on = "PARTITION BY lang, source, measure"
    levels = f"""
sa AS (SELECT measure, bucket, sum(n) AS n FROM sk GROUP BY measure, bucket),
sl AS (SELECT lang, measure, bucket, sum(n) AS n FROM sk GROUP BY lang, measure, bucket),""" + lean("ml", "sl", ["lang"], "sa", []) + lean("mo", "sk", ["lang", "source"], "ml", ["lang"]) + f"""
lim AS (SELECT lang, source, {', '.join(f"max(CASE WHEN measure = '{m}' THEN {c} END) AS {m}_{c}" for m, c in sides)}
  FROM (SELECT lang, source, measure, q75 + {spread} * greatest(q75 - q50, {floor}) AS upper, q25 - {spread} * greatest(q50 - q25, {floor}) AS lower
        FROM (SELECT lang, source, measure, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS q25,
                     min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS q50, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS q75
              FROM (SELECT *, sum(n) OVER ({on} ORDER BY bucket) AS upto, sum(n) OVER ({on}) AS total FROM mo) GROUP BY lang, source, measure)) GROUP BY lang, source),"""
    beyond = ", ".join(f"CASE WHEN {m} > {m}_upper {f'OR {m} < {m}_lower' if s[4] else ''} THEN '{m}' END" for m, s in MEASURES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT row, unnest(generate_series(1, len(w) - 7)) AS i, unnest(list_transform(generate_series(1, len(w) - 7), lambda k: array_to_string(w[k:k + 7], ' '))) AS s FROM d),
cov AS (SELECT row, count(DISTINCT i + o.o) AS n FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM win), (SELECT unnest(generate_series(0, 7)) AS o) o WHERE c > 1 GROUP BY row),
c AS (SELECT d.row, doc_id, lang, source, len(w) AS n_words, len(list_aggregate(w || [''], 'string_agg', '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[!?]')) AS n_marks, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(list_filter(generate_series(1, len(w) - 1), lambda k: w[k] = w[k + 1])) AS n_same_words, coalesce(cov.n, 0) AS n_repeat_words
      FROM d LEFT JOIN cov ON cov.row = d.row),
v AS (SELECT *, {', '.join(f'{x} AS {m}' for m, x in value.items())} FROM c),
sk AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (((v >> s) + 1) << s) - 1 END AS bucket, count(*) AS n
       FROM (SELECT *, CASE WHEN v < 64 THEN 0 ELSE length(bin(v)) - 6 END AS s FROM ({long})) GROUP BY 1, 2, 3, 4),{levels}
r AS (SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {beyond}) AS failed FROM v JOIN lim ON lim.lang = v.lang AND lim.source = v.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM r
"""
