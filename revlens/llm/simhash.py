"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint (majority of the bits of its shingles'
XXH64).  Fingerprints that differ in at most ``max_bits`` bits are linked;
a component is what links reach.

1. Equal fingerprints collapse to one row by a map-side aggregate, so a
   large group of exact copies is one row from here on.
2. For every distinct fingerprint the Hamming distances to 16 reference
   fingerprints are computed once (the pivot distance table).
3. Buckets: 64 bits in ``max_bits + k`` blocks; two linked fingerprints
   agree on ``k`` whole blocks, so every choice of ``k`` blocks is a table
   and its bits the bucket key.  No link can be missed.  ``k`` is 2 (15 tables)
   up to some 20 million distinct fingerprints and follows their number
   beyond, so that random fellows stay few.
4. Inside a bucket a pair is discarded if any coordinate of the pivot
   tables differs by more than ``max_bits`` (triangle inequality); the
   survivors are verified by the exact distance.  Only a spanning star of
   each bucket's links leaves the task.  Buckets over ``split`` rows are cut
   into chunks and dealt as pairs of chunks, so no task holds more than two.
5. Components of the stars by distributed large-star / small-star rounds.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import byte_list, connected_components, stored

PIVOTS = 16
#: Below this many rows a bucket is compared pair by pair in whole-batch steps.
SMALL = 32


def fingerprint(data: bytes, size: int, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit number; 0 without words."""
    found = data.lower().split()  # bytes: A-Z only, and only ASCII white space splits
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        at = list(accumulate((len(w) + 1 for w in found), initial=0))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b - 1], seed) for a, b in zip(at, at[size:])])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int, key: Column | None = None) -> DataFrame:
    """(id, fp): one row per row of ``df``; fp as a signed long.  ``key`` stands in for the id column."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or b"", size) for t in byte_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    rows = df.select((F.col(id_col) if key is None else key).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def references() -> list[int]:
    """The reference fingerprints: XXH64 of their index, as signed longs."""
    raw = [xxhash.xxh64_intdigest(str(j).encode(), 1) for j in range(PIVOTS)]
    return [x - (1 << 64) if x >> 63 else x for x in raw]


def block_masks(n: int, max_bits: int) -> list[int]:
    """Bit masks of the bucket tables, as signed longs, for ``n`` distinct fingerprints."""
    k = 2
    while k < 4 and n > 8 * 2 ** (64 * k / (max_bits + k)):
        k += 1
    blocks = max_bits + k
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), k)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _near(fp, table, i, j, max_bits):
    """Which of the pairs (i, j) are linked: pivot filter, then the exact distance."""
    ok = (np.abs(table[i].astype(np.int8) - table[j].astype(np.int8)).max(axis=1) <= max_bits).nonzero()[0]
    return ok[np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]) <= max_bits]


def _stars(fp, table, max_bits):
    """Star edges (member, first) of the links among the rows, by a search that
    never looks again at a row it has reached."""
    left, out = np.arange(len(fp)), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            hit = _near(fp, table, left, np.full(len(left), at), max_bits)
            if len(hit):
                found = left[hit]
                left = np.delete(left, hit)
                queue.extend(found)
                out.append(np.stack([found, np.full(len(found), root)]))
    return out


def _bucket_links(max_bits: int):
    """mapInArrow body over rows sorted by bucket: (t, key, c1, c2, fp, d0, d1) -> edges (a, b)."""
    def links(x):
        group, fp = x[:, :4], np.ascontiguousarray(x[:, 4]).view(np.uint64)  # a signed count would be of the absolute value
        table = np.ascontiguousarray(x[:, 5:7]).view(np.uint8).reshape(len(x), -1)
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[new, len(x)])
        out = []
        each = np.repeat(sizes, sizes)  # size of each row's bucket
        rank = np.arange(len(x)) - np.repeat(new, sizes)
        for step in range(1, int(min(SMALL, sizes.max(initial=0)))):
            i = np.flatnonzero((each <= SMALL) & (rank + step < each))
            j = i + step
            ok = _near(fp, table, i, j, max_bits) if len(i) else i
            if len(ok):
                out.append(np.stack([j[ok], i[ok]]))
        for k in np.flatnonzero(sizes > SMALL):
            part = slice(new[k], new[k] + sizes[k])
            out.extend(e + new[k] for e in _stars(fp[part], table[part], max_bits))
        e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[k].view(np.int64)) for k in e], names=["a", "b"])

    def run(batches):
        rest = np.zeros((0, 7), np.int64)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)], axis=1)
            x = np.concatenate([rest, x]) if len(rest) else x
            if not len(x):
                continue
            last = np.flatnonzero((x[:, :4] != x[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            rest = x[cut:]
            if cut:
                yield links(x[:cut])
        if len(rest):
            yield links(rest)

    return run


def link_edges(distinct: DataFrame, n: int, max_bits: int, split: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    refs = references()

    def packed(part):
        return sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * j)
                    for j, p in enumerate(part)), F.lit(0).cast("long"))

    masks = block_masks(n, max_bits)
    table = stored(distinct.select("fp", packed(refs[:8]).alias("d0"), packed(refs[8:]).alias("d1")))

    def keyed(df):
        return df.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                  for t, m in enumerate(masks)])).alias("k")).select("*", "k.*").drop("k")

    large = stored(keyed(table.select("fp")).groupBy("t", "key").count().where(F.col("count") > split)
                   .select("t", "key", F.ceil(F.col("count") / split).cast("int").alias("s")))
    rows = keyed(table).join(small_or_not(large), ["t", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    rows = rows.withColumn("c", chunk).select(
        "t", "key", "fp", "d0", "d1",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("s") - 1),
                              lambda j: F.struct(F.least("c", j).alias("c1"), F.greatest("c", j).alias("c2")))).alias("p"))
    rows = rows.select("t", "key", F.col("p.c1").alias("c1"), F.col("p.c2").alias("c2"), "fp", "d0", "d1")
    return (rows.repartition("t", "key", "c1", "c2").sortWithinPartitions("t", "key", "c1", "c2", "fp")
            .mapInArrow(_bucket_links(max_bits), "a bigint, b bigint"))


def small_or_not(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a table of oversized buckets proved to be short."""
    return F.broadcast(df) if df.count() <= max_rows else df


def component_minima(fps: DataFrame, low: Column, max_bits: int, split: int, salts: int = 16) -> DataFrame:
    """(fp, low): for every fingerprint of ``fps`` the smallest ``low`` of its component.

    A component may hold most fingerprints, so its members are dealt to
    ``salts`` tasks and its one minimum is copied to each."""
    distinct = stored(fps.groupBy("fp").agg(F.min(low).alias("low")))
    parts = connected_components(link_edges(distinct.select("fp"), distinct.count(), max_bits, split))
    linked = stored(distinct.join(parts.withColumnRenamed("node", "fp"), "fp"))
    lows = linked.groupBy("component").agg(F.min("low").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = linked.select("fp", "component", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int").alias("salt")).join(lows, ["component", "salt"])
    alone = distinct.join(linked.select("fp"), "fp", "left_anti")
    return stored(named.select("fp", "low").unionByName(alone.select("fp", "low")))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = 4, split: int = 20_000) -> DataFrame:
    """(id, fingerprint: 16 hex digits, component_id: smallest id reachable), one row per row of ``df``.

    Null and empty texts have fingerprint zero and are linked like any other;
    texts with fewer words than a shingle are one shingle.  Repeated rows get
    equal results.  Null ids are returned and never chosen as component id
    (null only if no member has an id).  Other columns are ignored, an empty
    table gives an empty result."""
    fps = stored(fingerprints(df, id_col, text_col, shingle))
    named = component_minima(fps, F.col("id"), max_bits, split)
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4,
             split: int = 20_000) -> DataFrame:
    """Rows of ``df`` without near-duplicates: one row of each component stays.

    It is the one with the smallest id (null ids last), then with the smallest
    hash of its text; of rows equal in both any one.  Rows that share an id but
    not a component are rows of their own.  Null and empty texts are one component.  All
    columns are returned as they are; an empty table gives an empty result.

    Texts are not shuffled to find the rows that go: a Bloom filter of their
    keys (at most 262,144 words of 64 bits, broadcast) lets all other rows pass where
    they are read, and only its hits meet the keys in a join."""
    key = ["__id", "__h1", "__h2"]
    keyed = df.withColumns({"__id": F.col(id_col), "__h1": F.xxhash64(F.lit(1), text_col), "__h2": F.xxhash64(F.lit(2), text_col)})
    fps = stored(fingerprints(keyed, "__key", text_col, shingle, F.struct(*key))).select("fp", "id.*")
    order = F.struct(F.col("__id").isNull().alias("none"), *key)
    named = component_minima(fps, order, max_bits, split)
    counts = fps.groupBy("fp", *key).count()
    first = F.struct(F.col("low.none"), *[F.col(f"low.{c}") for c in key])
    judged = stored(counts.join(named, "fp").select(*key, (order == first).alias("stays"), "count"))
    gone = judged.where("NOT stays").select(*key)
    bits, words = bloom_filter(judged.where("NOT stays OR count > 1").select(*key), "__h1", "__h2")
    marked = keyed.join(F.broadcast(bits), F.pmod("__h1", F.lit(words)) == F.col("__word"), "left")
    mask = bloom_mask("__h2")
    marked = marked.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False)))
    same = F.lit(True)
    gone = gone.withColumnsRenamed({c: f"{c}_gone" for c in key})
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_gone"))
    hits = marked.where("__maybe").join(gone, same, "left_anti").dropDuplicates(key)
    return marked.where("NOT __maybe").unionByName(hits).select(*df.columns)


def bloom_mask(h: str) -> Column:
    """Four bits of a 64-bit word, chosen by the column of hashes ``h``."""
    one = [F.expr(f"shiftleft(1L, CAST(pmod(shiftrightunsigned({h}, {k}), 64) AS INT))") for k in (0, 6, 12, 18)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2]).bitwiseOR(one[3])


def bloom_filter(keys: DataFrame, h1: str, h2: str, most_words: int = 1 << 18) -> tuple[DataFrame, int]:
    """((__word, __bits), words): a Bloom filter of two columns of 64-bit hashes, one row per word in use.

    A key sets the bits ``bloom_mask(h2)`` of word ``h1 mod words``.  Four keys a word at 16 bits a key, up to
    ``most_words`` words (2 MB); with more keys than that more other rows are taken for keys."""
    n, words = keys.count(), 64
    while words < min(n // 4, most_words):
        words *= 2
    return keys.groupBy(F.pmod(h1, F.lit(words)).alias("__word")).agg(F.bit_or(bloom_mask(h2)).alias("__bits")), words
