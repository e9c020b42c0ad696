"""Benchmark decontamination by MinHash containment search.

Question: which test items stand, by ``threshold`` or more of their word
shingles, inside which documents, however long the document is?

* The sketch of an item is its bottom-k MinHash: the k smallest hashes of its n
  shingles, with k, per item, one more than the shingles that a contained item
  may lack, ``floor((1 - threshold) * n) + 1``.  A document
  that contains the item holds at least one hash of the sketch (pigeonhole),
  so the search has no misses, whatever the document's length.
* A document's shingle hashes are looked up among the sketch hashes.  Those
  above the largest hash of any sketch are filtered out before the join.
* Candidates (document, item) that are too short for the item are pruned by
  size; the others are verified by exact containment of the shingle strings.

Everything is DataFrame functions.  Shingles are ``size`` lower-case words of
letters and digits; a text with fewer words is one shingle, one without words has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import small_side, stored


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(words: Column, size: int) -> Column:
    """Structs of ``size`` neighbouring words; the words themselves are shifted as whole arrays, since a
    slice inside a lambda would copy the array for every window."""
    n = F.greatest(F.size(words) - size + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(size)])


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of every window; of all words if there are fewer; none without words."""
    return (F.when(F.size(words) >= size, F.transform(_windows(words, size), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(size)])))
            .when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>")))


def shingle_texts(words: Column, size: int) -> Column:
    """The same windows as strings."""
    return (F.when(F.size(words) >= size, F.transform(_windows(words, size), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(size)])))
            .when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def sketches(items: DataFrame, item_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(item, n, h): the bottom-k MinHash of every item with a word; n counts its distinct shingles."""
    w = items.select(F.col(item_col).alias("item"), plain_words(F.col(text_col)).alias("w")).distinct()
    h = w.select("item", F.explode(F.array(F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), size))))).alias("hs"))
    h = h.select("item", "hs", F.size("hs").alias("n")).where("n > 0")
    k = F.floor((1 - threshold) * F.col("n") + 1e-9).cast("int") + 1
    return h.select("item", "n", F.explode(F.slice("hs", 1, k)).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8,
                    broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, item, n_shingles, n_shared): the items contained in each document, shares verified exactly.

    ``n_shared / n_shingles >= threshold`` over distinct shingles.  Null and
    empty texts contain nothing and are contained in nothing; rows with a null
    id or item are matched to nothing; repeated rows count once.  Other columns
    are ignored.  The sketch table is broadcast only if it has at most
    ``broadcast_rows`` rows (16 bytes each), else joined by shuffle."""
    sketch = stored(sketches(items, item_col, item_text, size, threshold).where("item IS NOT NULL"))
    bound = sketch.agg(F.max("h").alias("top"), F.min("n").alias("least")).first()
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out_names = [F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_shared"]
    if bound["top"] is None:
        kind = items.schema[item_col].dataType
        return source.where("false").select("id", F.lit(None).cast(kind).alias("item"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared")).select(*out_names)
    # 1. search: shingle hashes of whole documents that can be in a sketch
    w = source.select("id", plain_words(F.col("text")).alias("w"))
    low = F.filter(shingle_hashes(F.col("w"), size), lambda h: h <= bound["top"])
    hits = w.select("id", F.size("w").alias("n_words"), F.explode(low).alias("h"))
    longest_first = F.greatest(F.col("n_words") - size + 1, F.lit(1))
    pairs = stored(hits.join(small_side(sketch, broadcast_rows), "h").where(longest_first >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
                   .select("id", "item").distinct())
    # 2. verification by the shingle strings of the candidates only
    texts = source.join(small_side(pairs.select("id").distinct(), broadcast_rows), "id", "left_semi")
    in_doc = texts.select("id", plain_words(F.col("text")).alias("w")).select(
        "id", F.array_distinct(shingle_texts(F.col("w"), size)).alias("have"))
    in_item = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), plain_words(F.col(item_text)).alias("w")).distinct().select(
        "item", F.array_distinct(shingle_texts(F.col("w"), size)).alias("want"))
    both = in_doc.join(pairs, "id").join(in_item, "item").select(
        "id", "item", F.size("want").alias("n_shingles"), F.size(F.array_intersect("have", "want")).alias("n_shared"))
    sure = both.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
    return sure.groupBy("id", "item").agg(F.max(F.struct("n_shared", "n_shingles")).alias("s")).select(
        "id", "item", F.col("s.n_shingles").alias("n_shingles"), F.col("s.n_shared").alias("n_shared")).select(*out_names)


def clean_documents(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """Documents that contain no item.

    Rows are matched by id and a hash of the text, so null ids are treated like
    any other and repeated ids with other texts keep apart."""
    id_col, text_col = settings.pop("id_col", "doc_id"), settings.get("text_col", "text")
    key = F.to_json(F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h")))
    keyed = docs.withColumn("__key", key)
    found = stored(contained_items(keyed, items, id_col="__key", **settings).select("__key").distinct())
    return keyed.join(small_side(found, 1_000_000), "__key", "left_anti").select(*docs.columns)


#: The same in SQL, over views ``documents`` and ``benchmark``.
CONTAINED_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
     i AS (SELECT DISTINCT item_id AS item, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM benchmark WHERE item_id IS NOT NULL),
     ds AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) > 0),
     si AS (SELECT DISTINCT item, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) > 0),
     n AS (SELECT item, count(*) AS n FROM si GROUP BY item)
SELECT ds.id AS doc_id, si.item AS item_id, CAST(n.n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared
FROM ds JOIN si ON ds.s = si.s JOIN n ON n.item = si.item
GROUP BY ds.id, si.item, n.n HAVING count(*) * 10 >= 8 * n.n
"""
