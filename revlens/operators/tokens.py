"""Token jobs: tagging and lemmas by lexicon join, question filter, stop
words, vocabularies, encoding, sub-word decoding and scored n-grams
(D7-D12, D15-D20, D23).

Token tables stay exploded (``review_id, s_idx, t_idx, token``) between
steps; lists are rebuilt only per sentence or per review, never per key.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.ranking import dense_index

# fixed values: punctuation tokens and verbal POS tags of the question test
PUNCT_WORDS = [".", ",", "!", "?"]
VERBAL = ["VERB", "INFN"]
# fixed values: POS tags whose words become stop words
STOP_POS = ["PNCT", "PREP", "INTJ", "CONJ", "NPRO"]
SUFFIX = "</w>"


def explode_sentence_tokens(df: DataFrame, col: str = "review_translate_sentences_tokens",
                            keep: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """Nested token lists -> one row per token with sentence and token index.

    The nested lists are flattened to (s_idx, t_idx, token) structs inside
    the row and exploded once (``inline``); two chained ``posexplode``
    generators measured about 5x slower."""
    flat = F.flatten(F.transform(col, lambda toks, si: F.transform(
        toks, lambda tk, ti: F.struct(si.alias("s_idx"), ti.alias("t_idx"), tk.alias("token")))))
    return df.select(*keep, F.inline(flat))


def tag_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """POS tag and lemma per token by a left join on the lower-cased
    word; unknown words get a null tag and their lower-cased form as lemma.
    The lexicon is a table; the planner (AQE) broadcasts it when small."""
    lx = lexicon.select(F.col("word").alias("_w"), F.col("pos").alias("tag"), F.col("lemma").alias("_lemma"))
    t = tokens.withColumn("_w", F.lower("token")).join(lx, "_w", "left")
    return t.withColumn("lemma", F.coalesce(F.col("_lemma"), F.col("_w"))).drop("_w", "_lemma")


def regroup_sentences(tagged: DataFrame, keep: tuple[str, ...] = ("review_id",),
                      fields: tuple[str, ...] = ("token", "tag", "lemma")) -> DataFrame:
    """Exploded tokens -> one row per sentence with ordered arrays (bounded by the sentence)."""
    g = tagged.groupBy(*keep, "s_idx").agg(F.array_sort(F.collect_list(F.struct("t_idx", *fields))).alias("_s"))
    return g.select(*keep, "s_idx", *[F.transform("_s", _field(f)).alias(f + "s") for f in fields])


def _field(name: str):
    return lambda x: x[name]


def is_question(words: Column, tags: Column) -> Column:
    """Question test of one sentence from its words and tags.

    Tags of punctuation words are dropped; a sentence ending in ``?`` is a
    question when its last tag is verbal, or a gerund after a verbal tag, or
    it starts with a particle and ends verbal, or only one tag is left.
    An empty sentence is not a question."""
    z = F.filter(F.arrays_zip(words.alias("w"), tags.alias("t")), lambda x: ~x["w"].isin(*PUNCT_WORDS))
    tf = F.transform(z, lambda x: x["t"])
    n = F.size(tf)
    last, prev, first = (F.try_element_at(tf, F.lit(-1)), F.try_element_at(tf, F.lit(-2)),
                         F.try_element_at(tf, F.lit(1)))
    ends_q = F.coalesce(F.try_element_at(words, F.lit(-1)) == "?", F.lit(False))
    verbal_end = (F.coalesce(last.isin(*VERBAL), F.lit(False)) |
                  (F.coalesce(last == "GRND", F.lit(False)) & F.coalesce(prev.isin(*VERBAL), F.lit(False))))
    particle = F.coalesce(first == "PRCL", F.lit(False)) & F.coalesce(last.isin(*VERBAL), F.lit(False))
    return (F.when(F.size(words) == 0, F.lit(False))
            .when(ends_q & (n > 1), verbal_end | particle)
            .when(ends_q & (n == 1), F.lit(True))
            .otherwise(F.lit(False)))


def drop_all_questions(df: DataFrame, col: str = "is_question") -> DataFrame:
    """Drop reviews whose sentences are all questions (``all([])`` is true)."""
    return df.filter(~F.forall(col, lambda x: x))


def pos_stop_words(tagged: DataFrame, tags=STOP_POS) -> DataFrame:
    """Distinct lower-cased words carrying one of the stop tags."""
    return tagged.filter(F.col("tag").isin(*tags)).select(F.lower("token").alias("word")).distinct()


def static_stop_words(words: list[str]) -> list[str]:
    """A supplied list plus ASCII punctuation; apostrophes removed from
    items of two or more characters."""
    items = list(words) + list(string.punctuation)
    return [w if len(w) < 2 else w.replace("'", "") for w in items]


def remove_stop_words(tokens: Column, stop: list[str]) -> Column:
    """Stop words removed, order and repeats of the other tokens kept."""
    sw = F.array(*[F.lit(w) for w in sorted(set(stop))])
    return F.filter(tokens, lambda x: ~F.array_contains(sw, x))


def word_vocabulary(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Distinct tokens -> ids 1.. in token order (0 is padding);
    the id assignment is a distributed dense index, not a single-task window."""
    d = tokens.select(F.col(col).alias("token")).distinct()
    return dense_index(d, ["token"], name="token_id").withColumn("token_id", F.col("token_id") + 1)


def encode(tokens: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ("review_id",),
           pos: str = "pos") -> DataFrame:
    """Exploded tokens -> join vocabulary -> ids in position order per row."""
    j = tokens.join(vocab, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(0)))
    g = j.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(pos, "token_id"))).alias("_s"))
    return g.select(*keep, F.transform("_s", lambda x: x["token_id"].cast("int")).alias("ids"))


def decode_groups(sub: DataFrame, keep: tuple[str, ...] = ("review_id",), pos: str = "pos",
                  token: str = "token", suffix: str = SUFFIX) -> DataFrame:
    """Sub-word tokens -> word group id = number of word-final tokens
    (ending in ``suffix``) before the position."""
    w = Window.partitionBy(*keep).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col(token).endswith(suffix).cast("int")
    return sub.withColumn("group", F.coalesce(F.sum(ends).over(w), F.lit(0)).cast("int"))


def word_scores(sub: DataFrame, keep: tuple[str, ...] = ("review_id",), pos: str = "pos",
                token: str = "token", score: str = "score", suffix: str = SUFFIX, lists: bool = False) -> DataFrame:
    """Drop padding ids, merge sub-words into words (D15), sum their
    scores, strip the end-of-word suffix (only the suffix, see SURVEY 1.4.11).

    ``lists``: one row a text, with its words' tokens and scores as arrays in order."""
    total = sub.agg(F.sum(score).alias("score")).schema["score"].dataType.simpleString()
    g = decode_groups(sub, keep, pos, token, suffix).select(*keep, "group", pos, token, F.col(score).cast(total).alias("score"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in g.select(*keep).schema.fields)
    # the rows stand in this order already: nothing is sorted again
    ordered = g.sortWithinPartitions(*keep, pos)
    if lists:
        return ordered.mapInArrow(_text_words(len(keep), suffix), f"{kinds}, token array<string>, score array<{total}>")
    return ordered.mapInArrow(_joined_words(len(keep), suffix), f"{kinds}, pos int, token string, score {total}")


def _text_words(n_keys: int, suffix: str):
    """mapInArrow body: as ``_joined_words``, the words of a text in one row."""
    def run(batches):
        left = None
        for b in _joined_words(n_keys, suffix)(batches):
            t = pa.Table.from_batches([b])
            t = (t if left is None else pa.concat_tables([left, t])).combine_chunks()
            starts = np.append(0, np.flatnonzero(~np.logical_and.reduce([_same(t[i]) for i in range(n_keys)])) + 1)
            if len(starts) > 1:
                yield lists(t, starts)
            left = t.slice(starts[-1])
        if left is not None:
            yield lists(left.combine_chunks(), np.array([0, len(left)]))

    def lists(t, ends):
        keys = [c.chunk(0) for c in t.take(pa.array(ends[:-1])).combine_chunks().columns[:n_keys]]
        return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t[c].chunk(0)) for c in ("token", "score"))],
                                          names=[*t.column_names[:n_keys], "token", "score"])
    return run


def _same(column) -> np.ndarray:
    """Whether each value of a column but the first equals the one before it (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), both).combine_chunks(), bool)


def _joined_words(n_keys: int, suffix: str):
    """mapInArrow body: rows (keys, group, pos, token, score) in order -> one row a group, with its pieces joined without the suffix behind and scores summed.

    Whatever the length of a text, a task holds a batch and the group that goes on in the next one."""
    def joined(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        ends = np.append(starts, len(t))
        if (np.delete(_same(t["pos"]), starts[1:] - 1)).any():  # equal places: by piece
            t = t.append_column("of", pa.array(np.repeat(np.arange(len(starts)), np.diff(ends))))
            t = t.sort_by([("of", "ascending"), ("pos", "ascending"), ("token", "ascending")]).drop_columns("of").combine_chunks()
        token, score = (t[c].chunk(0) for c in ("token", "score"))
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.fill_null(token, "")), "")
        words = pc.if_else(pc.ends_with(words, suffix), pc.utf8_slice_codeunits(words, 0, -len(suffix)), words)
        there = np.add.reduceat(np.asarray(score.is_valid(), np.int64), starts)
        sums = np.add.reduceat(np.asarray(pc.fill_null(score, 0)), starts)
        first = t.take(pa.array(starts))
        keys = [c.chunk(0) for c in first.columns[:n_keys + 1]]
        return pa.RecordBatch.from_arrays([*keys, words, pa.array(sums, score.type, mask=there == 0)],
                                          names=[*t.column_names[:n_keys], "pos", "token", "score"])

    def run(batches):
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            names = [*b.schema.names[:n_keys], "group", "pos", "token", "score"]
            t = pa.Table.from_batches([b]).rename_columns(names)
            t = t if left is None else pa.concat_tables([left, t])
            starts = np.flatnonzero(~np.logical_and.reduce([_same(t[i]) for i in range(n_keys + 1)])) + 1
            starts = np.append(0, starts)
            if len(starts) > 1:
                yield joined(t.slice(0, starts[-1]), starts[:-1])
            left = t.slice(starts[-1])
        if left is not None:
            yield joined(left, np.array([0]))
    return run


def scored_ngrams(words: DataFrame, n: int, agg: str = "mean", keep: tuple[str, ...] = ("review_id",),
                  pos: str = "pos") -> DataFrame:
    """Windows of ``n`` consecutive (token, score) -> phrase text and
    mean or sum score.  Tokens are regrouped once per row key (bounded by
    one text) and the windows are built inside the row, so the shuffle
    carries each token once instead of ``n`` times."""
    g = words.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(pos, "token", "score"))).alias("_w"))
    return g.select(*keep, F.inline(ngram_structs(F.col("_w"), n, agg, pos)))


def ngram_structs(w: Column, n: int, agg: str = "mean", pos: str = "pos") -> Column:
    """In-row n-grams of an ordered array of (pos, token, score) structs."""
    def one(i):
        win = F.slice(w, i + 1, n)
        total = F.aggregate(win, F.lit(0.0), lambda a, x: a + x["score"])
        return F.struct(F.element_at(win, 1)[pos].alias(pos),
                        F.array_join(F.transform(win, lambda x: x["token"]), " ").alias("phrase"),
                        (total / n if agg == "mean" else total).alias("score"))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one))


def exploded_ngrams(rows: DataFrame, tokens: Column, score, n: int, agg: str = "mean", pos: str = "pos") -> DataFrame:
    """The n-grams of ``ngram_structs`` (pos, phrase, score) next to the columns of ``rows``, one row each.

    ``tokens``: the row's token array; ``score(i)``: the score of token i.  A window is cut after its place was exploded,
    in generated code: nothing is evaluated per array element."""
    t, i = F.col("__tokens"), F.col(pos)
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n))
    cut = rows.withColumn("__tokens", tokens).withColumn(pos, F.explode(starts))
    total = reduce(lambda a, k: a + score(i + k), range(n), F.lit(0.0))
    return cut.select(*rows.columns, pos, F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]).alias("phrase"),
                      (total / n if agg == "mean" else total).alias("score"))


def gather_vectors(vocab: DataFrame, primary: DataFrame, backup: DataFrame | None, dim: int,
                   key: str = "token_id") -> DataFrame:
    """Vocabulary left join word vectors, then a second source; still
    missing -> zeros.  ``missed`` marks rows found in neither source."""
    v = vocab.join(primary.select(key, F.col("vector").alias("_v1")), key, "left")
    if backup is not None:
        v = v.join(backup.select(key, F.col("vector").alias("_v2")), key, "left")
    else:
        v = v.withColumn("_v2", F.lit(None).cast("array<float>"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return v.select(*vocab.columns, F.coalesce("_v1", "_v2", zeros).alias("vector"),
                    (F.col("_v1").isNull() & F.col("_v2").isNull()).alias("missed"))
