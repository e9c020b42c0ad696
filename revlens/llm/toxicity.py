"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon
learned from the labels, insults near a second person, capitals,
punctuation and obfuscation rates.  Rows are described by a lexicon that
other rows gave, and the isotonic map from the trees' probability to the
score is fitted on rows that the trees have not seen."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import append, held_out, sampled, stored, training_rows

#: Seed lexicon: common insults and threats in four languages.
SEEDS = frozenset("""
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools loser losers scum trash garbage filth filthy
pathetic worthless disgusting clown clowns imbecile cretin dimwit halfwit jerk jerks creep bastard bastards bitch bitches asshole
shit bullshit crap fuck fucking fucker dick prick pig pigs swine vermin parasite parasites coward liar liars ugly hate hateful
useless brainless retard retarded freak degenerate subhuman
idioten trottel dumm dummkopf abschaum arschloch dreck widerlich erbärmlich wertlos versager lügner scheisse scheiße hure schwein
imbécile crétin débile ordure salaud salope connard connasse merde stupide minable dégoûtant perdant bouffon menteur
idiota idiotas imbécil estúpido estúpida basura escoria patético asqueroso payaso perdedor cabrón puta mierda gilipollas inútil
""".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
EDGE = ".,;:!?\"'()[]{}<>#%&$*|…“”«»-_/\\"
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
NOT_LETTER = re.compile(r"[\W\d_]+")
TRIPLE = re.compile(r"(.)\1{2,}")
PREFIXES = (6, 8)  # lengths of word beginnings that the learned lexicon knows besides whole words
NEAR = 5  # words between an insult and a second person
FEATURES = ("seeds", "seeds_log", "learned", "learned_log", "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation", "masked", "mixed", "length")
CAPITALS, MARKS = bytes(range(65, 91)), b".,;:!?\"'()[]{}<>#%&$*|-_/\\~^+="


def unmasked(word: str) -> str:
    """A word with look-alike characters, inner marks and stretched letters undone."""
    return TRIPLE.sub(r"\1", NOT_LETTER.sub("", word.translate(LEET)))


def parts(word: str) -> list[str]:
    """What the learned lexicon may know of a word: itself, and its beginnings marked by ^."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def features(text: str, learned: frozenset) -> list[float]:
    """The dense features of one text; all zero but the length for a text without words."""
    raw = text.split()
    n = max(len(raw), 1)
    words = [w.strip(EDGE) for w in text.lower().split()]
    hits = [i for i, w in enumerate(words) if w in SEEDS]
    known = sum(any(part in learned for part in parts(w)) for w in words) if learned else 0
    you = [i for i, w in enumerate(words) if w in SECOND]
    near = 0
    if hits and you:
        at = np.array(you)
        k = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    masked = mixed = 0
    for w in words:
        if not w.isalpha() and w and w not in SEEDS and not w.isdigit():
            mixed += 1
            masked += unmasked(w) in SEEDS
    data = text.encode()
    size = max(len(data), 1)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = len(data) - len(data.translate(None, MARKS))
    shouted = sum(map(str.isupper, raw))
    return [100 * len(hits) / n, np.log1p(len(hits)), 100 * known / n, np.log1p(known), 100 * near / n, 100 * len(you) / n, capitals / size,
            shouted / n, 100 * data.count(b"!") / n, marks / size, 100 * masked / n, mixed / n, np.log1p(len(raw))]


def with_features(df: DataFrame, text_col: str, learned: frozenset) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(learned)  # at most ``lexicon`` words

    def make(texts):
        rows = [features(t, shared.value) for t in texts]
        flat = pa.array(np.array(rows, np.float64).reshape(-1))
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), flat)]

    return append(df, text_col, "__features array<double>", make)


class ToxicityModel:
    """Learned lexicon, trees and calibration; ``score`` adds ``__score`` to every row."""

    def __init__(self, learned=frozenset(), trees=None, isotonic=None, prior: float = 0.0):
        self.learned, self.trees, self.isotonic, self.prior = learned, trees, isotonic, prior

    def _probability(self, df: DataFrame) -> DataFrame:
        wide = df.select("*", *[F.col("__features")[i].alias(f"__f{i}") for i in range(len(FEATURES))])
        wide = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(FEATURES))], outputCol="__vector").transform(wide)
        out = self.trees.transform(wide).withColumn("__p", vector_to_array("__probability")[1])
        return out.drop("__vector", "__raw", "__probability", "__tree", *[f"__f{i}" for i in range(len(FEATURES))])

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        if self.trees is None:
            return df.withColumn("__score", F.lit(self.prior))
        out = self._probability(with_features(df, text_col, self.learned))
        if self.isotonic is not None:
            out = self.isotonic.transform(out).withColumn("__p", F.col("__calibrated"))
        return out.select(*df.columns, F.least(F.greatest(F.col("__p"), F.lit(0.0)), F.lit(1.0)).alias("__score"))


def learn_lexicons(rows: DataFrame, size: int, least: int = 6, ratio: float = 20.0) -> list[frozenset]:
    """Lexicons of the rows of half 0, of half 1, and of all: words and word beginnings that at least
    ``least`` distinct toxic texts hold and clean ones ``ratio`` times less often; at most ``size`` each,
    those of most toxic texts first."""
    rows = rows.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("label").alias("label"), F.min("half").alias("half"), F.first("text").alias("text"))
    whole = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    known = F.array_distinct(F.flatten(F.transform(whole, lambda w: F.concat(F.array(w), *[
        F.when(F.length(w) > n, F.array(F.concat(F.lit("^"), F.substring(w, 1, n)))).otherwise(F.array().cast("array<string>")) for n in PREFIXES]))))
    of = lambda half, label: ((F.col("half") == half) & (F.col("label") == label)).cast("int")
    cells = [(f"t{h}", h, 1) for h in (0, 1)] + [(f"c{h}", h, 0) for h in (0, 1)]
    n = rows.agg(*[F.sum(of(h, y)).alias(name) for name, h, y in cells]).first()
    counts = rows.select("label", "half", F.explode(known).alias("word")).where("word <> ''").groupBy("word").agg(
        *[F.sum(of(h, y)).alias(name) for name, h, y in cells]).where(F.col("t0") + F.col("t1") >= least)
    counts, out = stored(counts), []
    for toxic, clean in (("t0", "c0"), ("t1", "c1"), ("t0 + t1", "c0 + c1")):
        nt, nc = (sum(n[x] or 0 for x in c.split(" + ")) for c in (toxic, clean))
        if not nt or not nc:
            out.append(frozenset())
            continue
        kept = counts.where(f"{toxic} >= {least if '+' in toxic else (least + 1) // 2} AND ({toxic} + 0.5) / {nt} >= {ratio} * ({clean} + 0.5) / {nc}")
        out.append(frozenset(r["word"] for r in kept.orderBy(F.expr(toxic).desc(), "word").limit(size).collect()))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 40_000,
                 lexicon: int = 20_000, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Fit on the labelled rows outside the held-out fold (crc32(id) mod 3 is 1).

    Word counts cover all of them.  The rows of each half are described by
    the lexicon of the other half; about ``fit_rows`` rows at most fit the trees and the
    isotonic map, 2:1.  New rows are described by the lexicon of both halves.
    With one class only, every score is the share of toxic rows."""
    rows = training_rows(docs, labels, "toxic", id_col, text_col).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)))
    first, second, learned = learn_lexicons(rows, lexicon)
    rest = stored(with_features(rows.where("half = 0"), "text", second).unionByName(with_features(rows.where("half = 1"), "text", first))
                  .select("id", "label", "__features"))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(6))
    fits = part < 4
    # a bounded number of narrow rows in one order, so that equal inputs give equal trees
    data = stored(sampled(rest, fit_rows, "fit").withColumn("label", F.col("label").cast("double"))
                  .repartition(1).sortWithinPartitions("id", "label", "__features"))
    counts = {r["label"]: r["count"] for r in data.where(fits).groupBy("label").count().collect()}
    if len(counts) < 2:
        total = sum(counts.values())
        return ToxicityModel(prior=counts.get(1.0, 0) / total if total else 0.0)
    wide = data.select("*", *[F.col("__features")[i].alias(f"__f{i}") for i in range(len(FEATURES))])
    wide = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(FEATURES))], outputCol="__vector").transform(wide)
    balance = F.when(F.col("label") == 1, counts[0.0] / counts[1.0]).otherwise(1.0)  # rare labels weigh as much as common ones
    wide = wide.withColumn("weight", F.least(balance, F.lit(20.0)))
    model = GBTClassifier(featuresCol="__vector", labelCol="label", weightCol="weight", predictionCol="__tree", maxIter=trees, maxDepth=depth,
                          stepSize=0.3, seed=7).setRawPredictionCol("__raw").setProbabilityCol("__probability")
    fitted = ToxicityModel(learned, model.fit(wide.where(fits)))
    held = fitted._probability(data.where(~fits))
    if held.select("label").distinct().count() == 2:
        fitted.isotonic = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__calibrated").fit(held.select("label", "__p"))
    return fitted


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7, **settings) -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts are scored from their (zero) features; a null id
    counts as the text '' for the fold; repeated rows get equal scores; other
    columns are ignored; an empty table gives an empty result."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_toxicity(narrow, labels, **settings)
    return model.score(narrow).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("__score").alias("score"),
                                      (F.col("__score") >= limit).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7, **settings) -> DataFrame:
    """Rows of ``docs`` with a score below ``limit``; all columns stay."""
    model = fit_toxicity(docs, labels, id_col, text_col, **settings)
    return model.score(docs, text_col).where(F.col("__score") < limit).drop("__score")
