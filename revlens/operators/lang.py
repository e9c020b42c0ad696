"""Language identification by character-trigram profiles.

Re-aimed from a pretrained library model: profiles are trained with one
``groupBy(lang, gram)`` over labelled texts; a text is scored by joining
its grams to the profiles (add-one smoothing, unseen grams get the
language's floor) and the arg-max language is kept.  Everything is joins
and aggregates; the language list is a handful of rows.  Grams are never
shuffled by text: map-side sums leave a row a (language, gram) for the
profiles and, while these can be broadcast, a row a text for the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import bounded_broadcast

#: Distinct grams up to which the profiles are broadcast.
MOST_GRAMS = 500_000


def char_grams(df: DataFrame, keys: list[str], text: str, n: int = 3) -> DataFrame:
    """The character n-grams of the lower-cased text, one row each, with the keys."""
    # one linear regex pass: a zero-width lookahead captures every overlapping
    # n-gram (substring by position would rescan the UTF-8 text per gram)
    low = F.lower(F.col(text))
    grams = F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    # a text shorter than a gram is one gram, so that it is not lost
    grams = F.when(F.length(low) < n, F.array(low)).otherwise(grams)
    return df.select(*keys, F.explode(grams).alias("gram"))


def train_profiles(grams: DataFrame, lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Per (lang, gram) smoothed log-probability and per-lang floor for unseen grams."""
    tr = grams.groupBy(lang, "gram").agg(F.count(F.lit(1)).alias("c")).checkpoint(eager=True)
    v = tr.select(F.countDistinct("gram")).scalar()
    tot = tr.groupBy(lang).agg(F.sum("c").alias("tot"))
    floor = tot.select(lang, F.log(F.lit(1.0) / (F.col("tot") + v)).alias("lpu"))
    tot = bounded_broadcast(tot, 10_000)  # one row per language
    prof = tr.join(tot, lang).select(lang, "gram", F.log((F.col("c") + 1) / (F.col("tot") + v)).alias("lp"))
    prof = prof.join(bounded_broadcast(floor, 10_000), lang).select(lang, "gram", (F.col("lp") - F.col("lpu")).alias("gain"))
    # small (languages x distinct grams) and reused by every scoring join: materialize once
    return prof.checkpoint(eager=True), floor.checkpoint(eager=True)


def identify(grams: DataFrame, keys: list[str], prof: DataFrame, floor: DataFrame,
             lang: str = "lang") -> DataFrame:
    """Arg-max language per key: ``sum(c * lp)`` = ``n * floor + sum(c * gain)``
    over seen grams.  Every candidate language is scored (ties -> smaller name)."""
    langs = sorted((r[lang], r["lpu"]) for r in floor.where(F.col(lang).isNotNull()).collect())  # a handful of languages
    if not langs:
        return grams.select(*keys, F.lit(None).cast("string").alias("pred")).limit(0)
    gain = [F.coalesce(F.max(F.when(F.col(lang) == x, F.col("gain"))), F.lit(0.0)) for x, _ in langs]
    gains = prof.groupBy("gram").agg(*[g.alias(f"_g{i}") for i, g in enumerate(gain)]).checkpoint(eager=True)
    if gains.count() <= MOST_GRAMS:
        counted, gains = grams.withColumn("c", F.lit(1)), F.broadcast(gains)
    else:  # the grams are shuffled to the profiles: counted first, so that each goes once a text
        counted = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))
    sums = [F.coalesce(F.sum(F.col("c") * F.col(f"_g{i}")), F.lit(0.0)).alias(f"_a{i}") for i in range(len(langs))]
    per = counted.join(gains, "gram", "left").groupBy(*keys).agg(F.sum("c").alias("n"), *sums)
    scores = F.array(*[F.struct((F.col("n") * F.lit(u) + F.col(f"_a{i}")).alias("score"), F.lit(-i).alias("at")) for i, (_, u) in enumerate(langs)])
    names = F.array(*[F.lit(x) for x, _ in langs])
    return per.select(*keys, F.get(names, -F.array_max(scores)["at"]).alias("pred"))
