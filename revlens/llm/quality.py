"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

The n-grams are of whole words (lower-cased) and of word shapes (letter case by
Unicode, digits and marks of a word, runs collapsed), one and two words long,
with markers for long shapes, for a word equal to the one before it and for
the share of the words or lines that a shape, a repeated window or a repeated
line takes.  An indicator is scaled by the classes' log-count ratio, counted
over all labelled rows outside the held-out fold; a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent; its margin becomes
a score by a logistic map fitted on other rows.  Both fits scale a row by
counts without the row itself, since most word pairs of a text stand in it alone."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import append, held_out, sampled, stored, training_rows

#: Indicators are numbered by a hash modulo this, which bounds the model's size.
DIMENSIONS = 1 << 20
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Factor of the first word's number in a pair's (odd, so that it loses nothing modulo a power of two).
PAIR = np.uint64(0x9E3779B97F4A7C15)
SHARES = (0.02, 0.1, 0.3, 0.6)
SHAPES_KEPT = 200_000


def letters_class(run: re.Match) -> str:
    """a: with a lower-case letter; I, A: one or more capitals; o: letters without case; 0: other numbers."""
    run = run[0]
    if any(map(str.islower, run)):
        return "a"
    if any(map(str.isupper, run)):
        return "A" if len(run) > 1 else "I"
    return "o" if any(map(str.isalpha, run)) else "0"


def shape(word: str) -> str:
    """Case, digit and mark pattern of a whole word; combining marks go with their letters."""
    first = "T" if word[:1].isupper() and not word.isupper() else ""
    if not word.isascii():
        word = "".join(c for c in word if unicodedata.category(c)[0] != "M")
    return first + DIGITS.sub("0", LETTERS.sub(letters_class, word))


def share_level(part: int, whole: int) -> int:
    """How many of the limits in ``SHARES`` the share exceeds."""
    return sum(part > s * whole for s in SHARES)


def indicators(text: str, known: dict) -> np.ndarray:
    """Distinct indicator numbers of a whole text, ascending; a text without words has the marker of that."""
    words = text.split()
    shapes, numbers = [], []
    for w in words:
        s = known.get(w)
        if s is None:
            if len(known) >= SHAPES_KEPT:
                known.clear()
            s = known[w] = shape(w), zlib.crc32(b"\x04" + w.lower().encode())
        shapes.append(s[0])
        numbers.append(s[1])
    found = set(shapes)
    found.update(f"\x02long>{len(s).bit_length()}" for s in set(shapes) if len(s) > 12)
    found.update(map("\x01".join, set(zip(shapes, shapes[1:]))))
    for s, n in Counter(shapes).items():
        found.update(f"\x02{s}>{k}" for k in range(share_level(n, len(words))))
    same = sum(map(str.__eq__, words, words[1:]))
    found.update(f"\x03same>{k}" for k in range(share_level(same, len(words))))
    triples = Counter(zip(words, words[1:], words[2:]))
    again = sum(n for n in triples.values() if n > 1)
    found.update(f"\x03again>{k}" for k in range(share_level(again, len(words))))
    lines = [x for x in text.split("\n") if x.strip()]
    found.update(f"\x03lines>{k}" for k in range(share_level(len(lines) - len(set(lines)), len(lines))))
    found.update(f"\x03words>{k}" for k in (0, 5, 20, 50) if len(words) > k)
    found.add("\x03any")
    whole = np.array(numbers, np.uint64)
    pairs = (whole[:-1] * PAIR + whole[1:]) * PAIR >> np.uint64(32)
    marks = np.fromiter((zlib.crc32(x.encode()) for x in found), np.uint64, len(found))
    return np.unique((np.concatenate([marks, whole, pairs]) % np.uint64(DIMENSIONS)).astype(np.int32))


def with_indicators(df: DataFrame, text_col: str) -> DataFrame:
    def make(texts):
        known: dict = {}
        rows = [indicators(t, known) for t in texts]
        at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))]

    return append(df, text_col, "__grams array<int>", make)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 3, x: list | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on scaled indicators, by dual coordinate descent.

    One dual variable a row, 0 <= a <= cost (times the class balance); each step
    solves for one variable and moves the weights along its row.  The bias is a
    constant feature of value one.  ``x`` holds the values of the rows' indicators
    where they are not ``ratio``."""
    x = x or [ratio[r] for r in rows]
    square = np.array([v @ v + 1 for v in x])
    most = cost * np.where(y > 0, (y < 0).sum() / max((y > 0).sum(), 1), 1.0).clip(0.05, 20)
    w, bias, a = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(a[i] - g / square[i], 0.0), most[i])
            if step := (new - a[i]) * y[i]:
                w[rows[i]] += step * x[i]
                bias += step
                a[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps with a small ridge on smoothed labels."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


class QualityModel:
    """``weight`` already holds the class ratios: a margin is the sum of the weights of a row's indicators."""

    def __init__(self, weight=None, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0, prior: float = 0.5):
        self.weight, self.bias, self.slope, self.offset, self.prior = weight, bias, slope, offset, prior

    def margins(self, rows) -> np.ndarray:
        return np.array([self.weight[r].sum() + self.bias for r in rows], float)

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        if self.weight is None:
            return df.withColumn("__score", F.lit(self.prior))
        shared = df.sparkSession.sparkContext.broadcast(self)  # eight megabytes, whatever the input

        def make(texts):
            known, model = {}, shared.value
            m = model.margins(indicators(t, known) for t in texts)
            return [pa.array(1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30))))]

        return append(df, text_col, "__score double", make)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 12_000,
                smooth: float = 1.0, mix: float = 0.25) -> QualityModel:
    """Fit on the labelled rows outside the held-out fold (crc32(id) mod 3 is 1).

    The class ratios count all of them; about ``fit_rows`` rows at most, chosen by a hash of
    the id, fit the hinge-loss model and the logistic map, 3:1.  ``mix`` draws the weights
    from their mean size towards the fitted ones.  With one class only, every score is the share of good rows."""
    rows = stored(with_indicators(training_rows(docs, labels, "quality", id_col, text_col), "text").select("id", "label", "__grams"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return QualityModel(prior=float(n.get(1, 0) > 0) if n else 0.5)
    counts = rows.select("label", F.explode("__grams").alias("g")).groupBy("g").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    number, up, down = (c.to_numpy() for c in counts.select("g", "good", "bad").toArrow().columns)  # at most DIMENSIONS rows
    good, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    good[number], bad[number] = up, down
    seen = good + bad > 0
    share = good.sum() / (good.sum() + bad.sum())
    prior = 2 * smooth * share, 2 * smooth * (1 - share)  # by the classes' sizes: an indicator never seen has ratio 0
    odds = np.log(share) - np.log(1 - share)
    ratio = np.log(good + prior[0]) - np.log(bad + prior[1]) - odds
    fit = sampled(rows, fit_rows, "fit").orderBy(F.xxhash64("id"), "id").select("label", "__grams").toArrow()  # as arrays: no object a number
    held = np.arange(len(fit)) % 4 == 3
    grams = [g for c in fit["__grams"].chunks for g in np.split(c.flatten().to_numpy(), np.asarray(c.offsets)[1:-1] - c.offsets[0].as_py())]
    y = np.where(fit["label"].to_numpy() == 1, 1.0, -1.0)
    if len(set(y[~held])) < 2:
        return QualityModel(prior=n[1] / (n[0] + n[1]))
    x = [np.log(good[g] - (s > 0) + prior[0]) - np.log(bad[g] - (s < 0) + prior[1]) - odds for g, s in zip(grams, y)]
    w, bias = descend([g for g, h in zip(grams, held) if not h], y[~held], ratio, x=[v for v, h in zip(x, held) if not h])
    mean = np.abs(w[seen]).mean()
    scaled = (1 - mix) * mean + mix * w  # weights of the scaled indicators; times the ratio, of the indicators
    model = QualityModel(scaled * ratio, mix * bias)
    at = held if len(set(y[held])) == 2 else ~held
    model.slope, model.offset = logistic(np.array([scaled[g] @ v + model.bias for g, v, h in zip(grams, x, at) if h]), y[at])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts have the indicator of any text only; a null id counts
    as the text '' for the fold; repeated rows get equal scores; other columns
    are ignored; an empty table gives an empty result."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_quality(narrow, labels, **settings)
    return model.score(narrow).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("__score").alias("score"),
                                      (F.col("__score") >= limit).cast("int").alias("predicted"))
