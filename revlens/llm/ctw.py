"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; the decision after each bit prefix has a
context tree of its own over the preceding ``DEPTH`` bytes.  At every
context the Krichevsky-Trofimov estimate of the counts seen there is mixed
with what the deeper contexts say, with the weights that context-tree
weighting gives: P_w = (P_kt + product of the children's P_w) / 2, P_w = P_kt
at full depth.  The probability of a byte after the training corpus is the
product over its eight decisions; a text's score is the log10 of their product
over all its bytes (A-Z in lower case; before its start stand zero bytes).

All counts of the trees follow from those of byte (DEPTH + 1)-grams, which
tasks count and a shuffle sums.  Contexts that share their last two bytes form
a subtree; the subtrees are worked on by a shuffle on those two bytes, and
only the two topmost levels (at most 256 contexts) are on the driver.  The
result is one value for every distinct gram of the corpus, held-out texts
included: a table that grows with the corpus and is never broadcast whole.

Frequent things are looked up in a broadcast table of fixed size, all others
are joined by a shuffle in which no key is frequent any more: the values of the
``hot_grams`` commonest grams (12 bytes each), and, for the base score
(add-one word unigrams), the counts of the ``hot_words`` commonest words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.bpe import listed, portions
from revlens.llm.common import byte_list, commonest, held_out, stored

#: Distinct words that a task holds before it hands on partial counts.
KEPT = 250_000
#: Bytes of text whose grams a task holds at once, and grams that it gathers before it sums them.
PORTION, GATHERED = 1 << 20, 1_500_000
#: Bytes of context.
DEPTH = 5


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context: the DEPTH bytes before, last byte lowest; byte; owner text) of every byte of the texts."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    length = np.array([len(t) + DEPTH for t in texts], np.int64)
    start = np.cumsum(length) - length
    keep = np.ones(len(data), bool)
    keep[(start[:, None] + np.arange(DEPTH)).reshape(-1)] = False
    at = np.flatnonzero(keep)
    context = np.zeros(len(data), np.int64)
    for d in range(DEPTH, 0, -1):
        context[DEPTH:] = (context[DEPTH:] << 8) | data[DEPTH - d:len(data) - d]
    return context[at], data[at], np.repeat(np.arange(len(texts)), length)[at]


def count_grams(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (context and byte as one number) and their counts (2, n): in texts not held out, in all."""
    context, byte, owner = grams(texts)
    key, k = np.unique((((context << 8) | byte) << 1) | held[owner].astype(np.int64), return_counts=True)
    return merged(key >> 1, np.stack([np.where(key & 1, 0, k), k]))


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts (2, n) of equal codes."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[:, order]
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[start], np.add.reduceat(counts, start, axis=1) if len(start) else counts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series eight steps up."""
    shift = sum(np.log(x + i) for i in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of every byte: the node (bit prefix in heap order, 1..255) and the bit taken, (n, 8)."""
    shift = np.arange(8, 0, -1)
    code = 256 | byte[:, None]
    return code >> shift, (code >> (shift - 1)) & 1


def _share(log_odds: np.ndarray) -> np.ndarray:
    """Weight of stopping at a context, from the log of its odds."""
    return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


class Level:
    """Decisions seen at the contexts of one depth: sorted keys (context and node), counts of zeros and
    ones, their estimate of a zero, the weight of stopping there, and log P_w."""

    def __init__(self, keys, zero, one, child_sum=None):
        self.keys, self.zero, self.one = keys, zero, one
        own = log_kt(zero, one)
        self.kt = (zero + 0.5) / (zero + one + 1)
        self.stop = np.ones(len(keys)) if child_sum is None else _share(own - child_sum)
        self.log_w = own if child_sum is None else np.logaddexp(own, child_sum) - math.log(2)

    def parent(self, depth: int) -> "Level":
        """The level above, at contexts of ``depth`` bytes."""
        keys, at = np.unique((self.keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | self.keys & 255, return_inverse=True)
        total = lambda x: np.bincount(at, x, len(keys))
        return Level(keys, total(self.zero), total(self.one), total(self.log_w))


def subtrees(codes: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH .. 2 of the training grams of one or more pairs of last bytes."""
    node, bit = nodes(codes & 255)
    keys, at = np.unique(((codes >> 8) << 8)[:, None] | node, return_inverse=True)
    at, n = at.reshape(-1), np.repeat(n, 8)
    bit = bit.reshape(-1)
    out = [Level(keys, np.bincount(at, n * (1 - bit), len(keys)), np.bincount(at, n * bit, len(keys)))]
    for d in range(DEPTH - 1, 1, -1):
        out.append(out[-1].parent(d))
    return out


class Top:
    """Depths 0 and 1: for every last byte and node, the probability of a zero that is settled there and
    the weight left for deeper contexts.  A context that was not seen leaves all of it, at even odds."""

    def __init__(self, zero: np.ndarray, one: np.ndarray, child_sum: np.ndarray):
        """Arrays (256 last bytes, 256 nodes)."""
        def level(a, b, below):
            own = log_kt(a, b)
            return (a + 0.5) / (a + b + 1), _share(own - below), np.logaddexp(own, below) - math.log(2)

        kt_one, stop_one, log_w = level(zero, one, child_sum)
        seen = zero + one > 0
        kt, stop, _ = level(zero.sum(axis=0), one.sum(axis=0), np.where(seen, log_w, 0.0).sum(axis=0))
        left = 1 - stop
        self.settled = stop * kt + left * np.where(seen, stop_one * kt_one, 0.5)
        self.left = np.where(seen, left * (1 - stop_one), 0.0)


def gram_values(codes: np.ndarray, levels: list[Level], top: Top) -> np.ndarray:
    """log10 probability of the byte of every gram after its context."""
    node, bit = nodes(codes & 255)
    last = (codes >> 8 & 255)[:, None]
    settled, left = top.settled[last, node], top.left[last, node]
    for d, level in zip(range(2, DEPTH + 1), reversed(levels)):
        key = ((codes >> 8 & ((1 << 8 * d) - 1)) << 8)[:, None] | node
        at = np.searchsorted(level.keys, key).clip(max=max(len(level.keys) - 1, 0))
        seen = level.keys[at] == key if len(level.keys) else np.zeros(key.shape, bool)
        kt, stop = (level.kt[at], level.stop[at]) if len(level.keys) else (0.5, 1.0)
        settled = settled + left * np.where(seen, stop * kt, 0.5)
        left = np.where(seen, left * (1 - stop), 0.0)
    return np.log10(np.where(bit == 1, 1 - settled, settled)).sum(axis=1)


def _by_pair(make):
    """mapInArrow body over (pair, code, n, m) sorted by pair: ``make(codes, n, m)`` for runs of whole pairs."""
    def run(batches):
        rest = np.zeros((4, 0), np.int64)
        for b in batches:
            part = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            part = np.concatenate([rest, part], axis=1)
            other = np.flatnonzero(part[0] != part[0, -1]) if part.shape[1] else []
            cut = other[-1] + 1 if len(other) else 0  # the last pair may go on in the next batch
            if cut:
                yield make(*part[1:, :cut])
            rest = part[:, cut:]
        if rest.shape[1]:
            yield make(*rest[1:])
    return run


def weights_of(codes, n, m):
    """Log P_w and counts of the decisions at the two-byte contexts."""
    level = subtrees(codes[n > 0], n[n > 0])[-1]
    return pa.RecordBatch.from_pydict({"last": pa.array(level.keys >> 8 & 255), "node": pa.array(level.keys & 255), "zero": pa.array(level.zero, pa.float64()),
                                       "one": pa.array(level.one, pa.float64()), "log_w": pa.array(level.log_w, pa.float64())})


def values_of(top: Top):
    def make(codes, n, m):
        logs = gram_values(codes, subtrees(codes[n > 0], n[n > 0]), top)
        return pa.RecordBatch.from_pydict({"code": pa.array(codes), "log": pa.array(logs, pa.float64()), "m": pa.array(m)})
    return make


def train_tree(counts: DataFrame) -> DataFrame:
    """(code, log, m) of every distinct gram, from its counts (code, n: in training, m: in all texts)."""
    dealt = (counts.select(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair"), "code", "n", "m")
             .repartition("pair").sortWithinPartitions("pair"))
    seen = dealt.mapInArrow(_by_pair(weights_of), "last bigint, node bigint, zero double, one double, log_w double")
    top = np.zeros((3, 256, 256))
    for r in seen.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "log_w")]).collect():  # at most 256 * 255 rows
        top[:, r["last"], r["node"]] = r["zero"], r["one"], r["log_w"]
    return stored(dealt.mapInArrow(_by_pair(values_of(Top(*top))), "code bigint, log double, m bigint"))


class HotGrams:
    """Values of the commonest grams, looked up by a sorted search."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.logs = codes[order], logs[order].astype(np.float32)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """log10 probability of the known grams of every text, and its grams that need the full table."""
        context, byte, owner = grams(texts)
        code = (context << 8) | byte
        if len(self.codes):
            at = np.searchsorted(self.codes, code).clip(max=len(self.codes) - 1)
            known = self.codes[at] == code
            total = np.bincount(owner[known], self.logs[at[known]].astype(np.float64), minlength=len(texts))
        else:
            known, total = np.zeros(len(code), bool), np.zeros(len(texts))
        code, owner = code[~known], owner[~known]
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        return total, [code[a:b] for a, b in zip(edge, edge[1:])]


def gather(docs: DataFrame) -> DataFrame:
    """(word, code, n, m): partial counts of training words (code null), of ends (both null) and of byte grams
    (word null) from (text, held); n counts in training texts, m in all."""
    def rows(words, codes, n, m):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                                          names=["word", "code", "n", "m"])

    def run(batches):
        words, ends = Counter(), 0
        code, n, size = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            for b in portions(batch, 0, PORTION):
                held = b.column(1).to_numpy(zero_copy_only=False)
                texts = [(t or b"").lower() for t in byte_list(b.column(0))]
                train = [t for t, h in zip(texts, held) if not h]
                ends += len(train)
                for t in train:
                    words.update(t.split())
                new, k = count_grams(texts, held)
                code.append(new)
                n.append(k)
                size += len(new)
                if size > GATHERED:
                    new, k = merged(np.concatenate(code), np.concatenate(n, axis=1))
                    if len(new) > GATHERED // 2:
                        yield rows([None] * len(new), new, k[0], k[1])
                        new, k = new[:0], k[:, :0]
                    code, n, size = [new], [k], len(new)
                if len(words) > KEPT:
                    yield rows(list(words), [None] * len(words), list(words.values()), [0] * len(words))
                    words.clear()
        new, k = merged(np.concatenate(code), np.concatenate(n, axis=1))
        yield rows([None] * len(new), new, k[0], k[1])
        yield rows([*words, None], [None] * (len(words) + 1), [*words.values(), ends], [0] * (len(words) + 1))

    return docs.mapInArrow(run, "word string, code bigint, n bigint, m bigint")


def scored(df: DataFrame, common: HotGrams, hot: dict) -> DataFrame:
    """(id, n_tokens, n_known, known_log, score, n_bytes, rare, codes): what the broadcast tables give of the
    base score and of the model's, and the words and grams that need the full tables."""
    shared = df.sparkSession.sparkContext.broadcast((common, hot))

    def run(batches):
        common, hot = shared.value
        for batch in batches:
            for b in portions(batch, 1, PORTION):
                texts = [(t or b"").lower() for t in byte_list(b.column(1))]
                tokens, known, logs, rare = [], [], [], []
                for t in texts:
                    words = t.split()
                    value = list(map(hot.get, words))
                    missing = [w for w, v in zip(words, value) if v is None]
                    tokens.append(len(words) + 1)
                    known.append(len(words) - len(missing))
                    logs.append(math.fsum(v for v in value if v is not None))
                    rare.append(missing)
                at = pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32))
                flat = pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string())
                total, codes = common.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(total, pa.float64()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(at, flat), listed(codes, np.int64)],
                    names=["id", "n_tokens", "n_known", "known_log", "score", "n_bytes", "rare", "codes"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, known_log double, score double, n_bytes bigint, rare array<string>, codes array<bigint>")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 100_000, hot_grams: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of ``df``.

    The model and the word counts come from the rows outside the held-out
    fold (crc32(id) mod 7 is 2).  Null and empty texts have one token, the
    end, and score 0; without training rows every decision is even.  Null ids
    count as the text '' for the fold; repeated rows count as often as they
    stand; other columns are ignored; an empty table gives an empty result."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = stored(gather(docs.select("text", held_out("id", 7, 2).alias("held"))))
    words = stored(parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    codes = parts.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    ends = parts.where("word IS NULL AND code IS NULL").agg(F.sum("n")).first()[0] or 0
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    top = {r["word"].encode(): math.log10(r["n"] + 1) for r in commonest(words, "n", hot_words).collect()}
    values = train_tree(stored(codes))
    common = commonest(values, "m", hot_grams).select("code", "log").toArrow()
    rows = stored(scored(docs, HotGrams(common["code"].to_numpy(), common["log"].to_numpy()), top).select(F.monotonically_increasing_id().alias("row"), "*"))
    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word")
    found = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_log"))
    deep = rows.select("row", F.explode("codes").alias("code")).join(values.select("code", "log"), "code").groupBy("row").agg(F.sum("log").alias("deep_log"))
    end = math.log10(ends + 1)
    base = F.col("known_log") + F.coalesce("more_log", F.lit(0.0)) + end - F.col("n_tokens") * math.log10(n + v + 1)
    score = F.col("score") + F.coalesce("deep_log", F.lit(0.0))
    return rows.join(found, "row", "left").join(deep, "row", "left").select(
        F.col("id").alias("doc_id"), held_out("id", 7, 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
