"""Byte-pair sub-word vocabulary: training, encoding, id mapping, batch
encoding with masks (D13, D14, D16, D24).

Training works on the table of word types (distinct words with counts and
symbols).  A round takes the most frequent pairs and gathers where they stand,
then replays merges there in exact order for as long as no pair that it has
not seen whole can come first, and joins all of the round's pairs where the
types lie.  Rare pairs are gathered with their whole types.  Pairs that stand
in more types than a stated bound are gathered as runs: the stretches of
symbols that they connect, counted over all types, which are few however many
types hold them.  Pair ties are broken by the pair
text (the reference library orders ties by internal ids), so vocabularies
can differ in tie order.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as T

SUFFIX = "</w>"
SPECIALS = ["[UNK]", "[PAD]"]

Pair = tuple[str, str]


def word_types(texts: DataFrame, col: str) -> DataFrame:
    """Distinct lower-cased pre-tokens with their counts and symbols: characters,
    the last one with the end-of-word suffix."""
    w = texts.select(F.explode(T.tokenize(F.lower(F.col(col)))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    chars = F.filter(F.split("word", ""), lambda x: x != "")
    marked = F.transform(chars, lambda x, i: F.when(i == F.size(chars) - 1, F.concat(x, F.lit(SUFFIX))).otherwise(x))
    return w.select("word", "n", marked.alias("syms"))


def merged_symbols(syms: list[str], pair: Pair) -> list[str]:
    """The symbols with every occurrence of the pair joined, from the left."""
    out, i = [], 0
    while i < len(syms):
        if i + 1 < len(syms) and (syms[i], syms[i + 1]) == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


class Replay:
    """Merges on a set of word types or runs, most frequent pair first, with counts kept up to date."""

    def __init__(self, types: list[tuple[int, int, list[str]]], pairs: dict[Pair, int]):
        """``types``: key, count, symbols; ``pairs``: counts of the pairs all of whose occurrences are here."""
        self.syms = {w: list(s) for w, _, s in types}
        self.n = {w: n for w, n, _ in types}
        self.count = dict(pairs)
        self.where: dict[Pair, set[int]] = {}
        for w, s in self.syms.items():
            for p in zip(s, s[1:]):
                if p in self.count:
                    self.where.setdefault(p, set()).add(w)
        self.heap = [(-c, *p) for p, c in pairs.items()]
        heapq.heapify(self.heap)

    def next(self, least: int) -> tuple[int, str, str] | None:
        """The first pair in order, as (-count, a, b), if it occurs ``least`` times."""
        while self.heap:
            c, a, b = self.heap[0]
            now = self.count.get((a, b), 0)
            if now == -c and now >= least:
                return c, a, b
            heapq.heappop(self.heap)
            if now >= least and now != -c:
                heapq.heappush(self.heap, (-now, a, b))
        return None

    def merge(self, pair: Pair) -> None:
        """Join the pair in all its types; pairs that this makes are wholly here from now on."""
        moved: dict[Pair, int] = {}
        for w in self.where.pop(pair, ()):
            old = self.syms[w]
            new = merged_symbols(old, pair)
            if len(new) == len(old):
                continue
            self.syms[w] = new
            for symbols, sign in ((old, -1), (new, 1)):
                for p in zip(symbols, symbols[1:]):
                    moved[p] = moved.get(p, 0) + sign * self.n[w]
            joined = pair[0] + pair[1]
            for p in zip(new, new[1:]):
                if joined in p:
                    self.where.setdefault(p, set()).add(w)
        for p, by in moved.items():
            if by and (p in self.count or pair[0] + pair[1] in p):
                self.count[p] = self.count.get(p, 0) + by
                if self.count[p] > 0:
                    heapq.heappush(self.heap, (-self.count[p], *p))


def _pairs(types: DataFrame) -> DataFrame:
    """(a, b, cnt, at): per adjacent pair, occurrences weighted by the types' counts, and plain."""
    s = F.col("syms")
    both = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return types.select("n", F.inline(both)).groupBy("a", "b").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("at"))


def _holding(pairs: set[Pair]):
    """mapInPandas body: the types in which one of the pairs occurs."""
    def run(batches):
        for pdf in batches:
            yield pdf[[any(p in pairs for p in zip(s, s[1:])) for s in map(list, pdf["syms"])]]
    return run


def runs(syms: list[str], pairs: set[Pair]) -> list[tuple[str, ...]]:
    """The longest stretches of two or more symbols all of whose neighbours are among ``pairs``."""
    out, start = [], 0
    for i in range(1, len(syms) + 1):
        if i == len(syms) or (syms[i - 1], syms[i]) not in pairs:
            if i - start > 1:
                out.append(tuple(syms[start:i]))
            start = i
    return out


def _runs(pairs: set[Pair]):
    """mapInPandas body: (syms, n) of the runs, summed within a batch."""
    def run(batches):
        for pdf in batches:
            found: dict[tuple[str, ...], int] = {}
            for s, n in zip(pdf["syms"], pdf["n"]):
                for r in runs(s.tolist(), pairs):
                    found[r] = found.get(r, 0) + n
            yield pd.DataFrame({"syms": [list(r) for r in found], "n": pd.Series(found.values(), dtype="int64")})
    return run


def _joined(merges: list[Pair]):
    """mapInPandas body: the types with the pairs joined, one pair after the other."""
    ranks = {p: i for i, p in enumerate(merges)}

    def run(batches):
        for pdf in batches:
            yield pdf.assign(syms=[ranked_merges(s.tolist(), ranks, onward=True) for s in pdf["syms"]])
    return run


def train_bpe(words: DataFrame, vocab_size: int = 30000, min_frequency: int = 5, max_merges: int | None = None,
              max_types: int = 50_000, max_pairs: int = 5000) -> tuple[list[Pair], DataFrame]:
    """The ordered merges and the vocabulary (token, id): ``[UNK]`` 0, ``[PAD]`` 1,
    the sorted alphabet, then merged tokens, ``vocab_size`` entries in all if
    enough pairs occur ``min_frequency`` times (at most ``max_merges`` merges if that is given).

    A round gathers at most ``max_pairs`` pairs and ``max_types`` word types or runs
    (documented bounds of the driver's memory; the result does not depend on them)."""
    spark = words.sparkSession
    types = words.select("n", "syms").checkpoint(eager=True)
    letters = types.select(F.explode("syms").alias("s")).distinct().orderBy("s").limit(vocab_size)
    vocab = {t: i for i, t in enumerate([*SPECIALS, *(r["s"] for r in letters.collect())])}
    merges: list[Pair] = []
    width = 256  # pairs whose runs are asked for; follows the number of runs found

    def wanted():
        return len(vocab) < vocab_size and (max_merges is None or len(merges) < max_merges)

    while wanted():
        first = _pairs(types).where(F.col("cnt") >= min_frequency).orderBy(F.desc("cnt"), "a", "b").limit(max_pairs + 1).collect()
        if not first:
            break
        most = min(len(first), max_pairs)
        seen, taken = 0, 0
        while taken < most and seen + first[taken]["at"] <= max_types:
            seen += first[taken]["at"]
            taken += 1
        reach = min(width, most)
        tied = reach < len(first) and first[0]["cnt"] == first[reach]["cnt"]
        whole = taken > 0 and (taken >= reach or tied)
        if whole:
            chosen = {(r["a"], r["b"]): r["cnt"] for r in first[:taken]}
            held = types.mapInPandas(_holding(set(chosen)), types.schema).collect()
        else:
            taken = reach
            while True:
                chosen = {(r["a"], r["b"]): r["cnt"] for r in first[:taken]}
                found = types.mapInPandas(_runs(set(chosen)), "syms array<string>, n long").groupBy("syms").agg(F.sum("n").alias("n"))
                # one pair makes one run, or one a length if its symbols are equal
                held = found.limit(max_types + 1).collect() if taken > 1 else found.collect()
                if len(held) <= max_types or taken == 1:
                    break
                taken = max(1, taken // 4)
            width = max(1, 4 * taken if len(held) < max_types // 8 else 2 * taken if len(held) < max_types // 3 else taken)
        beyond = (-first[taken]["cnt"], first[taken]["a"], first[taken]["b"]) if taken < len(first) else None
        replay = Replay([(i, r["n"], r["syms"]) for i, r in enumerate(held)], chosen)
        done: list[Pair] = []
        while wanted():
            top = replay.next(min_frequency)
            if top is None:
                break
            # a new pair whose symbols met outside the runs was not counted: it occurs at most as often as the first pair beyond
            if beyond is not None and (top > beyond if whole or not done else top[0] >= beyond[0]):
                break
            pair = top[1:]
            merges.append(pair)
            done.append(pair)
            replay.merge(pair)
            if pair[0] + pair[1] in vocab:  # its pairs may occur in types that are not here
                break
            vocab[pair[0] + pair[1]] = len(vocab)
        types = types.mapInPandas(_joined(done), types.schema).checkpoint(eager=True)
    return merges, spark.createDataFrame(list(vocab.items()), "token string, id int")


#: Symbols up to which the lowest rank is looked for in a plain list.
SHORT = 64


def ranked_merges(syms: list[str | None], ranks: dict[Pair, int], onward: bool = False) -> list[str]:
    """Merges by rank on one word: lowest rank first, from the left; only neighbours of a merge are looked at again.

    ``onward``: a pair that a merge makes is left alone if its own rank had passed, as when the pairs are joined one after the other."""
    if len(syms) <= SHORT:
        none = len(ranks)
        found = [ranks.get(p, none) for p in zip(syms, syms[1:])]
        while found and (now := min(found)) < none:
            i = found.index(now)
            syms[i:i + 2] = [syms[i] + syms[i + 1]]
            del found[i]
            for at in (i - 1, i):
                if 0 <= at < len(found):
                    r = ranks.get((syms[at], syms[at + 1]), none)
                    found[at] = none if onward and r <= now else r
        return syms
    after = [*range(1, len(syms)), -1]
    before = [-1, *range(len(syms) - 1)]
    heap = [(r, i, p) for i, p in enumerate(zip(syms, syms[1:])) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        now, i, pair = heapq.heappop(heap)
        j = after[i]
        if syms[i] != pair[0] or j < 0 or syms[j] != pair[1]:
            continue
        syms[i], syms[j] = pair[0] + pair[1], None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for at in (before[i], i):
            if at >= 0 and after[at] >= 0 and (r := ranks.get(p := (syms[at], syms[after[at]]))) is not None and not (onward and r <= now):
                heapq.heappush(heap, (r, at, p))
    return [s for s in syms if s is not None]


def bpe_encode_word(word: str, ranks: dict[Pair, int]) -> list[str]:
    """``ranked_merges`` on the characters of a word, the last one with the end-of-word suffix."""
    syms: list[str | None] = list(word)
    if not syms:
        return []
    syms[-1] += SUFFIX
    return ranked_merges(syms, ranks)


#: Keys whose words are encoded at once, and words that a worker remembers.
KEYS, WORDS = 2048, 500_000


class Encoder:
    """Words -> pieces and ids; merges and vocabulary travel with the task (bounded by the vocabulary size)."""

    def __init__(self, merges: list[Pair], ids: dict[str, int]):
        self.ranks, self.ids = {p: i for i, p in enumerate(merges)}, ids
        self.names = {i: t for t, i in ids.items()}
        self.known: dict[str, tuple[int, ...] | list[str]] = {}

    def word(self, word: str) -> tuple[int, ...] | list[str]:
        """A word's ids or, where it has a piece outside the vocabulary, its pieces."""
        found = self.known.get(word)
        if found is None:
            pieces = bpe_encode_word(word, self.ranks)
            ids = tuple([self.ids.get(p, -1) for p in pieces])
            if len(self.known) >= WORDS:
                self.known.clear()
            found = self.known[word] = pieces if -1 in ids else ids
        return found

    def numbers(self, found: tuple[int, ...] | list[str]):
        """Unknown pieces are ``[UNK]`` (0)."""
        return found if isinstance(found, tuple) else [self.ids.get(p, 0) for p in found]

    def pieces(self, found: tuple[int, ...] | list[str]) -> list[str]:
        return [self.names[i] for i in found] if isinstance(found, tuple) else found

    def flat(self, words: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """(ids, pieces) by word; each distinct one is looked up once."""
        coded = words.dictionary_encode()
        found = [self.word(w) for w in coded.dictionary.to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        ids = pa.ListArray.from_arrays(ends, pa.array([i for f in found for i in self.numbers(f)], pa.int32()))
        pieces = pa.ListArray.from_arrays(ends, pa.array([p for f in found for p in self.pieces(f)], pa.string()))
        return ids.take(coded.indices), pieces.take(coded.indices)

    def merged(self, texts: list[list[str]]) -> list[tuple[int, int, int, str]]:
        """(word place, piece place, id, piece) of several texts of one key, in that order."""
        return sorted((at, k, i, p) for words in texts for at, w in enumerate(words) for f in [self.word(w)] for k, (i, p) in enumerate(zip(self.numbers(f), self.pieces(f))))

    def rows(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """(key, lists of words) -> (key, ids, pieces)."""
        keys, texts = part.column(0), part.column(1)
        several = np.asarray(pc.greater(pc.list_value_length(texts), 1))
        if several.any():
            found = [self.merged(t) for t in texts.to_pylist()]
            return pa.RecordBatch.from_arrays([keys, pa.array([[x[2] for x in f] for f in found], pa.list_(pa.int32())),
                                               pa.array([[x[3] for x in f] for f in found], pa.list_(pa.string()))], names=["key", "ids", "tokens"])
        lists = texts.flatten()
        ids, pieces = self.flat(lists.flatten())
        # a key has one text: its words, and so its pieces, stand together
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])]
        return pa.RecordBatch.from_arrays([keys, *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), a.flatten()) for a in (ids, pieces))], names=["key", "ids", "tokens"])


_ENCODERS: dict[str, Encoder] = {}


def encode_texts(texts: DataFrame, key: str, col: str, merges, vocab: DataFrame) -> DataFrame:
    """D14 + D16: texts -> words -> pieces -> ids, in text order; unknown pieces map to ``[UNK]`` (0).

    Texts are dealt whole by their key and encoded where they lie: no word is shuffled.  A key has one row, whatever the
    number of its texts, and none without a word."""
    kind = texts.schema[key].dataType.simpleString()
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    known = texts.select(key, col).where(F.col(col).isNotNull()).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    words = F.transform("_texts", lambda t: T.tokenize(F.lower(t)))
    of = known.groupBy(key).agg(F.collect_list(col).alias("_texts")).select(key, F.filter(words, lambda w: F.size(w) > 0).alias("_words")).where(F.size("_words") > 0)

    name = uuid.uuid4().hex

    def run(batches):
        if name not in _ENCODERS:  # the tasks that a worker runs one after the other share what it knows
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(merges, ids)
        encoder = _ENCODERS[name]
        for b in batches:
            for at in range(0, b.num_rows, KEYS):
                out = encoder.rows(b.slice(at, KEYS))
                yield pa.RecordBatch.from_arrays(out.columns, names=[key, "ids", "tokens"])
    return of.mapInArrow(run, f"{key} {kind}, ids array<int>, tokens array<string>")


def batch_encode(encoded: DataFrame, width: int = 300, pad_id: int = 1, start_id: int | None = None, end_id: int | None = None) -> DataFrame:
    """The first ids up to ``width``, padded behind, with an attention mask.

    ``start_id`` and ``end_id`` are set around the ids and count towards the width, so a long text loses its last ids."""
    edge = [F.array(F.lit(i).cast("int")) if i is not None else F.array().cast("array<int>") for i in (start_id, end_id)]
    room = width - (start_id is not None) - (end_id is not None)
    ids = F.concat(edge[0], F.slice("ids", 1, room), edge[1])
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id).cast("int"), F.lit(width) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n))
    return encoded.select("*", padded.alias("input_ids"), mask.alias("attention_mask"))
