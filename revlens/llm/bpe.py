"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The texts of a task are split by the tokenizer's pattern; the distinct words
that are new to the task form a small corpus.  An inverted index maps every
mergeable token pair (named by the rank of its concatenation) to the word
positions where it stands.  The lowest rank present is taken again and
again: all its positions are merged in one step, and only the pairs that
touch a merged position are looked up anew and entered in the index.  A
word is thus merged once however often it occurs.

The order of merges inside a word is that of the usual greedy encoder: its
lowest-ranked pair first, the leftmost of equals first.  Where a merged
token could open a pair of lower rank, one position per word is merged at a
time, so the lower rank gets its turn before the rest.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
#: Characters of text whose words are split at once, and distinct words kept by a task.
CHUNK, KEPT = 1 << 21, 200_000
#: Bytes up to which words are replayed together.
LONG = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank a line (a vocabulary, of bounded size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort beats a hash table on short arrays)."""
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


class Merges:
    """Pair table of a vocabulary and the replay over a list of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {r: t for t, r in ranks.items()}
        pairs, lower = {}, set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
                    lower.update(x for x in (a, b) if x > rank)
        keys = sorted(pairs)
        self.keys = np.array(keys, np.int64)
        self.rank = np.array([pairs[k] for k in keys], np.int64)
        self.lower = lower  # tokens that can open a pair of lower rank than their own
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _ranks_of(self, left, right):
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of every word, as packed 32-bit integers."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n or not len(self.keys):
            return [self.byte[list(w)].astype(np.int32).tobytes() for w in words]
        length = np.array([len(w) for w in words])
        end = np.cumsum(length)
        word = np.repeat(np.arange(len(words)), length)
        tok = np.append(self.byte[data], -1)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[end[length > 0] - 1] = n  # n: no right neighbour
        prv[(end - length)[length > 0]] = -1
        alive = np.ones(n, bool)
        at_rank = np.full(n + 1, NONE)
        index: dict[int, list] = {}

        def enter(pos):
            """Look up the pairs that start at ``pos`` and enter them in the index."""
            right = nxt[pos]
            r = np.where(right < n, self._ranks_of(tok[pos], tok[right]), NONE)
            at_rank[pos] = r
            pos, r = pos[r < NONE], r[r < NONE]
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(r)]):
                if b > a:
                    key = int(r[a])
                    if key not in index:
                        index[key] = []
                        heappush(heap, key)
                    index[key].append(pos[a:b])

        heap: list[int] = []
        enter(np.arange(n))
        heapify(heap)
        while heap:
            r = heappop(heap)
            parts = index.pop(r, [])
            pos = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            pos = distinct(pos[at_rank[pos] == r])  # entries of symbols merged away meanwhile are stale
            if not len(pos):
                continue
            if len(pos) > 1:
                chained = np.r_[False, nxt[pos[:-1]] == pos[1:]]  # overlaps the one before it
                if chained.any():
                    i = np.arange(len(pos))
                    start = np.maximum.accumulate(np.where(chained, 0, i))
                    take = (i - start) % 2 == 0
                else:
                    take = np.ones(len(pos), bool)
                if r in self.lower:
                    w = word[pos]
                    take = np.r_[True, w[1:] != w[:-1]]
                    if not take.all():
                        index[r] = [pos[~take]]
                        heappush(heap, r)
                pos = pos[take]
            b = nxt[pos]
            c = nxt[b]
            tok[pos] = r
            nxt[pos] = c
            inner = c < n
            prv[c[inner]] = pos[inner]
            alive[b] = False
            at_rank[b] = NONE
            left = prv[pos]
            enter(distinct(np.concatenate([pos, left[left >= 0]])))
        ids, out_word = tok[:n][alive], word[alive]
        edge = (4 * np.searchsorted(out_word, np.arange(len(words) + 1))).tolist()
        ids = ids.astype(np.int32).tobytes()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]

    def replay_long(self, word: bytes) -> bytes:
        """Token ids of one word, as packed 32-bit integers, by a heap of (rank, position)."""
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.rank.tolist()))
        rank_of, n = self._pairs.get, len(word)
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(tok[i] << 32 | tok[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j < 0 or tok[i] < 0 or rank_of(tok[i] << 32 | tok[j]) != r:
                continue  # merged away meanwhile
            k = after[i] = after[j]
            tok[i], tok[j] = r, -1
            if k >= 0:
                before[k] = i
                if (s := rank_of(r << 32 | tok[k])) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank_of(tok[h] << 32 | r)) is not None:
                heappush(heap, (s, h))
        ids, i = [], 0
        while i >= 0:
            ids.append(tok[i])
            i = after[i]
        return np.array(ids, np.int32).tobytes()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_words(self, words) -> dict[str, bytes]:
        """Token ids of every distinct word, as packed 32-bit integers; a word that is a token needs no merge."""
        words = list(words)
        raw = [w.encode() for w in words]
        rank = [self.ranks.get(w) for w in raw]
        merged = iter(self.replay([w for w, r in zip(raw, rank) if r is None and len(w) <= LONG]))
        return {w: pack("=i", r) if r is not None else next(merged) if len(b) <= LONG else self.replay_long(b)
                for w, b, r in zip(words, raw, rank)}


def _pieces(pattern, text: str):
    """Lists of the matches in ``text``, bounded in length for very long texts."""
    if len(text) <= CHUNK:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m[0] for m in islice(found, CHUNK // 8)]:
        yield part


def encode_texts(merges: Merges, texts, pattern, known: dict) -> list[np.ndarray]:
    """Token ids of every text; ``known`` keeps the words that the task has met."""
    out, wait, size = [], [], 0

    def flush():
        met = set().union(*(w for _, w in wait))
        if len(known) + len(met - known.keys()) > KEPT:
            known.clear()
        new = met - known.keys()
        known.update(merges.encode_words(new))
        for k, part in wait:
            out[k].append(np.frombuffer(b"".join(map(known.__getitem__, part)), np.int32))
        wait.clear()

    for k, text in enumerate(texts):
        out.append([])
        text = text or ""
        for part in _pieces(pattern, text):
            wait.append((k, part))
            size += sum(map(len, part)) if len(text) > CHUNK else len(text)
            if size >= CHUNK:
                flush()
                size = 0
    if wait:
        flush()
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def portions(batch: pa.RecordBatch, column: int, most: int = CHUNK):
    """Slices of a batch of about ``most`` bytes of text each, so that few texts are Python objects at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def listed(arrays: list, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, tokens: array of int), one row per row of ``df``; with ``decoded`` also
    data: the bytes that the ids stand for, as ``decode`` gives them, in the same pass.

    Null and empty texts have no tokens.  Ids may be null or repeated; other
    columns are ignored; an empty table gives an empty result.  Memory of a task is bounded by its Arrow batch,
    ``CHUNK`` characters of split text (or the longest text) and ``KEPT`` distinct words."""
    # the vocabulary is a file of fixed size (about a megabyte), read once on the driver
    shared = df.sparkSession.sparkContext.broadcast(Merges(load_ranks(ranks_path), pattern))

    def run(batches):
        merges, known = shared.value, {}
        split = regex.compile(merges.pattern)
        for batch in batches:
            for b in portions(batch, 1):
                ids = encode_texts(merges, b.column(1).to_pylist(), split, known)
                out = {"id": b.column(0), "tokens": listed(ids, np.int32)}
                if decoded:
                    out["data"] = pa.array([merges.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, tokens array<int>" + ", data binary" * decoded).withColumnRenamed("id", id_col))


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, tokens, data: binary): the bytes that the ids stand for (none for null ids).

    Repeated rows repeat their result, other columns are ignored, and an empty table gives an empty result."""
    vocabulary = {r: t for t, r in load_ranks(ranks_path).items()}
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        token = shared.value.__getitem__
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                data = [b"".join(map(token, ids or ())) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["id", "tokens", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
            .mapInArrow(run, f"id {kind}, tokens array<int>, data binary").withColumnRenamed("id", id_col))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded documents."""
    both = encode(df, ranks_path, pattern, decoded=True)
    return both.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))
