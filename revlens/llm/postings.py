"""Approximate nearest neighbours by balanced posting lists.

Nearness is the largest inner product.  A vector x gets one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and a query is scaled to norm M
with a zero there; distances then rank as inner products do.

1. Equal vectors collapse to one posting that keeps their smallest ids, as
   many as a result can show, so a large group of copies is one posting.
2. A bounded sample (20,000 vectors) is halved at the median between two
   centres again and again, so the leaves are equally large; their means are
   the centroids (at most 4,096), held in memory as a neighbour graph.
3. Every vector walks the graph to its centroids; a boundary vector is
   replicated to up to four lists, skipping a list whose centroid is nearer
   to a list already chosen than to the vector.
4. A query searches the lists whose centroid is at most ``ratio`` times as
   far as the nearest one.  The ratio is measured: for a bounded set of
   sample queries the exact neighbours come from a scan of all vectors, and
   the ratio is the ``aim`` quantile of what reaching each of them takes.
5. Long lists are cut into chunks; each (list, chunk) holds its vectors in
   memory and streams the queries that chose it past them.  A query carries the
   score of its last place among the sample's vectors in those lists, so only
   vectors that can still be among the results leave the task.
6. The chunks' finds are ranked per distinct query vector and handed to the
   queries that share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import stored
from revlens.llm.vectors import matrix, usable

#: Bounds of the fit: sample rows, centroids, and sample queries of the measured ratio.
SAMPLE, CENTROIDS, PROBES = 20_000, 4096, 256
#: Vectors a centroid stands for while the number of centroids is within its bound.
LIST = 256
#: Lists a vector may stand in, and graph neighbours of a centroid.
REPLICAS, DEGREE = 4, 24
#: Vectors of a list that one task holds at once.
CHUNK = 8192
#: Rows walked through the graph at once.
WALK = 512


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first coordinate on: equal vectors get equal scores."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def halved(points: np.ndarray, leaves: int, seed: int = 7) -> np.ndarray:
    """Means of ``leaves`` (a power of two) equally large groups, by repeated two-centre halving at the median."""
    rng = np.random.default_rng(seed)

    def split(x, leaves):
        if leaves == 1 or len(x) < 2:
            return [x.mean(axis=0)]
        centre = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(8):
            lean = x @ (centre[0] - centre[1])
            order = np.argsort(lean, kind="stable")
            half = len(x) // 2
            centre = np.stack([x[order[half:]].mean(axis=0), x[order[:half]].mean(axis=0)])
        return split(x[order[half:]], leaves // 2) + split(x[order[:half]], leaves // 2)

    return np.array(split(points, leaves))


@dataclass
class Graph:
    """Centroids with their neighbour graph; ``walk`` finds the nearest ones of many points at once."""

    points: np.ndarray
    links: np.ndarray
    start: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, degree: int = DEGREE) -> Graph:
        """Nearest-neighbour links in both directions, plus a ring that keeps the graph in one piece."""
        n, norm = len(points), (points * points).sum(axis=1)
        wanted = [set() for _ in range(n)]
        for at in range(0, n, 1024):
            far = norm[None] - 2 * points[at:at + 1024] @ points.T
            near = np.argsort(far, axis=1, kind="stable")[:, :degree // 2 + 1]
            for i, row in enumerate(near, at):
                for j in row.tolist():
                    if i != j:
                        wanted[i].add(j)
                        wanted[j].add(i)
        for i in range(n):  # no hub has more than twice the degree
            rank = sorted(wanted[i], key=lambda j: (norm[j] - 2 * points[i] @ points[j], j))[:2 * degree]
            wanted[i] = {*rank, (i + 1) % n, (i - 1) % n}
        width = max(map(len, wanted))
        links = np.array([sorted(w) + [i] * (width - len(w)) for i, w in enumerate(wanted)])
        return cls(points, links, np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int)))

    def walk(self, x: np.ndarray, beam: int, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) per row of x, nearest first, -1 and inf where there are no more.

        Best-first steps of all rows at once; a row stops when none of its
        ``beam`` best is unvisited.  With a ratio the beam is doubled until its
        last place is beyond ``ratio`` times the nearest."""
        beam = min(beam, len(self.points))
        while True:
            ids, far = self._walk(x, beam)
            if beam == len(self.points) or not ratio or (far[:, -1] > ratio * far[:, 0]).all():
                return ids, far
            beam = min(2 * beam, len(self.points))

    def _walk(self, x, beam):
        rows, n = len(x), len(self.points)
        seen = np.zeros((rows, n), bool)
        norm, square = (x * x).sum(axis=1), (self.points * self.points).sum(axis=1)
        at = np.arange(rows)[:, None]

        def distances(ids):
            return np.maximum(norm[:, None] + square[ids] - 2 * np.einsum("rkd,rd->rk", self.points[ids], x), 0)

        new = np.broadcast_to(self.start, (rows, len(self.start)))
        ids, far = np.full((rows, beam), -1), np.full((rows, beam), np.inf)
        done = np.zeros((rows, beam), bool)
        while True:
            fresh = ~seen[at, new]
            seen[at, new] = True
            both, d = np.concatenate([ids, new], axis=1), np.concatenate([far, np.where(fresh, distances(new), np.inf)], axis=1)
            open_ = np.concatenate([done, ~fresh], axis=1)
            best = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, far, done = both[at, best], d[at, best], open_[at, best]
            done |= np.isinf(far)
            if done.all():
                break
            step = np.argmin(done, axis=1)  # the nearest one not yet looked at
            rest = ~done[at[:, 0], step]
            done[at[:, 0], step] = True
            new = np.where(rest[:, None], self.links[ids[at[:, 0], step]], self.start[0])
            once = np.sort(new, axis=1)
            twice = np.concatenate([np.zeros((rows, 1), bool), once[:, 1:] == once[:, :-1]], axis=1)
            new = np.where(twice, self.start[0], once)  # the start has been seen by all
        return np.where(np.isinf(far), -1, ids), np.sqrt(far)

    def lists(self, x: np.ndarray, most: int = REPLICAS) -> list[list[int]]:
        """Lists of each point: the nearest centroid, and others that no chosen centroid stands before."""
        ids, far = self.walk(x, 4 * most)
        out = []
        for row, d in zip(ids, far):
            chosen: list[int] = []
            for c, dist in zip(row.tolist(), d.tolist()):
                if c < 0 or len(chosen) == most:
                    break
                if not chosen or np.sqrt(((self.points[chosen] - self.points[c]) ** 2).sum(axis=1)).min() >= dist:
                    chosen.append(c)
            out.append(chosen)
        return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings every norm to ``top``."""
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def scaled(q: np.ndarray, top: float) -> np.ndarray:
    """Queries at norm ``top`` with a zero in the added coordinate."""
    return np.concatenate([q * (top / np.sqrt((q * q).sum(axis=1)))[:, None], np.zeros((len(q), 1))], axis=1)


def best_of(q: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, exact score) of the k best x for each q, ties at the last place included,
    without those under the query's ``floor``."""
    s = q @ x.T
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0)) + 1e-300
    low = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(s >= (np.maximum(low, floor) - slack)[:, None])
    return i, j, exact_scores(q[i], x[j])


@dataclass
class Index:
    """Fitted parts of the search: all bounded by the constants above."""

    graph: Graph
    sample: np.ndarray
    stands: np.ndarray
    top: float
    places: int

    def ask(self, q: np.ndarray, ratio: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, list) of the lists to search, and the score under which nothing can be a result.

        Beyond the ratio further lists are taken while the ones before could hold fewer vectors than places."""
        x = scaled(q, self.top)
        enough = min(REPLICAS * self.places, sizes.sum())
        ids, far = self.graph.walk(x, 64, ratio)
        if ids.shape[1] < len(sizes) and (np.where(ids < 0, 0, sizes[ids]).sum(axis=1) < enough).any():
            ids, far = self.graph.walk(x, len(sizes))
        held = np.where(ids < 0, 0, sizes[ids])
        row, place = np.nonzero((ids >= 0) & ((far <= ratio * far[:, :1]) | (held.cumsum(axis=1) - held < enough)))
        chosen = np.zeros((len(q), len(sizes) + 1), bool)
        chosen[row, ids[row, place]] = True
        there = np.zeros((len(q), len(self.sample)), bool)
        for one in self.stands.T:
            there |= chosen[:, one]
        floor = np.full(len(q), -np.inf)
        if len(self.sample) >= self.places:
            s = np.where(there, q @ self.sample.T, -np.inf)
            floor = np.partition(s, len(self.sample) - self.places, axis=1)[:, len(self.sample) - self.places]
        return row, ids[row, place], floor


def distinct_vectors(rows: DataFrame, places: int) -> DataFrame:
    """(k1, k2, v, ids): each distinct vector once, with its ``places`` smallest ids (null last).

    The rank limit is taken in every task before the shuffle, so a vector that many rows share moves a few rows a task."""
    order = Window.partitionBy("k1", "k2").orderBy(F.col("id").asc_nulls_last())
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)
    return kept.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("ids"))


def _sampled(df: DataFrame, n: int, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` rows of the distinct vectors, chosen by their keys."""
    if n <= rows:
        return df
    order = F.xxhash64(F.lit(salt), "k1", "k2")
    share = rows / n * 1.2 + 50 / n
    return df.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order).limit(rows)


def fit(vectors: DataFrame, n: int, places: int) -> Index:
    """Centroids, graph and fit sample of ``n`` distinct vectors."""
    sample = np.array([r["v"] for r in _sampled(vectors, n, SAMPLE, 1).select("v").collect()], np.float64)
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))).first()[0] ** 0.5
    leaves = 1
    while 2 * leaves <= min(CENTROIDS, n // LIST, len(sample) // 4):
        leaves *= 2
    graph = Graph.over(halved(lifted(sample, top), leaves))
    stands = np.full((len(sample), REPLICAS), leaves)  # the list after the last holds nothing
    for at in range(0, len(sample), WALK):
        for i, row in enumerate(graph.lists(lifted(sample[at:at + WALK], top)), at):
            stands[i, :len(row)] = row
    return Index(graph, sample, stands, top, places)


def posted(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, k1, k2, v, part): every distinct vector in each of its lists."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, WALK):
                part = b.slice(at, WALK)
                chosen = index.graph.lists(lifted(matrix(part.column(2)), index.top))
                rows = pa.array(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays([pa.array([c for row in chosen for c in row], pa.int32()), *[c.take(rows) for c in part.columns]],
                                                 names=["list", "k1", "k2", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("k1", "k2", "v").mapInArrow(run, f"list int, k1 long, k2 long, v {kind}")


def measured_ratio(vectors: DataFrame, lists: DataFrame, index: Index, n: int, places: int, aim: float) -> float:
    """The ratio at which an ``aim`` share of the exact neighbours of the sample queries is reached.

    All vectors are scanned in blocks; only each block's ``places`` best per sample query leave it."""
    probes = np.array([r["v"] for r in _sampled(vectors, n, PROBES, 2).select("v").collect()], np.float64)
    floor = np.full(len(probes), -np.inf)

    def scan(batches):
        best: list = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        for b in batches:
            k1, k2, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
            i, j, s = best_of(probes, x, places, floor)
            best = [np.concatenate(p) for p in zip(best, [i, k1[j], k2[j], s])]
            order = np.lexsort([-best[3], best[0]])
            best = [p[order] for p in best]
            new = np.r_[True, best[0][1:] != best[0][:-1]] if len(order) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            best = [p[np.arange(len(order)) - first < places] for p in best]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in best], names=["probe", "k1", "k2", "score"])

    near = vectors.select("k1", "k2", "v").mapInArrow(scan, "probe long, k1 long, k2 long, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "k1", "k2")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places).select("probe", "k1", "k2")
    stood = lists.select("k1", "k2", "list").join(F.broadcast(near), ["k1", "k2"])  # at most PROBES x places rows
    reached: dict = {}
    far = np.sqrt(np.maximum((index.graph.points ** 2).sum(axis=1)[None] + index.top ** 2
                             - 2 * scaled(probes, index.top) @ index.graph.points.T, 0))
    far = far / np.maximum(far.min(axis=1, keepdims=True), 1e-300)
    for r in stood.collect():
        key = (r["probe"], r["k1"], r["k2"])
        reached[key] = min(reached.get(key, np.inf), far[r["probe"], r["list"]])
    needed = np.sort(np.array(list(reached.values())))
    return float(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) * (1 + 1e-9)


def _search(index: Index, places: int):
    """mapInArrow body over rows sorted by (list, chunk, kind): its vectors (kind 0), then its queries (kind 1)."""
    def run(batches):
        key, held, ids = None, [], []
        for b in batches:
            chunk = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            kind, k = b.column(2).to_numpy(), np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()], axis=1)
            x, floor = matrix(b.column(5)), b.column(6).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]).any(axis=1) | (kind[1:] != kind[:-1]), True])
            for a, z in zip(cut, cut[1:]):
                here = tuple(chunk[a])
                if here != key:
                    key, held, ids = here, [], []
                if kind[a] == 0:
                    held.append(x[a:z])
                    ids.append(k[a:z])
                    continue
                if not held:
                    continue
                held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                for at in range(a, z, 512):
                    to = min(at + 512, z)
                    i, j, s = best_of(x[at:to], held[0], places, floor[at:to])
                    found = [k[at:to][i, 0], k[at:to][i, 1], ids[0][j, 0], ids[0][j, 1], s]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["q1", "q2", "k1", "k2", "score"])

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, count: int = 20, aim: float = 0.97) -> DataFrame:
    """(query_id, rank, id, score): the ``count`` nearest found for every row whose id ``every`` divides.

    Candidates are all rows with another id.  Rows whose vector is null, empty,
    all zero, or holds a null or non-finite number, or has another length than most, take no part.
    Ties go to the smaller id, null ids last; a null id is never a query.
    Repeated rows count once; rows with one id and several vectors are rows of
    their own, and each such query has its own neighbours.  Other columns are ignored; an empty table
    gives no rows."""
    spark, places = df.sparkSession, count + 1
    rows = usable(df, id_col, vec_col, F.exists("v", lambda e: e != 0))
    rows = stored(rows.select("id", "v", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2")).distinct())
    vectors = stored(distinct_vectors(rows, places))
    n = vectors.count()
    names = (f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, "
             f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double")
    if not n:
        return spark.createDataFrame([], names)
    index = fit(vectors, n, places)
    lists = stored(posted(vectors, index))
    ratio = measured_ratio(vectors, lists, index, n, places, aim)
    asked = rows.where(F.col("id") % every == 0).select("id", "k1", "k2")
    queries = vectors.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v")
    sizes = np.zeros(len(index.graph.points), int)
    for r in lists.groupBy("list").count().collect():  # one row per centroid at most
        sizes[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK))

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, WALK):
                part = b.slice(at, WALK)
                row, chosen, floor = index.ask(matrix(part.column(2)), ratio, sizes)
                times = chunks[chosen]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, chosen = np.repeat(row, times), np.repeat(chosen, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(chosen.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(np.ones(len(row), np.int32)),
                    *[c.take(take) for c in part.columns], pa.array(floor[row])],
                    names=["list", "chunk", "kind", "k1", "k2", "v", "floor"])

    kind = vectors.schema["v"].dataType.simpleString()
    shape = f"list int, chunk int, kind int, k1 long, k2 long, v {kind}, floor double"
    parts = F.create_map(*[F.lit(int(x)) for c in np.flatnonzero(chunks > 1) for x in (c, chunks[c])]) if (chunks > 1).any() else None
    chunk = F.pmod(F.xxhash64("k1", "k2"), F.coalesce(parts[F.col("list")], F.lit(1))).cast("int") if parts is not None else F.lit(0)
    held = lists.select("list", chunk.alias("chunk"), F.lit(0).alias("kind"), "k1", "k2", "v", F.lit(None).cast("double").alias("floor"))
    work = held.unionByName(queries.mapInArrow(ask, shape))
    found = (work.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind", "k1", "k2")
             .mapInArrow(_search(index, places), "q1 long, q2 long, k1 long, k2 long, score double")).distinct()
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    named = found.join(vectors.select("k1", "k2", "ids"), ["k1", "k2"]).select("q1", "q2", "score", F.explode("ids").alias("id"))
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)
    best = named.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    out = asked.withColumnsRenamed({"id": "query_id", "k1": "q1", "k2": "q2"}).join(best, ["q1", "q2"])
    others = F.slice(F.filter("best", lambda e: ~e["id"].eqNullSafe(F.col("query_id"))), 1, count)
    out = out.select("query_id", F.posexplode(others).alias("rank", "found"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("found.id").alias(id_col), "found.score")
