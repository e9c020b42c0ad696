"""The conversation trie, nearest neighbours and whitening against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from revlens.llm import postings, prefix_trie, whitening
from revlens.llm.postings import nearest
from revlens.llm.whitening import whiten

SF = "/root/testdata/sf0.001"


# --- conversation prefix trie ----------------------------------------------

def brute_trie(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in conv.items()}
    told = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        told[c] = conv.get(c - c % 5, [])[:h] + conv[c][h:]
    nodes, below = {}, {}
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for path in nodes:
        if path:
            below.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        kids, here = below.get(path, []), nodes[path]
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = sum(saved[k] for k in kids) + ((len(here) - 1) * len(path[-1][1].encode()) if path else 0)
        ends = ",".join(str(c) for c in sorted(here) if len(told[c]) == len(path))
        out[min(here), len(path)] = (min(nodes[path[:-1]]) if path else None, len(here), len(kids), leaves[path], saved[path],
                                     hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS depth", "'x' AS key", "2 AS pos", "3 AS conv", "'y' AS class", "0 AS n")
    found = prefix_trie.trie_nodes(df).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("piece, seed", [(256, 1), (2, 2), (1, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, piece, seed):
    """Few texts, so that prefixes of all depths are shared; small pieces force further rounds."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"])[: 4 * (t > 1)], rng.choice(["a", "ß", "long text"]))
            for c in range(70) for t in range(rng.randrange(1, 9))]
    rows += [(100 + 5 * c, t, "user", "same") for c in range(40) for t in range(6)]  # one large group of equal ones
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_odd_rows(spark):
    assert trie(spark, []) == {}
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 0, "user", ""), (6, 2, "user", None), (6, 2, "user", None), (7, 0, "u" * 9, "x" * 200_000),
            (0, 0, "user", "hi"), (1, 0, "user", "hi"), (8, None, "user", "late")]
    rows += [(11, t, "user", f"turn {t % 3}") for t in range(700)] + [(10, t, "user", f"turn {t % 3}") for t in range(600)]
    assert trie(spark, rows) == brute_trie(rows)


def test_contraction_does_not_depend_on_the_cuts():
    """Any cutting into stretches leaves the same absorbed rows as one stretch."""
    rng = random.Random(4)
    for _ in range(200):
        words = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(2, 14)))
        ids = rng.sample(range(100), len(words))

        def leaves(cuts):
            rows, forests = [], []
            for a, z in zip([0, *cuts], [*cuts, len(words)]):
                parts = [prefix_trie.Component(ids[i], len(words[i])) for i in range(a, z)]
                runs, out = prefix_trie.contract(parts, [edge(i) for i in range(a, z - 1)], prefix_trie.UNKNOWN, prefix_trie.UNKNOWN)
                rows += out
                forests.append(runs)
            parts, edges = [], []
            for k, runs in enumerate(forests):
                if k:
                    edges.append(edge(cuts[k - 1] - 1))
                for r in runs:
                    parts += r.parts
                    edges += r.edges
            runs, out = prefix_trie.contract(parts, edges, prefix_trie.APART, prefix_trie.APART)
            moved = {(r["conv"], r["depth"]): r["into"] for r in out}
            for r in rows:
                r["into"] = moved.get((r["into"], r["depth"]), r["into"])
            return sorted(map(repr, rows + out)), len(runs)

        def edge(i):
            common = next((k for k, (x, y) in enumerate(zip(words[i], words[i + 1])) if x != y), min(len(words[i]), len(words[i + 1])))
            return common, 10 * common

        cuts = sorted(rng.sample(range(1, len(words)), rng.randrange(len(words))))
        assert leaves(cuts) == leaves([])


# --- nearest neighbours ------------------------------------------------------

def vectors(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return df.selectExpr("*", "1 AS id", "2 AS v", "'x' AS k1", "0 AS rank", "5 AS list", "'l' AS label")


def brute_nearest(rows, every=20, count=20):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q is not None and q % every == 0:
            near = sorted(((-sum(np.float64(a) * np.float64(b) for a, b in zip(v, w)), i) for i, w in rows if i != q),
                          key=lambda e: (e[0], e[1] is None, e[1] or 0))
            out[q] = [(i, -s) for s, i in near[:count]]
    return out


def test_all_lists_searched_equals_brute_force(spark):
    """Few rows stand in one list, so the result is exact: copies, ties, nulls, zero and broken vectors."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.1, 1, 9])]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(i, [1.0] + [0.0] * 7) for i in range(300, 310)]
    rows += [(400, None), (420, [0.0] * 8), (440, [None] + [1.0] * 7), (460, [float("nan")] + [1.0] * 7), (480, [float("inf")] + [1.0] * 7),
             (500, []), (520, [1.0]), (None, rows[5][1])]
    want = brute_nearest([r for r in rows if r[1] is None or len(r[1]) == 8])
    got = {}
    for r in sorted(nearest(vectors(spark, rows + rows[:5])).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-12, atol=1e-12)


def test_neighbours_of_tiny_tables(spark):
    assert nearest(vectors(spark, [])).collect() == []
    assert nearest(vectors(spark, [(0, None), (20, [0.0, 0.0])])).collect() == []
    assert nearest(vectors(spark, [(0, [1.0, 0.0])])).collect() == []
    assert [tuple(r) for r in nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [2.0, 1.0])])).collect()] == [(0, 1, 1, 2.0)]


def test_recall_with_many_lists(spark, monkeypatch):
    """64 lists, long ones in chunks: recall at least 0.9 with a part of the lists searched, and full result rows."""
    monkeypatch.setattr(postings, "LIST", 48)
    monkeypatch.setattr(postings, "CHUNK", 100)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 0.5) * rng.uniform(0.5, 2, size=(4000, 1))
    ratio, measure = [], postings.measured_ratio
    monkeypatch.setattr(postings, "measured_ratio", lambda *a: ratio.append(measure(*a)) or ratio[-1])
    got = {}
    for r in nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)], "array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 200 and all(len(f) == 20 for f in got.values()) and hits / 4000 >= 0.9


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    points, x = rng.normal(size=(700, 12)), rng.normal(size=(50, 12))
    ids, _ = postings.Graph.over(points).walk(x, 64)
    true = np.argsort(((x[:, None] - points[None]) ** 2).sum(axis=2), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids.tolist(), true.tolist())]) > 0.95


# --- whitening -----------------------------------------------------------------

def check_whitened(spark, rows, kind="array<float>", count=16):
    found = whiten(vectors(spark, rows, kind), count=count).collect()
    use = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in use])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(count, int((value > 1e-9 * value[0]).sum()))
    assert len(found) == k * len(use)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
    for (i, _), row in zip(use, x):
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(row, sums))
        assert all(r["deviation"] == deviation for r in got[i].values())
    return found, fit, value, vector, x, use, got


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [(900 + i, [float(np.float32(c)) for c in x[3]]) for i in range(50)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [])]
    found, fit, value, vector, x, use, got = check_whitened(spark, rows, count=8)
    for c in range(8):
        want = (x - fit.mean(axis=0)) @ vector[:, c] / np.sqrt(value[c])
        have = np.array([got[i][c + 1]["whitened"] for i, _ in use])
        assert np.allclose(have * np.sign(have[0]), want * np.sign(want[0]), atol=1e-8)
        assert np.isclose(got[0][c + 1]["explained"], value[c] / value.sum(), rtol=1e-9)


def test_whitening_of_repeated_missing_and_close_eigenvalues(spark):
    """A cross has one eigenvalue four times; flat directions have none; two of the others differ by one part in 10^9."""
    cross = [(2 * d + (s > 0), [s * float(e == d) for e in range(4)]) for d in range(4) for s in (-1.0, 1.0)]
    check_whitened(spark, cross)
    check_whitened(spark, [(i, v + [3.0, -1.0]) for i, v in cross])
    near = [(i, [float(v) for v in r]) for i, r in enumerate([[30000, 0], [-30000, 0], [0, 30000.015625], [0, -30000.015625], [0, 0]])]
    check_whitened(spark, near, "array<double>")


def test_whitening_without_spread_and_of_huge_entries(spark):
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    found = whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0]), (None, [0.0, 0.5])], "array<double>")).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3, None} and {r["component"] for r in found} == {1, 2}
    assert {r["deviation"] for r in found if r["vec_id"] == 1} == {None}


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-1000, 1000, size=(6, 4)).astype(object)
    m = (a @ a.T).tolist()  # rank 4: two roots at zero
    f = whitening.characteristic_polynomial(spark, m)

    def det(rows):
        rows, out = [[Fraction(v) for v in r] for r in rows], Fraction(1)
        for i in range(len(rows)):
            at = next((k for k in range(i, len(rows)) if rows[k][i]), None)
            if at is None:
                return 0
            if at != i:
                rows[i], rows[at], out = rows[at], rows[i], -out
            out *= rows[i][i]
            for k in range(i + 1, len(rows)):
                by = rows[k][i] / rows[i][i]
                rows[k] = [x - by * y for x, y in zip(rows[k], rows[i])]
        return out

    for x in (0, 1, -5, 10 ** 6):
        assert sum(c * x ** k for k, c in enumerate(f)) == det([[x * (i == j) - m[i][j] for j in range(6)] for i in range(6)])
    assert sum(times for *_, times in whitening.largest_roots(f, 9)) == 4


def test_cross_sums_are_exact_beyond_doubles():
    rng = np.random.default_rng(7)
    y = rng.integers(-(2 ** 56), 2 ** 56, size=(50, 3))
    want = y.astype(object).T @ y.astype(object)
    assert whitening.cross_sums(y).reshape(3, 3).tolist() == want.tolist()
    assert whitening.column_sums(y).tolist() == y.astype(object).sum(axis=0).tolist()
