"""Conversation prefix trie by union-find over sorted neighbours.

Every conversation is a string of turn keys (20 characters a turn).  Sorted
by that string, conversations with a common prefix stand together, and the
common length of two neighbours (in turns) is an edge between them.

1. Edges are taken in descending depth.  Components that meet at depth d are
   the subtrees of a branching node there: the one with the smallest
   conversation goes on, the others end at d and leave one row each
   ("absorbed"), with what their subtree sums to.  A node is thus named by
   its smallest conversation and its depth, and a conversation owns the
   depths below the one at which it was absorbed.
2. Each range partition does that for itself.  A component that touches the
   partition's edge is open at depths up to which its neighbours beyond may
   share; closed components that meet one another melt into a stand-in,
   open ones stay.  What is left is the partition's contracted forest: at
   most one stand-in per depth on either side.
3. Contracted forests of neighbouring partitions are merged in blocks, by
   the same rules, until one block is left.  A stand-in that is itself
   absorbed at the depth at which it absorbed hands its rows on.
4. Sums over subtrees become running sums along each conversation's own
   depths, and the owned turns become nodes.

A conversation is held in pieces of ``PIECE`` turns.  Conversations that
share a whole piece are told apart by their next pieces, in a round of the same
steps that ends in one component per shared piece.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import small_side, stored
from revlens.operators.ranking import rank_within

#: Characters of a turn key, turns of a piece, and partitions merged at a time.
KEY, PIECE, BLOCK = 20, 256, 16
#: Common depth with what lies beyond an end that nobody has looked at, and of classes side by side.
UNKNOWN, APART = 1 << 62, -1
#: Bytes of joined ids that travel as one row.
CHUNK = 1 << 16

OUT = ("kind string, pid long, forest string, class long, conv long, into long, depth long, shared long, "
       "size long, leaves long, own_leaf long, saved long, turns long")


@dataclass
class Component:
    """A component: its smallest conversation and the sums of what that conversation absorbed.

    ``gain`` sums, over absorbed subtrees, their size times their shared bytes
    plus what they save themselves.  The fields ``last_*`` hold what was absorbed
    at depth ``at``, the latest one: if the component is absorbed at that same depth, they are handed on."""

    conv: int
    turns: int
    size: int = 1
    leaves: int = 0
    gain: int = 0
    own_leaf: int = 1
    at: int = UNKNOWN
    last_size: int = 0
    last_leaves: int = 0
    last_gain: int = 0
    last_child: int = 0

    def reach(self, depth: int) -> None:
        """Go up to ``depth``: what was absorbed further down is the component's own now."""
        if self.at != depth:
            self.size, self.leaves, self.gain = self.size + self.last_size, self.leaves + self.last_leaves, self.gain + self.last_gain
            if self.last_child and self.at == self.turns:
                self.own_leaf = 0
            self.at, self.last_size, self.last_leaves, self.last_gain, self.last_child = depth, 0, 0, 0, 0

    def absorb(self, other: Component, depth: int, shared: int) -> dict:
        """Take ``other`` in at ``depth``, where both share ``shared`` bytes; the row that ``other`` leaves."""
        child = int(other.turns > depth)
        leaves = child * (other.leaves + other.own_leaf)
        saved = other.gain - (other.size - 1) * shared
        self.last_size += other.size + other.last_size
        self.last_leaves += leaves + other.last_leaves
        self.last_gain += other.size * shared + saved + other.last_gain
        self.last_child |= child | other.last_child
        return {"kind": "absorbed", "conv": other.conv, "into": self.conv, "depth": depth, "shared": shared, "size": other.size,
                "leaves": leaves, "own_leaf": other.own_leaf, "saved": saved, "turns": other.turns}


@dataclass
class Run:
    """Neighbours that are connected: what is left of them in order, and (depth, bytes) between those."""

    parts: list[Component]
    edges: list[tuple[int, int]] = field(default_factory=list)
    first: bool = False
    last: bool = False


def contract(parts: list[Component], edges: list[tuple[int, int]], left: int, right: int) -> tuple[list[Run], list[dict]]:
    """Union-find over the edges (depth, bytes) between neighbours, deepest first.

    ``left`` and ``right`` are the common depths with what lies beyond the
    ends; a run that touches an end is open above that depth and keeps its parts.  Returns the
    runs at depth 0 (one a class) and the rows of absorbed components."""
    n, rows = len(parts), []
    head = list(range(n))
    runs = [Run([p], first=i == 0, last=i == n - 1) for i, p in enumerate(parts)]

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    by_depth: dict[int, list[int]] = {}
    for i, (depth, _) in enumerate(edges):
        by_depth.setdefault(depth, []).append(i)
    for depth in sorted((d for d in by_depth if d > APART), reverse=True):
        meeting: dict[int, list[int]] = {}
        for i in by_depth[depth]:  # in order: a chain's first run is its head
            a, b = find(i), find(i + 1)
            meeting.setdefault(a, [a]).append(b)
            head[b] = a
        for a, chain in meeting.items():
            shared = edges[chain[1] - 1][1]
            met = [runs[r] for r in chain]
            stays = [(r.first and left > depth) or (r.last and right > depth) for r in met]
            closed = [r.parts[0] for r, keeps in zip(met, stays) if not keeps]
            for c in closed:
                c.reach(depth)
            best = min(closed, key=lambda c: c.conv, default=None)
            rows.extend(best.absorb(c, depth, shared) for c in closed if c is not best)
            whole, placed = Run([], first=met[0].first, last=met[-1].last), False
            for r, keeps in zip(met, stays):
                if not keeps and placed:
                    continue
                placed |= not keeps
                if whole.parts:
                    whole.edges.append((depth, shared))
                whole.parts += r.parts if keeps else [best]
                whole.edges += r.edges if keeps else []
            runs[a] = whole
    return [runs[i] for i in range(n) if find(i) == i], rows


def common_turns(a: str, b: str) -> int:
    """Turns that two key strings have in common from their start."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[:KEY * high] == b[:KEY * high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a.startswith(b[:KEY * mid]) else (low, mid)
    return low


def _edge(before: dict, after: dict, base: int) -> tuple[int, int]:
    """(depth, bytes) that two neighbouring conversations share."""
    if before["class"] != after["class"]:
        return APART, 0
    common = common_turns(before["keys"], after["keys"])
    return base + common, before["sums"][common - 1] if common else before["below"]


def _closed_forest(pid: int, parts: list, edges: list, first: dict, last: dict, alone: bool) -> list[dict]:
    """Output rows of a contracted stretch: absorbed ones, finished classes, and its forest if more lies beside it."""
    end = APART if alone else UNKNOWN
    runs, rows = contract(parts, edges, end, end)
    for run in runs:  # none with parts of several classes
        if not (run.first or run.last) or alone:
            run.parts[0].reach(APART)
            c = run.parts[0]
            rows.append({"kind": "finished", "forest": json.dumps(astuple(c)), "conv": c.conv, "own_leaf": c.own_leaf, "turns": c.turns})
    if not alone:
        parts, edges = [], []
        for run in runs:
            if run.first or run.last:
                if parts:
                    edges.append((APART, 0))
                parts += [astuple(p) for p in run.parts]
                edges += run.edges
        rows.append({"kind": "forest", "pid": pid, "forest": json.dumps({"parts": parts, "edges": edges, "first": first, "last": last})})
    return rows


def _batches(rows: list[dict]):
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in OUT.split(", "))])
    for k in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_pylist(rows[k:k + 50_000], schema=schema)


def _partition_forest(base: int):
    """mapInArrow body over a sorted partition (class, conv, keys, sums, below, turns, part)."""
    def run(batches):
        parts, edges, first, last = [], [], None, None
        for b in batches:
            for row in b.to_pylist():
                if last is None:
                    first = row
                else:
                    edges.append(_edge(last, row, base))
                parts.append(Component(*json.loads(row["part"])) if row["part"] else Component(row["conv"], row["turns"]))
                last = row
        if parts:
            ends = [{k: r[k] for k in ("class", "keys", "sums", "below")} for r in (first, last)]
            yield from _batches(_closed_forest(TaskContext.get().partitionId(), parts, edges, *ends, alone=False))

    return run


def _merged_forests(base: int, alone: bool):
    """mapInArrow body over forests sorted by (block, pid): each block's forests become one."""
    def merged(block, forests):
        parts, edges = [], []
        for i, f in enumerate(forests):
            if i:
                edges.append(_edge(forests[i - 1]["last"], f["first"], base))
            parts += [Component(*p) for p in f["parts"]]
            edges += [tuple(e) for e in f["edges"]]
        return _closed_forest(block, parts, edges, forests[0]["first"], forests[-1]["last"], alone)

    def run(batches):
        block, forests = None, []
        for b in batches:
            for here, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if here != block and forests:
                    yield from _batches(merged(block, forests))
                    forests = []
                block = here
                forests.append(json.loads(text))
        if forests:
            yield from _batches(merged(block, forests))

    return run


def merge_tree(rows: DataFrame, pieces: DataFrame, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """(absorbed rows with their true ``into``, finished components with their class) of ``rows``.

    ``rows``: class, conv, keys, sums, below, turns of the ``level``-th piece."""
    spark, base = rows.sparkSession, level * PIECE
    deeper = None
    whole = rows.where(F.length("keys") == KEY * PIECE)
    twice = stored(whole.groupBy("class", "keys").agg(F.min("conv").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = rows.withColumn("part", F.lit(None).cast("string"))
    if twice.limit(1).count():  # conversations that share a whole piece: one component each from here on
        members = whole.join(twice.select("class", "keys", "next"), ["class", "keys"])
        after = pieces.where(F.col("piece") == level + 1).select("conv", F.col("keys").alias("k"), F.col("sums").alias("s"))
        following = members.join(after, "conv", "left").select(
            F.col("next").alias("class"), "conv", F.coalesce("k", F.lit("")).alias("keys"),
            F.coalesce("s", F.array().cast("array<long>")).alias("sums"), F.element_at("sums", -1).alias("below"), "turns")
        deeper, finished = merge_tree(stored(following), pieces, level + 1)
        shared = twice.join(finished.select("conv", F.col("forest").alias("part"), F.col("turns").alias("t")), F.col("next") == F.col("conv"))
        one = members.where(F.col("conv") == F.col("next")).select("conv", "class", "keys", "sums", "below")
        one = one.join(shared.select("conv", "part", F.col("t").alias("turns")), "conv")
        rows = rows.join(twice.select("class", "keys"), ["class", "keys"], "left_anti").unionByName(one)
    order = ["class", "keys", "conv"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (stored(rows.select("class", "conv", "keys", "sums", "below", "turns", "part"))
                   .repartitionByRange(n, *order).sortWithinPartitions(*order))
    found = [stored(sorted_rows.mapInArrow(_partition_forest(base), OUT))]
    blocks, jumps = n, 0
    while blocks > 1 or not jumps:
        blocks, jumps = -(-blocks // BLOCK), jumps + 1
        forests = found[-1].where("kind = 'forest'").select(F.floor(F.col("pid") / BLOCK).alias("pid"), F.col("pid").alias("at"), "forest")
        found.append(stored(forests.repartition("pid").sortWithinPartitions("pid", "at")
                            .mapInArrow(_merged_forests(base, alone=blocks == 1), OUT)))
    absorbed = [f.where("kind = 'absorbed'").drop("kind", "pid", "forest", "class") for f in found]
    moved = absorbed[1]
    for f in absorbed[2:]:
        moved = moved.unionByName(f)
    # a stand-in that was absorbed where it absorbed hands its rows to who took it, at most one block level at a time
    moved = stored(moved)
    to = moved.select(F.col("conv").alias("was"), F.col("depth").alias("d"), F.col("into").alias("now"))
    to = small_side(to, 100_000)
    out = absorbed[0].unionByName(moved)
    for _ in range(jumps):
        out = (out.join(to, (F.col("into") == F.col("was")) & (F.col("depth") == F.col("d")), "left")
               .withColumn("into", F.coalesce("now", "into")).drop("was", "d", "now"))
    finished = found[0]
    for f in found[1:]:
        finished = finished.unionByName(f)
    finished = finished.where("kind = 'finished'").select("conv", "forest", "own_leaf", "turns")
    return out.unionByName(deeper) if deeper is not None else out, finished


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, pos, key, bytes, turns): the rebuilt conversations; one row with null pos where there are no turns.

    The first h turns of a conversation are those of the one at the next multiple of five below
    (h from the id's crc32), the rest its own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.base64(F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, KEY * 3 // 4))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    rows = stored(rank_within(rows, ["conv"], [F.col("turn").asc_nulls_first(), "key"], pos="pos", size="n").select("conv", "pos", "n", "key", "bytes"))
    convs = rows.where("pos = 0").select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"),
                                         (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("m"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    convs = stored(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = rows.where("pos < 8").select(F.col("conv").alias("base"), "pos", "key", "bytes")
    head = convs.join(heads, "base").where("pos < h").select("conv", "pos", "key", "bytes", "turns")
    tail = rows.join(convs.select("conv", "h", "taken", "turns"), "conv").where("pos >= h").select(
        "conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "key", "bytes", "turns")
    none = convs.where("turns = 0").select("conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"),
                                           F.lit(None).cast("long").alias("bytes"), "turns")
    return head.unionByName(tail).unionByName(none)


def in_pieces(turns: DataFrame) -> DataFrame:
    """(conv, piece, keys, sums, below, turns): up to PIECE turns a row, with running sums of bytes from the first turn on."""
    piece = F.coalesce(F.floor(F.col("pos") / PIECE), F.lit(0)).alias("piece")
    rows = turns.groupBy("conv", piece, "turns").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "bytes")))).alias("e"))
    total = F.aggregate("e", F.lit(0).cast("long"), lambda s, e: s + e["bytes"])
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum(total).over(before), F.lit(0)))
    sums = F.aggregate("e", F.array("below"), lambda s, e: F.concat(s, F.array(F.element_at(s, -1) + e["bytes"])))
    return rows.select("conv", "piece", F.array_join(F.transform("e", lambda e: e["key"]), "").alias("keys"),
                       F.slice(sums, 2, PIECE).alias("sums"), "below", "turns")


def _joined_ids(batches):
    """mapInArrow body over ends sorted by (conv, depth, member): ids of a node joined into rows of bounded size."""
    key, first, text = None, 0, []
    size = 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, first, ",".join(text))], names=["conv", "depth", "first", "ids"])

    out = []
    for b in batches:
        for conv, depth, member in zip(*(c.to_pylist() for c in b.columns)):
            if (conv, depth) != key or size > CHUNK:
                if key is not None:
                    out.append((*key, first, ",".join(text)))
                key, first, text, size = (conv, depth), member, [], 0
            text.append(str(member))
            size += len(text[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv", "depth", "first", "ids"])
            out = []
    if key is not None:
        yield row()


def _hashed_ids(batches):
    """mapInArrow body over joined ids sorted by (conv, depth, first): one hash a node, fed row by row."""
    key, state, out = None, None, []
    for b in batches:
        for conv, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if (conv, depth) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (conv, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv", "depth", "ends"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["conv", "depth", "ends"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends): hash of each node's member ids in order; no node's ids are held at once."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = (ends.select("conv", "depth", "member").repartitionByRange(n, "conv", "depth", "member")
              .sortWithinPartitions("conv", "depth", "member").mapInArrow(_joined_ids, "conv long, depth long, first long, ids string"))
    return (joined.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
            .mapInArrow(_hashed_ids, "conv long, depth long, ends string"))


def _block(depth: Column) -> Column:
    return F.floor(depth / PIECE)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per distinct prefix.

    Rows with a null conv_id belong to no conversation and are left out.  Turns are ordered null first;
    equal turn numbers by a hash of role and text, so repeated rows are further turns.  Null role or text
    is empty.  Other columns are ignored.  An empty table has no node, not even a root."""
    pieces = stored(in_pieces(rebuilt(conversations)))
    first = pieces.where("piece = 0").select(F.lit(0).cast("long").alias("class"), "conv", "keys", "sums", "below", "turns")
    absorbed, finished = merge_tree(first, pieces)
    root = finished.select("conv", F.lit(None).cast("long").alias("into"), F.lit(APART).cast("long").alias("depth"), "own_leaf", "turns")
    absorbed = stored(absorbed)
    owners = stored(absorbed.select("conv", "into", "depth", "own_leaf", "turns").unionByName(root))

    sums = absorbed.groupBy(F.col("into").alias("conv"), F.col("depth").alias("high")).agg(
        F.sum("size").alias("size"), F.sum("leaves").alias("leaves"), F.sum(F.col("size") * F.col("shared") + F.col("saved")).alias("gain"),
        F.count_if(F.col("turns") > F.col("depth")).alias("kids"))
    down = Window.partitionBy("conv").orderBy(F.desc("high"))
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    spans = sums.select("conv", "high", "kids", F.coalesce(F.lead("high").over(down), F.lit(APART)).alias("low"),
                        *[F.sum(c).over(so_far).alias(c) for c in ("size", "leaves", "gain")])
    spans = spans.withColumn("block", F.explode(F.sequence(_block(F.col("low") + 1), _block(F.col("high")))))

    owned = pieces.join(owners.select("conv", "into", F.col("depth").alias("top"), "own_leaf"), "conv")
    owned = owned.where((F.col("turns") > F.col("top")) & ((F.col("piece") + 1) * PIECE > F.col("top")))
    start = F.col("piece") * PIECE
    steps = F.transform("sums", lambda s, i: F.struct(
        (start + i + 1).alias("depth"), F.when(i == 0, F.col("below")).otherwise(F.get("sums", i - 1)).alias("above")))
    steps = F.when((F.col("top") == APART) & (F.col("piece") == 0), F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("above"))), steps)).otherwise(steps)
    nodes = owned.select("conv", "into", "top", "own_leaf", "turns", F.explode(steps).alias("n")).select("*", "n.*").drop("n")
    nodes = nodes.where(F.col("depth") > F.col("top")).withColumn("block", _block(F.col("depth")))
    nodes = nodes.alias("a").join(spans.alias("b"), (F.col("a.conv") == F.col("b.conv")) & (F.col("a.block") == F.col("b.block"))
                                  & (F.col("a.depth") > F.col("b.low")) & (F.col("a.depth") <= F.col("b.high")), "left")
    zero = F.lit(0).cast("long")
    nodes = nodes.select(
        F.col("a.conv").alias("conv_id"), F.col("a.depth").alias("depth"),
        F.when(F.col("a.depth") == 0, F.lit(None)).when(F.col("a.depth") == F.col("top") + 1, F.col("into")).otherwise(F.col("a.conv")).alias("parent_conv_id"),
        (F.coalesce("size", zero) + 1).alias("n_convs"),
        (F.when(F.col("turns") > F.col("a.depth"), 1).otherwise(0) + F.when(F.col("a.depth") == F.col("high"), F.col("kids")).otherwise(0)).cast("long").alias("n_children"),
        (F.col("own_leaf") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.coalesce("gain", zero) - F.coalesce("size", zero) * F.col("above")).alias("saved_tokens"))
    ends = (absorbed.where("turns = depth").select(F.col("into").alias("conv"), "depth", F.col("conv").alias("member"))
            .unionByName(owners.where("turns > depth").select("conv", F.col("turns").alias("depth"), F.col("conv").alias("member"))))
    hashes = end_hashes(ends)
    out = nodes.join(hashes, (F.col("conv_id") == F.col("conv")) & (nodes["depth"] == hashes["depth"]), "left")
    return out.select("conv_id", nodes["depth"], "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos >= c.h),
p AS (
  SELECT conv_id, list({'role': role, 'text': text}) OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL
  SELECT c.conv_id, [], (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (
  SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = len(path)) AS ends
  FROM p GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (
  SELECT path[1:g.d] AS path, sum((n_children = 0)::BIGINT) AS n_leaves,
    sum(CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].text) ELSE 0 END) AS saved_tokens
  FROM a, unnest(range(depth + 1)) AS g(d) GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN u USING (path) LEFT JOIN n b ON a.depth > 0 AND b.path = a.path[1:a.depth - 1]
"""
