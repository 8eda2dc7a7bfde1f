"""Conversation prefix trie by splitters and their skeleton.

A conversation is the sequence of its turns' digests (SHA-256 of role and text), its *path*; a trie node is a
distinct prefix of paths.  Conversations are ordered by (path, id) and cut into shards at sampled *splitters*.

**Skeleton.**  A node whose members stand in more than one shard is a prefix of a splitter's path: between two members of it on either side of a splitter
nothing but members can stand.  So the trie of the splitter paths, the skeleton, holds every such node.  It is broadcast;
its size is bounded by ``SKELETON_BYTES`` (splitters are thinned out until it fits).

**Shards.**  Every shard is sorted and walked once with a stack of open nodes.  Nodes outside the skeleton are finished there and then;
skeleton nodes leave a partial aggregate a shard.  Equal paths are cut by id, so a conversation or first turn that a
third of all rows share is spread over shards like any other.

**Reduction.**  Partials are summed per skeleton node, then folded from the leaves of the skeleton to its root (bounded by
the skeleton's size).  The ids that end at a skeleton node come as chunks of a few thousand; they are hashed in order as a stream, so no task holds them
together.  (One SHA-256 over all of them is sequential by definition: a hot node's ids, and nothing else, pass through one task.)

Defined results: a NULL role or text is empty; turns are ordered by turn (NULL first), equal turns by the digest of role and text; rows that repeat a turn
are turns of their own; rows with a NULL id belong to no conversation and are left out; an empty table gives no
nodes; other columns are not read.  Ids are integers.  A conversation's digests (32 bytes a turn) must fit a row, as a text does; its texts never travel.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlens.llm.common import staged, unstage

# Every conversation takes its first turns from the first of its hundred.
SHARED, HEADS = 100, 6
# Bytes of a turn's digest in a path.
STEP = 32
# Conversations of a shard, sampled conversations for each splitter, bytes of the sample and of the broadcast skeleton.
SHARD_ROWS = 50_000
SAMPLED = 20
SAMPLE_BYTES = 64 << 20
SKELETON_BYTES = 16 << 20
# Ids that end at a skeleton node, in one row.
CHUNK = 4096

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NONE_SHA = hashlib.sha256(b"").hexdigest()
# A finished node (kind 0; ``parent`` names its parent where that is a skeleton node), a skeleton node's partial (1) or ids that end there (2).
FOUND = ("kind int, node int, parent int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, points long, ends_sha256 string, chunk string")
ARROW = pa.schema([("kind", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()),
                   *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "points")),
                   ("ends_sha256", pa.string()), ("chunk", pa.string())])


def _ordered_turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turns): each conversation's turns in order, as (turn, digest, points)."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.length(text).alias("points"))
    return rows.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")) \
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuild(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, path, points) of every conversation, its first turns taken from the first of its hundred.

    ``h`` turns, CRC-32 of the id mod ``HEADS``, come from there, and the conversation's own turns after its first ``h`` follow.
    """
    own = _ordered_turns(rows, id_col, turn_col, role_col, text_col)
    heads = own.where(F.col("id") % SHARED == 0).select(F.col("id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumn("base", F.col("id") - F.col("id") % SHARED).join(heads, "base", "left").withColumn("h", h)
    none = F.array().cast(both.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return _paths(both.select("id", turns.alias("turns")))


def plain_paths(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, path, points) of every conversation as it stands."""
    return _paths(_ordered_turns(rows, id_col, turn_col, role_col, text_col))


def _paths(turns: DataFrame) -> DataFrame:
    return turns.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
                        F.transform("turns", lambda t: t["points"]).alias("points"))


class Skeleton:
    """Splitters, sorted, and the trie of their paths: prefix -> number."""

    def __init__(self, splitters: list[tuple[bytes, int]], limit: int = SKELETON_BYTES):
        self.splitters = splitters
        while True:
            self.nodes = {b"": 0}
            for path, _ in self.splitters:
                for end in range(STEP, len(path) + 1, STEP):
                    self.nodes.setdefault(path[:end], len(self.nodes))
            if len(self.splitters) < 2 or sum(map(len, self.nodes)) + sum(len(p) for p, _ in self.splitters) <= limit:
                break
            self.splitters = self.splitters[1::2]

    def shard(self, path: bytes, id_: int) -> int:
        return bisect.bisect_right(self.splitters, (path, id_))

    def parents(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth), deepest first; the root's parent is -1."""
        of = [(n, self.nodes[p[:-STEP]] if p else -1, len(p) // STEP) for p, n in self.nodes.items()]
        return sorted(of, key=lambda x: -x[2])


def _splitters(paths: DataFrame, count: int, total: int, n: int) -> list[tuple[bytes, int]]:
    wanted = min(SAMPLED * count, max(count, SAMPLE_BYTES * n // max(total, 1)))
    some = paths.select("path", "id").sample(False, min(1.0, wanted / n), seed=7).collect()  # bounded by SAMPLE_BYTES on average
    keys = sorted((bytes(r["path"]), r["id"]) for r in some)
    at = sorted({len(keys) * i // count for i in range(1, count)})
    return sorted({keys[i] for i in at if i < len(keys)})


class _Open:
    """A node on the walk's stack."""

    __slots__ = ("skeleton", "points", "least", "convs", "children", "leaves", "saved", "sha", "ends", "waiting")

    def __init__(self, skeleton: int | None, points: int):
        self.skeleton, self.points = skeleton, points
        self.least: int | None = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.sha = None  # of the ids that end here
        self.ends: list[int] = []  # the same for a skeleton node, until they are handed on
        self.waiting: list[tuple] = []  # finished children, until this node's smallest member is known


class Walk:
    """Finishes the nodes of shards whose conversations come in order; rows of FOUND gather in ``out``."""

    def __init__(self, nodes: dict[bytes, int]):
        self.nodes = nodes
        self.out: list[tuple] = []
        self.stack: list[_Open] = []
        self.shard: int | None = None
        self.path = b""

    def add(self, shard: int, path: bytes, id_: int, points: list[int]) -> None:
        if shard != self.shard:
            self.close(0)
            self.shard, self.path, self.stack = shard, b"", [_Open(0, 0)]
        same, most = 0, min(len(path), len(self.path)) // STEP
        while same < most and path[same * STEP:(same + 1) * STEP] == self.path[same * STEP:(same + 1) * STEP]:
            same += 1
        self.close(same + 1)
        for d in range(same + 1, len(path) // STEP + 1):
            # below a node outside the skeleton nothing is in it
            inside = self.stack[-1].skeleton is not None
            self.stack.append(_Open(self.nodes.get(path[:d * STEP]) if inside else None, points[d - 1]))
        self.path = path
        top = self.stack[-1]
        top.convs += 1
        top.least = id_ if top.least is None else min(top.least, id_)
        if top.skeleton is None:
            first = top.sha is None
            top.sha = top.sha or hashlib.sha256()
            top.sha.update(str(id_).encode() if first else b",%d" % id_)
        else:
            top.ends.append(id_)
            if len(top.ends) >= CHUNK:
                self._hand_on(top)

    def close(self, depth: int) -> None:
        """Closes open nodes down to ``depth``, that one included."""
        while len(self.stack) > depth:
            at = len(self.stack) - 1
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if node.skeleton is not None:
                self._hand_on(node)
                self.out.append((1, node.skeleton, None, node.least, at, None, node.convs, node.children, node.leaves, node.saved, node.points, None, None))
            else:
                leaves = node.leaves or 1
                saved = node.saved + (node.convs - 1) * node.points
                for child in node.waiting:
                    self.out.append((*child[:5], node.least, *child[6:]))
                row = (0, None, above.skeleton, node.least, at, None, node.convs, node.children, leaves, saved, node.points,
                       node.sha.hexdigest() if node.sha else NONE_SHA, None)
                (self.out if above.skeleton is not None else above.waiting).append(row)
                above.children += 1
                above.leaves += leaves
                above.saved += saved
            if above is not None:
                above.convs += node.convs
                above.least = node.least if above.least is None else min(above.least, node.least)

    def _hand_on(self, node: _Open) -> None:
        if node.ends:
            self.out.append((2, node.skeleton, None, node.ends[0], *[None] * 8, ",".join(map(str, node.ends))))
            node.ends = []


def _finish(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(skeleton.value.nodes)

        def handed() -> pa.RecordBatch:
            rows, walk.out = walk.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                walk.add(*(v.as_py() for v in row))
                if len(walk.out) >= 10_000:
                    yield handed()
        walk.close(0)
        if walk.out:
            yield handed()

    return run


def _sharded(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shards = pa.array([skeleton.value.shard(p, i) for p, i in zip(paths, ids, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([shards, batch.column(1), batch.column(0), batch.column(2)], ["shard", "path", "id", "points"])

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from chunks that come in order: one running hash, whatever the number of ids."""
    now, sha = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for node, chunk in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if node != now:
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(chunk.as_py().encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["node", "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])


def _folded(skeleton: Skeleton, sums: dict[int, dict], ends: dict[int, str]) -> list[tuple]:
    """The skeleton's nodes as rows of (node, *NODE), their partials folded from the deepest up."""
    order = [x for x in skeleton.parents() if x[0] in sums]
    for node, parent, _ in order:
        own = sums[node]
        own["leaves"] = own["leaves"] or 1
        own["saved"] += (own["convs"] - 1) * own["points"]
        if parent >= 0:
            sums[parent]["children"] += 1
            sums[parent]["leaves"] += own["leaves"]
            sums[parent]["saved"] += own["saved"]
    return [(node, s["least"], depth, sums[parent]["least"] if parent >= 0 else None, s["convs"], s["children"], s["leaves"], s["saved"],
             ends.get(node, NONE_SHA)) for node, parent, depth in order for s in (sums[node],)]


def trie(paths: DataFrame, shards: int | None = None, skeleton_bytes: int = SKELETON_BYTES) -> DataFrame:
    """Every node of the trie of ``paths`` (id, path, points; ids distinct): a row of NODE each; see the module's docstring."""
    spark = paths.sparkSession
    held = staged(paths, "paths")
    n, total = held.agg(F.count(F.lit(1)), F.sum(F.length("path") + 8)).first()
    if not n:
        unstage(held)
        return spark.createDataFrame([], _node_schema())
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ROWS))
    skeleton = Skeleton(_splitters(held, count, total, n), skeleton_bytes)
    shared = spark.sparkContext.broadcast(skeleton)  # at most skeleton_bytes
    rows = held.mapInArrow(_sharded(shared), "shard int, path binary, id long, points array<int>")
    rows = rows.repartition(count, "shard").sortWithinPartitions("shard", "path", "id")
    found = staged(rows.mapInArrow(_finish(shared), FOUND), "nodes")
    unstage(held)
    sums = found.where("kind = 1").groupBy("node").agg(
        F.min("conv_id").alias("least"), *(F.sum(c).alias(a) for c, a in (("n_convs", "convs"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))),
        F.max("points").alias("points"))
    chunks = found.where("kind = 2").select(F.col("node").cast("long").alias("node"), F.col("conv_id").alias("first"), "chunk")
    ends = chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash_ends, "node long, ends_sha256 string")
    # both collects: one small row for each skeleton node
    top = _folded(skeleton, {r["node"]: r.asDict() for r in sums.collect()}, {r["node"]: r["ends_sha256"] for r in ends.collect()})
    upper = spark.createDataFrame(top, "node int, " + _node_schema())
    above = F.broadcast(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))  # bounded as the skeleton
    lower = found.where("kind = 0").drop("node", "kind", "points", "chunk").join(above, "parent", "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return lower.select(NODE).unionByName(upper.select(NODE))


def _node_schema() -> str:
    return ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)
