"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

**Codes.**  Iterative quantisation (Gong and Lazebnik) on a bounded sample: vectors are centred and
projected on their principal axes, then a rotation is learned by turns (signs of the rotated sample, then the
orthogonal rotation that brings the sample closest to these signs), and each bit is cut at its median, so bits are balanced.  Several
rotations, from different starts, give as many bits as the tables need.

**Tables.**  The code is cut into substrings of ``bits`` bits, one hash table each (multi-index hashing); every vector is in every
table, and vectors that share a substring meet.  ``bits`` follows the number of vectors, so a bucket holds about one
unrelated vector at any size.  The number of tables is at least what follows from the chance that a pair at the threshold's angle agrees on a
substring.  Centring and cuts lower that chance where vectors share a direction or a loose group is large, so it is also measured, under
the real centring and cuts: tables are added until every kind of sampled pair at the threshold (random partners, partners towards
other vectors, linked pairs of the sample by row and by pair) meets with at least ``recall``.  Where this takes more than the angle says, the
length of a substring is chosen by cost; shorter ones need fewer tables, and with no bits all pairs meet.

**Rerank.**  The vectors of a bucket are compared by cosine in double precision with matrix products.  A pair
is counted in the first table it meets in, so nothing is counted twice and no list of pairs is made: a block of a bucket gives each vector's number
of links and its smallest partner set's root.  Buckets larger than ``BLOCK`` are cut into chunks, and every two chunks are one block, so no
task holds more than two chunks of a hot bucket; nothing is capped.

Identical vectors are one node with a weight and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlens.llm.common import staged, unstage
from seasonlens.llm.components import components

LEAST_COSINE = 0.9
# Expected share of the pairs at the threshold that meet in a table.
RECALL = 0.96
# Bound of the sample that the rotations are learned on.
SAMPLE_ROWS = 10_000
ROUNDS = 30
# Vectors of a bucket that are compared at once.
BLOCK = 256
MAX_BITS = 28
# Sampled pairs of a kind, and sampled vectors whose links are sought.
PAIRS = 2000
LEFT_ROWS = 1000
# Fewer linked pairs in the sample than these tell nothing about a share of 0.96.
LEAST_PAIRS = 25
# Rotations and code bits that are tried for long substrings; shorter ones need fewer.
MAX_PARTS = 128
MAX_COLUMNS = 8192


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Projection (d, d): principal axes times the learned rotation, for centred rows."""
    _, _, axes = np.linalg.svd(x.T @ x)
    v = x @ axes.T
    d = v.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes.T @ r


def plan_tables(n: int, least: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, tables) for n vectors and a threshold, by its angle alone."""
    bits = min(MAX_BITS, max(4, math.ceil(math.log2(max(n, 2)))))
    return bits, angle_tables(bits, least, recall)


def angle_tables(bits: int, least: float, recall: float) -> int:
    """Tables by the threshold's angle alone."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def threshold_pairs(u: np.ndarray, least: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs of unit vectors at the threshold: random partners, partners towards other rows, linked pairs of the rows by pair and by row."""
    rng = np.random.default_rng(seed)
    n, d = u.shape

    def partners(left: np.ndarray, towards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = towards - (towards * left).sum(axis=1, keepdims=True) * left
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        fine = norm[:, 0] > 1e-6
        left = left[fine]
        return left, least * left + math.sqrt(max(0.0, 1 - least * least)) * away[fine] / norm[fine]

    left = u[rng.integers(0, n, PAIRS)]
    kinds = [partners(left, rng.standard_normal((PAIRS, d))), partners(left, u[rng.integers(0, n, PAIRS)])]
    rows = rng.permutation(n)[:LEFT_ROWS]
    # linked pairs in the lowest quarter above the threshold; those above agree more often
    found = []
    for at in range(0, len(rows), BLOCK):
        cosine = u[rows[at:at + BLOCK]] @ u.T
        i, j = np.nonzero((cosine >= least) & (cosine <= least + (1 - least) / 4))
        found.append(np.stack([rows[at + i], j]).astype(np.int32))
    i, j = np.concatenate(found, axis=1)
    if len(i) >= LEAST_PAIRS:
        mixed = rng.permutation(len(i))
        i, j = i[mixed], j[mixed]
        each = np.unique(i, return_index=True)[1]
        kinds += [(u[i[:PAIRS]], u[j[:PAIRS]]), (u[i[each]], u[j[each]])]
    return [k for k in kinds if len(k[0])]


class Codes:
    """Substrings of vectors, planned for ``n`` vectors of which ``sample`` holds some unit rows."""

    def __init__(self, sample: np.ndarray, n: int, least: float, recall: float, seed: int = 7):
        d = sample.shape[1]
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        kinds = threshold_pairs(sample, least, seed)
        parts: list[np.ndarray] = []
        cuts: list[np.ndarray] = []
        same: list[np.ndarray] = []  # whether the pairs agree on the bits of a part

        def grow(columns: int) -> None:
            while len(parts) * d < columns:
                part = learn_rotation(x, seed + len(parts))
                parts.append(part)
                cuts.append(np.median(x @ part, axis=0))
                on = [((v - self.mean) @ part > cuts[-1]) for kind in kinds for v in kind]
                same.append(np.concatenate([a == b for a, b in zip(on[::2], on[1::2], strict=True)]) if on else np.empty((0, d), bool))

        def needed(bits: int) -> int | None:
            """Tables of the bits so far with which every kind of pair meets often enough."""
            if not bits or not kinds:
                return 1
            tables = len(parts) * d // bits
            if not tables:
                return None
            agree = np.concatenate(same, axis=1)[:, :tables * bits].reshape(-1, tables, bits).all(axis=2)
            met = np.logical_or.accumulate(agree, axis=1)
            edge = np.cumsum([0, *(len(k[0]) for k in kinds)])
            enough = np.min([met[a:b].mean(axis=0) for a, b in zip(edge[:-1], edge[1:], strict=True)], axis=0) >= recall
            return int(enough.argmax()) + 1 if enough[-1] else None

        def cost(bits: int, tables: int) -> float:
            """Comparisons a vector; taking a vector to a bucket costs about as much as ``BLOCK`` of them."""
            if not bits:
                return BLOCK + n
            sizes = []
            for t in range(min(8, tables)):
                picked = np.concatenate([(x @ parts[c // d][:, c % d] > cuts[c // d][c % d])[:, None] for c in range(t * bits, (t + 1) * bits)], axis=1)
                count = np.unique(np.packbits(picked, axis=1), axis=0, return_counts=True)[1].astype(float)
                sizes.append((count * (count - 1)).sum() / max(1, len(x) * (len(x) - 1)))
            return tables * (BLOCK + n * float(np.mean(sizes)))

        bits, tables = plan_tables(n, least, recall)
        grow(bits * tables)
        most = needed(bits)
        if most is None or most > tables:
            limit = min(MAX_COLUMNS, MAX_PARTS * d)
            while needed(bits) is None and len(parts) * d < limit:
                grow(min(limit, 2 * len(parts) * d))
            plans = [(b, t) for b in range(bits + 1) if (t := needed(b)) is not None]
            bits, tables = min(plans, key=lambda p: cost(*p))
            if bits:
                tables = max(tables, angle_tables(bits, least, recall))
            grow(bits * tables)
        self.bits, self.tables = bits, tables
        self.projection = np.concatenate(parts, axis=1)[:, :bits * tables]
        self.cut = np.concatenate(cuts)[:bits * tables]

    def pack(self, units: np.ndarray) -> list[bytes]:
        """The code of every row, eight bits a byte."""
        return [row.tobytes() for row in np.packbits((units - self.mean) @ self.projection > self.cut, axis=1)]

    def keys(self, packed: list[bytes]) -> np.ndarray:
        """(rows, tables) substring values of packed codes."""
        size = self.bits * self.tables
        on = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1, count=size)
        return on.reshape(len(packed), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def unit_rows(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=kind).astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _able(v: Column) -> Column:
    """Whether a vector can link: not NULL, all components finite, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _coded(nodes: DataFrame, codes: Codes, kind: str) -> DataFrame:
    """(node, weight, vector, code): a code is computed once, so that a bit at its cut is the same wherever it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                packed = codes.pack(unit_rows(part.column(2).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], ["node", "weight", "vector", "code"])

    return staged(nodes.select("node", "weight", "vector").mapInArrow(run, "node long, weight long, vector binary, code binary"), "codes")


def _block_rows(nodes: DataFrame, codes: Codes) -> tuple[DataFrame, DataFrame]:
    """Staged keys, and (table, key, left, right, side, node, weight, vector, code): every member of every bucket of two or more, once for each block it is in."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = codes.keys(part.column(1).to_pylist())
                n, m = keys.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(keys.reshape(-1)),
                                                  part.column(0).take(pa.array(np.repeat(np.arange(n), m)))], ["table", "key", "node"])

    keys = staged(nodes.select("node", "code").mapInArrow(keyed, "table int, key long, node long"), "keys")
    crowds = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    chunk = F.when(chunks > 1, F.pmod(F.xxhash64("node"), chunks).cast("int")).otherwise(0)
    met = keys.join(crowds, ["table", "key"]).select("table", "key", "node", chunks.alias("chunks"), chunk.alias("own"))
    each = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = each.select("table", "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    return keys, blocks.join(nodes, "node").select("table", "key", "left", "right", "side", "node", "weight", "vector", "code")


def _score_blocks(blocks: DataFrame, codes: Codes, kind: str, least: float) -> DataFrame:
    """(node, links, root) of every vector with a link in a block; a pair counts in the first table it meets in."""
    columns = ["table", "key", "left", "right", "side", "node", "weight", "vector", "code"]

    def score(table: int, cross: bool, side: np.ndarray, node: np.ndarray, weight: np.ndarray, vectors: list[bytes], packed: list[bytes]):
        u = unit_rows(vectors, kind)
        linked = u @ u.T >= least
        np.fill_diagonal(linked, False)
        if cross:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        busy = np.flatnonzero(linked.any(axis=1))
        linked, node, weight = linked[np.ix_(busy, busy)], node[busy], weight[busy]
        keys = codes.keys([packed[i] for i in busy])
        for t in range(table):
            linked &= keys[:, None, t] != keys[None, :, t]
        busy = linked.any(axis=1)
        if not busy.any():
            return None
        root = node.copy()
        while True:
            moved = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (moved == root).all():
                break
            root = moved
        return node[busy], (linked @ weight)[busy], root[busy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        names = columns[:4]

        def groups(rows: pa.Table, last: bool):
            """Whole groups of the sorted rows; what is left over waits for the next batch."""
            ids = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
            edge = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            bounds = [0, *edge.tolist(), *([len(ids)] if last else [])]
            side, node, weight = (rows.column(c).to_numpy() for c in ("side", "node", "weight"))
            vectors, packed = rows.column("vector").to_pylist(), rows.column("code").to_pylist()
            found = [score(int(ids[a, 0]), bool(ids[a, 2] != ids[a, 3]), side[a:b], node[a:b], weight[a:b], vectors[a:b], packed[a:b])
                     for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
            return [f for f in found if f], rows.slice(bounds[-1])

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], ["node", "links", "root"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            found, rest = groups(rows, False)
            if found:
                yield out(found)
        if rest is not None and rest.num_rows:
            found, _ = groups(rest, True)
            if found:
                yield out(found)

    whole = blocks.repartition("table", "key", "left", "right").sortWithinPartitions("table", "key", "left", "right")
    return whole.select(columns).mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE,
                    recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Links are pairs with a cosine of at least ``least`` that meet in a table; none lies below it.  Vectors that are NULL, empty, zero or hold NULL or non-finite
    components, and vectors of another length than the most frequent one, link with nothing (component: their own id).  Identical vectors link with each other.  Rows that
    repeat an id each count as a vector.  A NULL id is never a component unless all its component's ids are NULL.  An empty table gives no
    rows; other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    size = rows.where(_able(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    able = _able(F.col("v")) & (F.size("v") == F.lit(size["d"] if size else 0))
    alone = rows.where(~able).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if size is None:
        return alone.withColumn("kept", F.lit(True))
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        # adding 0 makes -0 and 0 the same bytes
        return pa.array([(np.asarray(x, dtype=kind) + 0).tobytes() for x in column.to_pylist()], pa.binary())

    fits = rows.where(able).select("id", packed("v").alias("vector"))
    same = fits.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    nodes = staged(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("vector"), "node").limit(sample_rows).select("vector").collect()  # at most sample_rows vectors
    codes = Codes(unit_rows([bytes(r["vector"]) for r in sample], kind), n, least, recall)
    coded = _coded(nodes, codes, kind)
    keys, blocks = _block_rows(coded, codes)
    scored = staged(_score_blocks(blocks, codes, kind, least), "links")
    unstage(keys, coded)
    links = scored.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(scored.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = nodes.join(found, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least_id = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    known = staged(joined.join(links, "node", "left").join(least_id, "component")
                   .select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"), "known")
    unstage(nodes, scored, found)
    # every row finds its node by its vector
    out = fits.join(known, "vector").select(F.col("id").alias(id_col), F.col("links").alias("n_links"), "component_id")
    return out.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
