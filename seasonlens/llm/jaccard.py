"""Exact n-gram Jaccard join by the size-aware heavy-light method.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least
``percent`` / 100.  Documents with one and the same set form a class and are joined once.

**Light sets** (up to a boundary size): of two linked sets each misses at most ``n - ceil(t n)`` of its own
elements, so both hold the subset they share among their subsets of those sizes.  All these
subsets are enumerated as keys; sets that meet in a subset large enough for the threshold are linked without further work, each to the smallest of them
(a star gives the same components as all pairs).

**Heavy sets** scan inverted lists.  Elements are put in one global order, rare first, and only the
first ``n - ceil(t n) + 1`` elements of a set are listed: two linked sets share one of these.  Exact counts are taken of a fixed
share of the element universe (those with a small hash, which is where the lists are cut from), so
elements of a single set, most of them, never enter a list.

**Boundary**: the cost of the light side (subsets) and of the heavy side (list entries, each with
its share of the check) is summed over the histogram of set sizes, and the cheapest boundary is taken.

**Candidates**: the pairs of a list of ordinary length, where size and place allow a link and where what both hold of the counted
share leaves enough to be shared outside it; this rules out nearly all unrelated pairs before full sets are read.

**Hot lists**: the members of a longer list form the group of a pivot and are all checked against it (a star), which joins a large group of near copies in
linear work.  The check also tells what each member shares with the pivot and which of its other elements no other member of the
group has; members that can reach nobody by these bounds drop out.

**Difference sets** decide the rest of a group exactly.  Members near the pivot are described by their symmetric difference from it; the others get a pivot of their own, and
after a few rounds their whole set (two linked members are both near, or both far: the symmetric difference is a metric, and members about the border are both).  From a *centre*, the elements that more than half of a group hold, every
member has a difference set ``D``, and with ``w = (100 + percent) |D| - (100 - percent) n`` two members link exactly when ``w_a + w_b <= 2 (100 + percent) |D_a & D_b|``.  So:

* a star to the member with the least ``w`` joins what it links with;
* two members that this star does not join both must share at least ``lo`` elements of ``D`` that two or more members hold, where
  ``lo`` follows from a member's ``w`` and the least ``w`` of a possible partner; a member that has fewer drops out;
* the first ``|D| - lo + 1`` of these elements, rare ones first, are listed; short lists give pairs, which ``D`` decides exactly;
* a long list is a group with a centre of its own, at most half as large, and goes the same way again.  Lists with the same members are one group.

Nothing is capped, and no pair of a long list is formed.

Shingles are 63-bit hashes of word hashes, and a set's identity is its size with two 63-bit sums over its shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, staged, texts, unstage
from seasonlens.llm.components import components

K = 5
PERCENT = 80
# Share of the element universe that is counted exactly, as a multiple of the listed share.
COUNTED = 2.0
# Cost of a list entry against that of a subset key: it is counted, ordered, listed, and may be checked.
ENTRY_COST = 8
# Largest boundary that is considered.
MAX_LIGHT = 40
# Members within so many link lengths of a pivot are described by their difference from it.
NEAR = 3
# Further pivots that members far from theirs are held against before whole sets are used.
ROUNDS = 3
# Members of a group from which its first origin is taken.
LOOK = 64
# Members of a group that meet its centre in one task.
SHARE = 1000
# Longest list whose pairs are candidates themselves.
SHORT = 64
# Words whose hashes a task keeps.
MEMO_WORDS = 400_000
# What tells one set from another: its size and two sums over its elements.
KEY = ["n", "k1", "k2"]

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 63-bit hashes of a text's k-word shingles.

    Words are what ASCII white space separates, A-Z lower-cased; a text of fewer than k words is one shingle, a text without words has none.
    """

    def __init__(self, k: int):
        self.k = k
        self.hashes = _WordHashes()
        self.odd = np.array([_ODD[j % len(_ODD)] + np.uint64(2 * (j // len(_ODD))) for j in range(k)], dtype=np.uint64)

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.int64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            size = min(self.k, len(h))
            total = np.full(len(h) - size + 1, size, dtype=np.uint64)
            for j in range(size):
                total += h[j:len(h) - size + 1 + j] * self.odd[j]
            return np.unique((_mix(total) >> np.uint64(1)).astype(np.int64))


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's elements that, with its size, tell it from other sets."""
    u = s.astype(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(int(_mix(v).sum(dtype=np.uint64).astype(np.int64)) for v in (u, u ^ _ODD[0]))


def least_overlap(n: int, percent: int) -> int:
    """Elements of a set of n that a linked set must share: the ceiling of n * percent / 100."""
    return -(-n * percent // 100)


def listed(n: int, percent: int) -> int:
    """Elements of a set of n that are listed."""
    return n - least_overlap(n, percent) + 1


def subsets(n: int, percent: int) -> int:
    """Number of subsets of a set of n that are keys on the light side."""
    return sum(math.comb(n, j) for j in range(n - least_overlap(n, percent) + 1))


def boundary(sizes: Iterable[tuple[int, int]], percent: int) -> int:
    """Largest light size, by the cost of both sides over (size, sets) pairs."""
    sizes = list(sizes)

    def cost(b: int) -> int:
        light = sum(c * subsets(n, percent) for n, c in sizes if n <= b)
        return light + sum(ENTRY_COST * c * listed(n, percent) for n, c in sizes if n >= least_overlap(b + 1, percent))

    return min(range(MAX_LIGHT + 1), key=lambda b: (cost(b), b))


def _fits(n: Column, m: Column, shared: Column, percent: int) -> Column:
    """Whether ``shared`` common elements link sets of n and m."""
    return shared * 100 >= (n + m - shared) * percent


def _shingled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, counted, head): a set's size and identity, and its smallest elements in hash order.

    ``head`` holds the elements below the counted share and, where they are fewer than the listed ones, the next in order;
    ``counted`` is how many of them are below.
    """
    below = int(min(1.0, COUNTED * (100 - percent) / 100) * 2**63)
    long = T.LongType()
    fields = [T.StructField("n", long), T.StructField("k1", long), T.StructField("k2", long), T.StructField("counted", long),
              T.StructField("head", T.ArrayType(long))]

    def make():
        shingler = Shingler(k)

        def each(text: str):
            s = shingler.set_of(text)
            counted = int(np.searchsorted(s, below))
            head = s[:max(counted, listed(len(s), percent))] if len(s) else s
            yield len(s), *identity(s), counted, head.tolist()

        return each

    rows = texts(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), "text")
    return map_texts(rows, "id", fields, make)


def _light_edges(sets: DataFrame, b: int, percent: int) -> DataFrame:
    """Stars of the sets that share a large enough subset; ``sets`` has (node, n, all) with all elements."""
    schema = "node long, n long, size long, s1 long, s2 long"

    def subset_keys(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, n, elements in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                u = np.array(elements, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    one, two = _mix(u), _mix(u ^ _ODD[0])
                    whole1, whole2 = one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)
                    for drop in range(n - least_overlap(n, percent) + 1):
                        for gone in itertools.combinations(range(n), drop):
                            at = list(gone)
                            s1 = (whole1 - one[at].sum(dtype=np.uint64)).astype(np.int64)
                            s2 = (whole2 - two[at].sum(dtype=np.uint64)).astype(np.int64)
                            rows.append((i, n, n - drop, int(s1), int(s2)))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["node", "n", "size", "s1", "s2"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["node", "n", "size", "s1", "s2"])

    keys = sets.where(F.col("n") <= b).select("node", "n", "all").mapInArrow(subset_keys, schema)
    key = ["size", "s1", "s2"]
    center = keys.groupBy(key).agg(F.min(F.struct("n", "node")).alias("c"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    met = keys.join(center, key).where(F.col("node") != F.col("c.node"))
    return met.where(_fits(F.col("n"), F.col("c.n"), F.col("size"), percent)).select(F.col("c.node").alias("a"), F.col("node").alias("b"))


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, place, alone): the listed elements that more than one set holds.

    ``place`` is the element's place in the set's order: elements of one set only (``alone`` many), then counted ones by (count, hash),
    then the next in hash order.
    """
    entries = reps.select("node", F.posexplode("head").alias("at", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = entries.join(shared, "token").join(reps.select("node", "n", "counted"), "node")
    in_counted = F.col("at") < F.col("counted")
    by_set = Window.partitionBy("node")
    order = by_set.orderBy((~in_counted).cast("int"), F.when(in_counted, F.col("df")), "token")
    held = held.withColumns({
        "alone": F.col("counted") - F.sum(in_counted.cast("long")).over(by_set),
        "rank": F.row_number().over(order) - 1,
    })
    place = F.when(in_counted, F.col("alone") + F.col("rank")).otherwise(F.col("at").cast("long"))
    cut = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return held.withColumn("place", place).where(F.col("place") < cut).select("token", "node", "n", "place", "alone")


def _may_link(percent: int, x: str, y: str) -> Column:
    """Size and place filters of two list entries."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = 1 + F.least(n - F.col(f"{x}.place") - 1, m - F.col(f"{y}.place") - 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & _fits(n, m, left, percent)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, shared, extra) of the pairs (a, b), on the full sets; ``extra``: elements of b that a has not."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("all").alias("all_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("all").alias("all_b"))
    met = pairs.join(two, "b").join(one, "a").withColumn("extra", F.array_except("all_b", "all_a"))
    return met.select("a", "b", "n", "m", (F.col("m") - F.size("extra")).alias("shared"), "extra")


def _reaches(found: DataFrame, percent: int) -> DataFrame:
    """(pivot, node, common, rest, mine): elements a node shares with its pivot, how many others it may share with a node of the pivot's group,
    and elements that no node which it could be linked with has.

    ``rest`` leaves out the elements that no other node of the group has.  To tell these, nodes show their extra elements: all
    of them, or, the less they share with the pivot, only those in a smaller part of the hash range.  A node counts as
    its own only what it has in the part that every node shows with which it could be linked: two nodes can't be linked when the one's
    share of the pivot and the other's share of extra elements are too little together.
    """
    even = percent / (100 + percent)  # share of two linked sets' elements, both counted, that they have in common
    far, mid = min(1.0, (100 - percent) / 40), min(1.0, max(0.6, (100 - percent) / 29))
    # shares of the pivot this far apart rule out a link, whatever the two sizes (which differ by percent at most)
    apart = (100 - percent) / 100 + 0.02

    def part(share: Column) -> Column:
        return F.when(share >= even - 0.01, 1.0).when(share >= 0.3, mid).otherwise(far)

    place = F.col("e") / float(2**63)
    shown = found.select("a", "b", (F.col("shared") / F.col("m")).alias("share"),
                         F.explode(F.filter("extra", lambda e: e / float(2**63) < part(F.col("shared") / F.col("m")))).alias("e"))
    own = shown.groupBy("a", "e").agg(F.count(F.lit(1)).alias("held"), F.min("b").alias("b"), F.min("share").alias("share")) \
        .where((F.col("held") == 1) & (place < part(F.col("share") - apart))) \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("own"), F.collect_list("e").alias("mine"))
    rest = F.col("m") - F.col("shared") - F.coalesce("own", F.lit(0))
    return found.select("a", "b", "m", "shared").join(own, ["a", "b"], "left") \
        .select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("shared").alias("common"), rest.alias("rest"), F.coalesce("mine", F.array().cast("array<long>")).alias("mine"))


def _candidates(lists: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged (a, b): pairs of short lists that may link; staged (pivot, node, n, alone): members of the long lists."""
    sizes = staged(lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("alone", "n", "node"))["node"].alias("pivot")), "list-sizes")
    x, y = (lists.join(sizes.where(F.col("size") <= SHORT).select("token"), "token", "left_semi").alias(i) for i in "xy")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _may_link(percent, "x", "y")) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    known = classes.select("node", "n", F.slice("head", F.lit(1), F.col("counted").cast("int")).alias("head"))
    one, two = (known.select(*(F.col(c).alias(f"{i}_{c}") for c in known.columns)) for i in "ab")
    met = met.join(two, F.col("b") == F.col("b_node")).join(one, F.col("a") == F.col("a_node"))
    unseen = F.least(F.col("a_n") - F.size("a_head"), F.col("b_n") - F.size("b_head"))
    most = F.size(F.array_intersect("a_head", "b_head")) + unseen
    direct = staged(met.where(_fits(F.col("a_n"), F.col("b_n"), most, percent)).select("a", "b"), "direct")
    long = sizes.where(F.col("size") > SHORT).select("token", "pivot")
    group = staged(lists.join(long, "token").select("pivot", "node", "n", "alone").distinct(), "groups")
    unstage(sizes)
    return direct, group


def _distance(n: Column, m: Column, shared: Column) -> Column:
    return n + m - 2 * shared


def _starred(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``_checked`` with ``apart``: the symmetric difference, for members that a member near the pivot may link with; else NULL."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("all").alias("all_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("all").alias("all_b"))
    met = star.join(two, "b").join(one, "a").withColumn("extra", F.array_except("all_b", "all_a")).withColumn("shared", F.col("m") - F.size("extra"))
    k = (100 - percent) / (100 + percent)
    halo = k * (NEAR * F.col("n") + ((NEAR + 1) * 100 / percent + 1) * F.col("m")) + 1
    apart = F.when(_distance(F.col("n"), F.col("m"), F.col("shared")) <= halo, F.concat(F.array_except("all_a", "all_b"), "extra"))
    return met.select("a", "b", "n", "m", "shared", "extra", apart.alias("apart"))


def _merged(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``group`` with the groups of pivots near each other as one: a family of near copies has many long lists, but one star then.

    Of two such pivots the one with fewer elements of its own takes the other's members; members that are far from it are told apart later.
    """
    pivots = group.where("node = pivot").select("pivot", F.struct("alone", "n", "pivot").alias("order"))
    met = group.join(pivots.select("pivot", F.col("order").alias("first")), "pivot") \
        .join(pivots.select(F.col("pivot").alias("node"), "order"), "node").where(F.col("first") < F.col("order"))
    found = _checked(met.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets)
    k = (100 - percent) / (100 + percent)
    close = found.where(_distance(F.col("n"), F.col("m"), F.col("shared")) <= NEAR * k * (F.col("n") + F.col("m")))
    into = close.join(pivots.select(F.col("pivot").alias("a"), "order"), "a").groupBy("b").agg(F.min("order")["pivot"].alias("into")).withColumnRenamed("b", "pivot")
    moved = group.join(into, "pivot", "left").select(F.coalesce("into", "pivot").alias("pivot"), "node", "n", "alone")
    # the new pivot is a member of its group whether or not it stood in the lists that moved
    return moved.dropDuplicates(["pivot", "node"])


def _around(group: DataFrame, sets: DataFrame, percent: int, first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: edges (a, b) to the pivots of ``group``, members near their pivot (g, node, n, size, e), and the members far from it, as ``group``."""
    star = group.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    found = staged(_starred(star, sets, percent), "starred")
    joined = staged(found.where(_fits(F.col("n"), F.col("m"), F.col("shared"), percent)).select("a", "b"), "joined")
    reach = F.least("m", F.col("common") + F.col("rest"))
    # members near the pivot show all their extra elements if they share enough with it: then what is shown once is held once
    k = (100 - percent) / (100 + percent)
    at_border = 1 - k * ((NEAR + 1) * 100 / percent + 1)
    shown = (at_border / (1 + k * NEAR) * (1 - k * NEAR) + at_border) / 2 >= percent / (100 + percent)
    members = found.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "n", "m", "shared", "apart")
    if first:  # members that can reach nobody leave once
        members = members.join(_reaches(found, percent), ["pivot", "node"]).where(reach * 100 >= F.col("m") * percent)
    members = staged(members, "members")
    pivots = members.where("apart is not null").select("pivot", "n").distinct()
    none = F.array().cast("array<long>")
    seen = F.array_except("apart", F.col("mine") if first and shown else none)
    near = members.where("apart is not null").select("pivot", "node", F.col("m").alias("n"), F.size("apart").alias("size"), seen.alias("e")).unionByName(
        pivots.select("pivot", F.col("pivot").alias("node"), "n", F.lit(0).alias("size"), none.alias("e")))
    far = members.where(_distance(F.col("n"), F.col("m"), F.col("shared")) > NEAR * k * (F.col("n") + F.col("m"))).select("pivot", "node")
    far = staged(far.join(group, ["pivot", "node"]), "far")
    rows = staged(near.select(F.xxhash64("pivot").alias("g"), "node", "n", "size", "e"), "near")
    unstage(found, members)
    return joined, rows, far


def _heavy_edges(direct: DataFrame, group: DataFrame, sets: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Edges of the heavy side and ``light``, the edges already known; staged."""
    pairs = staged(_checked(direct, sets).where(_fits(F.col("n"), F.col("m"), F.col("shared"), percent)).select("a", "b"), "linked")
    far = staged(_merged(group, sets, percent), "merged")
    stars, rows, spent = [pairs], [], [pairs, far]
    for turn in range(ROUNDS):
        if turn:  # the member with the fewest elements of its own becomes the pivot
            next_ = far.groupBy("pivot").agg(F.min(F.struct("alone", "n", "node"))["node"].alias("next"))
            far = far.join(next_, "pivot").select(F.col("next").alias("pivot"), "node", "n", "alone").dropDuplicates(["pivot", "node"])
        if far.isEmpty():
            break
        joined, near, far = _around(far, sets, percent, first=turn == 0)
        stars.append(joined)
        rows.append(near.withColumn("g", F.xxhash64("g", F.lit(turn))))
        spent += [joined, near, far]
    rows.append(far.join(sets.select("node", "all"), "node").select(
        F.xxhash64("pivot", F.lit(-1)).alias("g"), "node", "n", F.size("all").alias("size"), F.col("all").alias("e")))
    apart = _difference_edges(_union(rows), percent)
    # every node hangs on one partner of the first checks, and the other links are between these partners
    hung = _union(stars).groupBy("b").agg(F.min("a").alias("on")).select(F.col("b").alias("node"), "on")
    moved = _union([light, *stars, apart])
    for end in "ab":
        moved = moved.join(hung.select(F.col("node").alias(end), F.col("on").alias(f"{end}_on")), end, "left")
    moved = moved.select(F.coalesce("a_on", "a").alias("a"), F.coalesce("b_on", "b").alias("b")).where("a <> b")
    out = staged(moved.unionByName(hung.select(F.col("node").alias("a"), F.col("on").alias("b"))).distinct(), "links")
    unstage(*spent, apart)
    return out


def _difference_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges inside groups; ``rows`` has (g, node, n, size, e): a member's set from a common origin, of ``size`` elements in all.

    Staged (a, b), whose components are those of all links between two members of a group.  Each turn of the loop treats the groups at hand and makes
    those of their long lists, which are at most half as large.
    """
    spark = rows.sparkSession
    parts = [spark.createDataFrame([], "a long, b long")]
    spent = []
    rows = staged(rows, "differences")
    while not rows.isEmpty():
        centred = _centred(rows, percent)
        starred = staged(_least_star(centred, percent), "starred")
        lists = _difference_lists(starred, percent)
        edges = staged(starred.where("linked and node <> m").select(F.col("m").alias("a"), F.col("node").alias("b"))
                       .unionByName(_list_pairs(lists, starred, percent)).distinct(), "difference-edges")
        parts.append(edges)
        next_ = lists.where(F.col("held") > SHORT).join(starred.select("g", "node", "n", "size", "e"), ["g", "node"])
        next_ = staged(next_.select(F.xxhash64("g", "token").alias("g"), "node", "n", "size", "e"), "differences")
        unstage(rows, centred, starred, lists)
        spent.append(edges)
        rows = next_
    unstage(rows)
    out = staged(_union(parts).distinct(), "apart")
    unstage(*spent)
    return out


def _in_shares(rows: DataFrame, of_group: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with its group's row of ``of_group``, which meets the group's members in shares of about SHARE."""
    shares = members.select("g", F.ceil(F.col("members") / SHARE).cast("int").alias("shares"))
    spread = of_group.join(shares, "g").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = rows.join(shares, "g").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).drop("shares")
    return dealt.join(spread, ["g", "share"], "left").drop("share")


def _shifted(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` from another origin: the elements that more than half of some LOOK members of the group hold.

    Any origin gives the same links; this one makes the difference sets short before they are counted.
    """
    looks = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("members") / LOOK).cast("int")) == 0
    some = rows.join(members, "g").where(looks).select("g", "node", "e")
    held = some.select("g", F.explode("e").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("held"))
    most = held.join(some.groupBy("g").agg(F.count(F.lit(1)).alias("seen")), "g").where("2 * held > seen")
    return _from_centre(rows, most.groupBy("g").agg(F.collect_list("x").alias("centre")), members)


def _from_centre(rows: DataFrame, centre: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` as differences from ``centre`` (g, centre); groups that it does not name stay as they are."""
    centre_of = F.coalesce("centre", F.array().cast("array<long>"))
    moved = _in_shares(rows, centre, members).withColumn("moved", F.concat(F.array_except("e", centre_of), F.array_except(centre_of, "e")))
    return moved.select("g", "node", "n", (F.col("size") - F.size("e") + F.size("moved")).alias("size"), F.col("moved").alias("e"))


def _centred(rows: DataFrame, percent: int) -> DataFrame:
    """Staged (g, node, n, size, w, e) from the centre of each group; ``e`` keeps the elements that another member has too, rare ones first."""
    members = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "group-sizes")
    rows = staged(_shifted(rows, members), "shifted")
    counts = rows.select("g", F.explode("e").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    counts = counts.join(members, "g").withColumn("central", 2 * F.col("held") > F.col("members"))
    counts = counts.withColumn("now", F.when(F.col("central"), F.col("members") - F.col("held")).otherwise(F.col("held")))
    counts = staged(counts, "counts")
    centre = counts.where("central").groupBy("g").agg(F.collect_list("x").alias("centre"))  # at most twice a member's mean size
    moved = _from_centre(rows, centre, members).select("g", "node", "n", "size", F.explode_outer("e").alias("x"))
    held = moved.join(counts.where("now > 1").select("g", "x", "now"), ["g", "x"], "left")
    whole = held.groupBy("g", "node", "n", "size").agg(F.sort_array(F.collect_list(F.when(F.col("now").isNotNull(), F.struct("now", "x")))).alias("e"))
    w = F.col("size") * (100 + percent) - F.col("n") * (100 - percent)
    out = staged(whole.select("g", "node", "n", "size", w.cast("long").alias("w"), F.transform("e", lambda v: v["x"]).alias("e")), "centred")
    unstage(counts, rows, members)
    return out


def _least_star(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``m``, the member of least ``w``, ``linked`` (with it, or it), and ``lo``, the least overlap with a partner that matters.

    Members that can link with nobody but through the star have a NULL ``lo``.
    """
    unit = 2 * (100 + percent)
    top = rows.groupBy("g").agg(F.min(F.struct("w", "node")).alias("least"), F.count(F.lit(1)).alias("members"),
                                F.max(unit * F.size("e") - F.col("w")).alias("reach"))
    best = rows.join(top.select("g", F.col("least.node").alias("node"), "reach"), ["g", "node"]).select(
        "g", F.col("node").alias("m"), F.col("w").alias("w_m"), F.col("e").alias("e_m"), "reach")
    met = _in_shares(rows, best, top)
    linked = (F.col("node") == F.col("m")) | (F.col("w") + F.col("w_m") <= unit * F.size(F.array_intersect("e", "e_m")))
    met = met.withColumn("linked", linked)
    open_ = (F.col("w") <= F.col("reach")) & (unit * F.size("e") - F.col("w") >= F.col("w_m"))
    met = met.withColumn("open", open_).drop("e_m", "reach")
    others = met.where("open and not linked").groupBy("g").agg(F.min("w").alias("w_other"))
    met = _in_shares(met, others, top)
    partner = F.when(F.col("linked"), F.col("w_other")).otherwise(F.when(F.col("w_other").isNotNull(), F.col("w_m")))
    lo = F.greatest(F.ceil((F.col("w") + partner) / unit), F.lit(1))
    return met.withColumn("lo", F.when(F.col("open") & (lo <= F.size("e")), lo)).select("g", "node", "n", "size", "w", "e", "m", "linked", "lo")


def _difference_lists(rows: DataFrame, percent: int) -> DataFrame:
    """(g, token, node, linked, held): listed elements with their members, each set of members once.

    A member leaves a list where what it holds from the element on can't make up for the least ``w`` of the list: two members have
    one element that is the first of those they share, and both have no more in common than what follows it.
    """
    first = F.slice("e", F.lit(1), (F.size("e") - F.col("lo") + 1).cast("int"))
    entries = rows.where("lo is not null").select("g", "node", "linked", "w", F.size("e").alias("all"), F.posexplode(first).alias("at", "token"))
    for _ in range(2):
        least = entries.groupBy("g", "token").agg(F.min("w").alias("any"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("other"))
        partner = F.when(F.col("linked"), F.col("other")).otherwise(F.col("any"))
        entries = entries.join(least, ["g", "token"]).where((F.col("all") - F.col("at")) * 2 * (100 + percent) >= F.col("w") + partner).drop("any", "other")
    entries = staged(entries.select("g", "node", "linked", "token"), "entries")
    hashes = [F.bit_xor(F.xxhash64(F.col("node"), F.lit(i))).alias(f"h{i}") for i in range(2)]
    lists = entries.groupBy("g", "token").agg(F.count(F.lit(1)).alias("held"), F.count(F.when(~F.col("linked"), 1)).alias("apart"), *hashes)
    lists = lists.where("held > 1 and apart > 0").groupBy("g", "held", "h0", "h1").agg(F.min("token").alias("token"))
    out = staged(entries.join(lists.select("g", "token", "held"), ["g", "token"]), "difference-lists")
    unstage(entries)
    return out


def _candidate_pairs(lists: DataFrame) -> DataFrame:
    """(g, a, b): the pairs of short lists that no star joins."""
    short = lists.where(F.col("held") <= SHORT)
    x, y = short.alias("x"), short.alias("y")
    return x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                  & ~(F.col("x.linked") & F.col("y.linked"))).select("x.g", F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _list_pairs(lists: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the linked pairs of short lists, decided by their difference sets."""
    pairs = _candidate_pairs(lists)
    for end in "ab":
        pairs = pairs.join(rows.select("g", F.col("node").alias(end), F.col("w").alias(f"w_{end}"), F.col("e").alias(f"e_{end}")), ["g", end])
    common = F.size(F.array_intersect("e_a", "e_b"))
    return pairs.where(F.col("w_a") + F.col("w_b") <= 2 * (100 + percent) * common).select("a", "b")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _with_component(lists: DataFrame, joined: DataFrame) -> DataFrame:
    return lists.join(joined.withColumnRenamed("node", "node"), "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    ``component_id`` is the smallest id reachable by links, its own included.  A NULL text is the empty text; texts without words have no
    shingles and link with nothing (their component is their own id).  Rows that repeat an id count each for the text they have.  A row
    with a NULL id takes the component of its set, NULL if no row with that set has an id.  Ids are integers.  An empty table gives no
    rows; other columns are not read.
    """
    every = staged(_shingled(docs, id_col, text_col, k, percent), "shingled")
    same = every.where("n > 0").groupBy(*KEY).agg(F.min("id").alias("id"), F.any_value("counted").alias("counted"), F.any_value("head").alias("head"))
    classes = staged(same.where("id is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = staged(every.select("id", *KEY), "rows")
    unstage(every)
    histogram = classes.groupBy("n").count().where(F.col("n") <= 2 * MAX_LIGHT).collect()  # at most 2 * MAX_LIGHT rows
    b = boundary([(r["n"], r["count"]) for r in histogram], percent)
    listed_ = staged(_lists(classes.where(F.col("n") >= least_overlap(b + 1, percent)), percent), "lists")
    crowd = listed_.groupBy("token").count().where("count > 1").select("token")
    lists = staged(listed_.join(crowd, "token"), "lists")
    direct, group = _candidates(lists, classes, percent)
    nodes = [classes.where(F.col("n") <= b).select("node"), group.select("node"), *(direct.select(F.col(c).alias("node")) for c in "ab")]
    wanted = _union(nodes).distinct()
    sets = staged(_full_sets(docs, id_col, text_col, k, classes.join(wanted, "node").select("node", "id", *KEY)), "sets")
    light = staged(_light_edges(sets, b, percent), "light")
    edges = _heavy_edges(direct, group, sets, light, percent)
    found = components(edges)
    joined = _with_component(classes.select("node", "id", *KEY), found)
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = staged(joined.join(least, "component").select(*KEY, "component_id"), "named")
    unstage(classes, listed_, lists, direct, group, sets, light, edges, found)
    out = rows.join(named, KEY, "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _full_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, n, all): all elements of the wanted classes, from the row whose id stands for the class."""
    long = T.LongType()
    fields = [T.StructField("own_n", long), T.StructField("own_k1", long), T.StructField("own_k2", long), T.StructField("all", T.ArrayType(long))]

    def make():
        shingler = Shingler(k)

        def each(text: str):
            s = shingler.set_of(text)
            yield len(s), *identity(s), s.tolist()

        return each

    rows = texts(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), "text")
    rows = rows.join(wanted, "id").select(F.struct("node", *KEY).alias("of"), "text")
    made = map_texts(rows, "of", fields, make).where("own_n = of.n and own_k1 = of.k1 and own_k2 = of.k2")
    return made.select("of.node", "of.n", "all").dropDuplicates(["node"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: of every component the row with the smallest id.

    Documents without words stay, and so do rows with a NULL id.  Of rows that repeat an id, those of one component
    stay or go together.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    gone = found.where(F.col(id_col) != F.col("component_id"))
    # an id that stands for one component and is dropped from another (repeated ids) keeps its rows
    heads = found.where(F.col(id_col) == F.col("component_id")).select(id_col)
    ids = gone.select(id_col).distinct().join(heads, id_col, "left_anti")
    return docs.join(ids, id_col, "left_anti").select(docs.columns)
