"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after every character of a class
(white space by default) is deleted.  The digest of that normalised text names
a group; its content decides:

1. *locally*: the aggregate on (digest, salt, normalised text) combines the
   copies inside each input task before anything is shuffled; the salt is the
   input task's number, so a task ships one row a text;
2. *salted*: the salt spreads a hot group's rows over reducers, each of which merges a share;
3. *globally*: the salt winners, at most ``salts`` a text, are combined on (digest, normalised text).

Every stage groups by the normalised text itself, so two texts with one digest never
merge.  A group's state is a count and one number that orders its rows (longest original,
then smallest id), both fixed-width, so Spark aggregates by hash.  The group table, without
texts, is written to the shared folder and joined back to the rows by digest; digests
that stand for more than one text (none in practice, tested with a weak digest) go a second way that joins on the text too.

Defined results: a NULL text is the empty text and empty texts are equal to
each other; a NULL id loses every tie and may only stay when no row of its length has an
id (``keep_id`` is then NULL and ``kept`` is true on the rows with a NULL id); rows that repeat
an id and a text are copies like any other, all marked as kept if theirs is the id that stays
(``keep_one`` returns one of them); an empty table gives no rows.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlens.llm.common import fresh, staged

# Characters that do not count (fixed value).
IGNORED = r"[\x20\x09-\x0D]"
# Reducers that share one hot text.
SALTS = 32
# 2^63, one more than the largest id.
TOP = Decimal(2**63)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _order(id_col: Column, text: Column) -> Column:
    """One decimal that is larger for a longer text, then for a smaller id; a NULL id comes last."""
    by_id = F.lit(TOP) - id_col.cast("decimal(20,0)")  # 1 to 2^64; 0 for a NULL id
    return (F.length(text).cast("decimal(10,0)") * F.lit(2 * TOP * 2) + F.coalesce(by_id, F.lit(0))).cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    rest = order % F.lit(2 * TOP * 2)
    return F.when(rest > 0, (F.lit(TOP) - rest).cast("long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], ignored: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.regexp_replace(text, ignored, "").alias("body"),
                       _order(F.col(f"`{id_col}`").cast("long"), text).alias("place"))
    return rows.withColumn("digest", digest(F.col("body")))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, body, place, size): every distinct text once."""
    state = lambda size: [F.max("place").alias("place"), size.alias("size")]
    salted = (rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("digest", "salt", "body").agg(*state(F.count(F.lit(1)))))
    return salted.groupBy("digest", "body").agg(*state(F.sum("size")))


def _by_digest(rows: DataFrame, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """(digest, place, size) of digests of one text, staged; digests of several texts, or None."""
    table = staged(_groups(rows, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("place").alias("place"), F.sum("size").alias("size")), "exact-groups")
    shared = table.where("texts > 1").select("digest")
    return table.where("texts = 1").drop("texts"), None if shared.isEmpty() else shared


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256, salts: int = SALTS, ignored: str = IGNORED) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row; see the module's docstring."""
    rows = _keyed(docs, id_col, text_col, digest, ignored)
    plain, shared = _by_digest(rows, salts)
    columns = ["id", "digest", "place", "size"]
    found = rows.select("id", "digest").join(plain, "digest").select(columns)
    if shared is not None:
        some = rows.join(shared, "digest", "left_semi")
        found = found.unionByName(some.select("id", "digest", "body").join(_groups(some, salts), ["digest", "body"]).select(columns))
    keep = _id_of(F.col("place"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.col("size").alias("group_size"),
                        F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             digest: Callable[[Column], Column] = sha256, salts: int = SALTS, ignored: str = IGNORED) -> DataFrame:
    """The rows that stay, with all their columns: exactly one for each distinct text.

    The rows meet their group on (digest, place), which only a winner shares with it, so a hot group does not
    meet in one task.
    """
    plain, shared = _by_digest(_keyed(docs, id_col, text_col, digest, ignored), salts)
    d, p, b = fresh("digest"), fresh("place"), fresh("body")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    body = F.regexp_replace(text, ignored, "")
    whole = docs.withColumns({d: digest(body), p: _order(F.col(f"`{id_col}`").cast("long"), text)})
    kept = whole.join(plain.select(F.col("digest").alias(d), F.col("place").alias(p)), [d, p], "left_semi").dropDuplicates([d, p])
    if shared is not None:
        some = whole.join(shared.withColumnRenamed("digest", d), d, "left_semi").withColumn(b, body)
        rows = some.select(F.col(d).alias("digest"), F.col(b).alias("body"), F.col(p).alias("place"))
        best = _groups(rows, salts).select(F.col("digest").alias(d), F.col("body").alias(b), F.col("place").alias(p))
        kept = kept.unionByName(some.join(best, [d, b, p], "left_semi").dropDuplicates([d, b, p]).drop(b))
    return kept.drop(d, p)
