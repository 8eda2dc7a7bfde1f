"""Id -> name lookups (D1-D5) as joins against small dimensions.

The reference closes Python dictionaries into row-at-a-time UDFs; here a
dimension is a DataFrame ``(id, name)`` and the lookup is a left join; Spark
broadcasts it by its size in bytes (``autoBroadcastJoinThreshold``, or at run time by AQE) and shuffles otherwise.  Two fallback rules exist:

* ``empty_is_missing=False`` (runes, spells, queue modes): a matched id keeps
  its stored name, even an empty one; an unmatched id becomes its own text.
* ``empty_is_missing=True`` (items): an empty or NULL name falls through to
  the id text.
A NULL id yields a NULL name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(
    df: DataFrame,
    id_expr: str | Column,
    dim: DataFrame,
    out_col: str,
    *,
    empty_is_missing: bool = False,
    key: str = "id",
    name: str = "name",
) -> DataFrame:
    """Left-join ``dim`` on ``id_expr`` and add ``out_col`` with the fallback rule."""
    ident = F.col(id_expr) if isinstance(id_expr, str) else id_expr
    tag = out_col.replace(".", "_")
    k, n, hit = f"_lk_{tag}_id", f"_lk_{tag}_name", f"_lk_{tag}_hit"
    base = dim.select(F.col(key).cast("long").alias(k), F.col(name).alias(n), F.lit(True).alias(hit))
    joined = df.join(base, ident.cast("long") == F.col(k), "left")
    as_text = ident.cast("string")
    if empty_is_missing:
        value = F.coalesce(F.nullif(F.col(n), F.lit("")), as_text)
    else:
        value = F.when(F.col(hit), F.col(n)).otherwise(as_text)
    return joined.withColumn(out_col, value).drop(k, n, hit)


def merge_item_versions(latest: DataFrame, old: DataFrame) -> DataFrame:
    """One item dimension from two catalogue versions, latest first."""
    a = latest.select(F.col("id").cast("long").alias("id"), F.col("name").alias("_latest"))
    b = old.select(F.col("id").cast("long").alias("id"), F.col("name").alias("_old"))
    return a.join(b, "id", "full_outer").select(
        "id",
        F.coalesce(F.nullif(F.col("_latest"), F.lit("")), F.nullif(F.col("_old"), F.lit(""))).alias(
            "name"
        ),
    )


@dataclass
class Dimensions:
    """The four lookups of the summary job (D5: one object instead of a UDF factory)."""

    items: DataFrame  # id, name (merged versions)
    spells: DataFrame  # id, name
    runes: DataFrame  # id, name
    modes: DataFrame  # id, name (queue label)

    def item(self, df: DataFrame, id_expr: str | Column, out: str) -> DataFrame:
        return lookup(df, id_expr, self.items, out, empty_is_missing=True)

    def spell(self, df: DataFrame, id_expr: str | Column, out: str) -> DataFrame:
        return lookup(df, id_expr, self.spells, out)

    def rune(self, df: DataFrame, id_expr: str | Column, out: str) -> DataFrame:
        return lookup(df, id_expr, self.runes, out)

    def mode(self, df: DataFrame, id_expr: str | Column = "queueId", out: str = "gameMode") -> DataFrame:
        """The queue label replaces the raw gameMode column."""
        tmp = "_mode_label"
        return lookup(df, id_expr, self.modes, tmp).drop(out).withColumnRenamed(tmp, out)
