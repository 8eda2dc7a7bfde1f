"""Dimension readers (A5-A8): static catalogue documents -> (id, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlens import schema


def _doc(spark: SparkSession, schema_, path: str) -> DataFrame:
    return spark.read.schema(schema_).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``{"data": {"<id>": {"name": ...}}}`` -> id, name."""
    return (
        _doc(spark, schema.ITEM_DOC, path)
        .select(F.explode("data").alias("k", "v"))
        .select(F.col("k").cast("long").alias("id"), F.col("v.name").alias("name"))
    )


def read_spells(spark: SparkSession, path: str) -> DataFrame:
    """Map values keyed by their numeric ``key`` field."""
    return (
        _doc(spark, schema.SPELL_DOC, path)
        .select(F.explode(F.map_values("data")).alias("v"))
        .select(F.col("v.key").cast("long").alias("id"), F.col("v.name").alias("name"))
    )


def read_rune_styles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{id, name}`` (one row per element)."""
    return _doc(spark, schema.RUNE_STYLE, path).select("id", "name")


def queue_label(map_: str = "map", desc: str = "description", notes: str = "notes"):
    """A8 label ladder: map / map: desc / map (notes) / map: desc (notes).

    A missing map name prints as ``None``, as string formatting of a null does.
    """
    m = F.coalesce(F.col(map_), F.lit("None"))
    d, n = F.col(desc), F.col(notes)
    return (
        F.when(d.isNull() & n.isNull(), m)
        .when(n.isNull(), F.concat(m, F.lit(": "), d))
        .when(d.isNull(), F.concat(m, F.lit(" ("), n, F.lit(")")))
        .otherwise(F.concat(m, F.lit(": "), d, F.lit(" ("), n, F.lit(")")))
    )


def queues_to_modes(queues: DataFrame, position: str | None = None) -> DataFrame:
    """Queue rows -> (id, name); a duplicated id keeps its last entry.

    ``position`` orders duplicates (source order); without it the input is
    taken to hold unique ids.
    """
    labelled = queues.select(F.col("queueId").alias("id"), queue_label().alias("name"),
                             *( [F.col(position).alias("_pos")] if position else []))
    if not position:
        return labelled
    return labelled.groupBy("id").agg(F.max_by("name", "_pos").alias("name"))


def read_queues(spark: SparkSession, path: str) -> DataFrame:
    """A8 from the published JSON array; file order decides duplicates."""
    raw = _doc(spark, schema.QUEUE, path).withColumn("_pos", F.monotonically_increasing_id())
    return queues_to_modes(raw, "_pos")
