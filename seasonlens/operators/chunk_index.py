"""Chunk index of stored documents, bucketed by the filter keys.

Retrieval filters by (puuid, year), so the index is a parquet table bucketed by these keys: a search reads each bucket where it
lies, and only the queries are shuffled to it.  A bucket's rows stand in a folder (``slice``) of their own, and a changed document
rewrites the folders of its keys only: their other documents' rows and its own, staged before they replace the folder.  A
document without words keeps one row without a chunk, so that its folder is rewritten too.

The table's data and its number of buckets lie under one path; a session that has not seen the table yet registers it from there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlens.functions.text import tokens
from seasonlens.operators.retrieval import chunk_documents, vector_topk
from seasonlens.session import path_exists, stage, unstage
from seasonlens.sources.sinks import _record_buckets, _recorded_buckets

KEYS = ("puuid", "year")
# Buckets of a new index: some hundred MB of vectors each.
BUCKETS = 32
DIMENSIONS = 64
SLICE = "slice"
COLUMNS = "puuid string, year int, chunk_id string, chunkNo int, nTokens int, text string, embedding array<float>"


def term_vector(text: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """Hashed term counts: a word counts at the first 16 bits of its MD5, modulo ``dimensions``."""
    places = F.transform(tokens(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimensions)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return F.aggregate(places, zeros, lambda v, at: F.transform(v, lambda x, i: x + (i == at).cast("float")))


def _slice(buckets: int) -> Column:
    # Spark's own bucket number of the keys
    return F.pmod(F.hash(*KEYS), F.lit(buckets)).alias(SLICE)


def _open(spark: SparkSession, path: str, buckets: int) -> tuple[str, int]:
    """(table name, its number of buckets); an existing index keeps its own number."""
    exists = path_exists(spark, f"{path}/rows")
    buckets = (_recorded_buckets(spark, path) if exists else None) or buckets
    name = "chunk_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        if not exists:
            _record_buckets(spark, path, buckets)
        spark.sql(f"CREATE TABLE {name} ({COLUMNS}, {SLICE} int) USING parquet PARTITIONED BY ({SLICE}) "
                  f"CLUSTERED BY ({', '.join(KEYS)}) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
        if exists:
            spark.catalog.recoverPartitions(name)
    return name, buckets


def replace_documents(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Index ``docs`` (puuid, year, text; a row a key) in place of what is there for their keys; other keys stay.

    A null text has no words. Rows with a null key are not indexed: no filter finds them.  One run at a time writes an index.
    """
    spark = docs.sparkSession
    name, buckets = _open(spark, path, buckets)
    given = docs.select(F.col(KEYS[0]).cast("string").alias(KEYS[0]), F.col(KEYS[1]).cast("int").alias(KEYS[1]), "text").dropna(subset=list(KEYS))
    given = stage(given, "index_documents")
    keyed = given.withColumn("_id", F.concat_ws("_", *KEYS))
    chunks = chunk_documents(keyed, "_id", "text", KEYS).withColumn("embedding", term_vector("text"))
    columns = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    empty = given.where(F.coalesce(F.size(tokens("text")), F.lit(0)) <= 0).select(*KEYS)
    fresh = chunks.select(columns).unionByName(empty, allowMissingColumns=True).withColumn(SLICE, _slice(buckets))
    touched = given.select(_slice(buckets)).distinct()
    kept = spark.table(name).join(touched, SLICE, "left_semi").join(given.select(*KEYS), list(KEYS), "left_anti")
    rows = stage(kept.select(*columns, SLICE).unionByName(fresh), "index_merge")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.repartition(buckets, *KEYS).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    unstage(given, rows)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """the chunks with their filter keys and vectors."""
    name, _ = _open(spark, path, BUCKETS)
    return spark.table(name).where(F.col("chunk_id").isNotNull()).drop(SLICE)


def search(index: DataFrame, queries: DataFrame, k: int = 15, query_id: str = "query_id", query_vec: str = "query_vec",
           rank_digits: int | None = None) -> DataFrame:
    """the ``k`` most similar chunks of each query's (puuid, year).  The ranking keeps the keys' partitioning."""
    return vector_topk(queries, index, KEYS, k, query_id, query_vec, "chunk_id", "embedding", rank_digits, within_keys=True)
