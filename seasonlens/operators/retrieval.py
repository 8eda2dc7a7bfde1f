"""Chunking and filtered vector top-k.

Chunking is a per-row ``explode`` of window starts, so it parallelises with
the documents.  Retrieval is brute force *inside* the filter keys: each
query meets only the corpus rows with equal keys (a player-year in the
reference), Spark broadcasts the query side where it is small, and the
top-k uses ``row_number() <= k``, which Spark turns into a partial
``WindowGroupLimit`` before the shuffle, so a key with a huge share of the
corpus ships at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonlens.functions.text import tokens

# Fixed values of the reference's index: 300-token chunks, 20 % overlap.
CHUNK_TOKENS = 300
OVERLAP_PERCENT = 20


def chunk_documents(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
    size: int = CHUNK_TOKENS,
    overlap_percent: int = OVERLAP_PERCENT,
) -> DataFrame:
    """F1-F2: fixed-size token windows with overlap; filter keys carried along.

    Windows start at 0, stride, 2*stride, ... up to the last token; a text with no tokens gives no chunk.
    """
    stride = size - size * overlap_percent // 100
    words = tokens(text_col)
    n = F.size(F.col("_words"))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    w = docs.select(id_col, *keep, words.alias("_words"))
    pieces = F.transform(starts, lambda s: F.slice(F.col("_words"), s + 1, F.lit(size)))
    c = w.select(id_col, *keep, F.posexplode(pieces).alias("chunkNo", "_piece"))
    piece = F.col("_piece")
    return c.select(
        F.concat_ws("-", F.col(id_col).cast("string"), F.col("chunkNo").cast("string")).alias("chunk_id"),
        id_col, *keep, "chunkNo",
        F.size(piece).alias("nTokens"),
        F.array_join(piece, " ").alias("text"),
    )


def _as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, vec: str, out: str, norm: str) -> DataFrame:
    """``vec`` as doubles in ``out`` and its length in ``norm``: once a row, before any join."""
    return df.withColumn(out, _as_double(F.col(vec))).withColumn(norm, F.sqrt(dot(F.col(out), F.col(out))))


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key (element-wise), as ``key, centroid``."""
    cells = df.select(key, F.posexplode(vec).alias("_pos", "_x"))
    means = cells.groupBy(key, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("centroid")
    )


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    keys: Sequence[str],
    k: int = 15,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    doc_id: str = "doc_id",
    doc_vec: str = "embedding",
    rank_digits: int | None = None,
    within_keys: bool = False,
) -> DataFrame:
    """the k most similar corpus rows per query among rows with equal keys.

    Cosine similarity; ties go to the smaller document id.  With
    ``rank_digits`` the ranking uses the score rounded to that many places.  ``within_keys`` ranks a query's rows
    of each key apart, on the join's partitioning (the same where a query has one key).
    """
    q = with_norm(queries, query_vec, "_q", "_qn").select(query_id, *keys, "_q", "_qn")
    d = with_norm(corpus, doc_vec, "_d", "_dn").select(doc_id, *keys, "_d", "_dn")
    score = F.try_divide(dot(F.col("_q"), F.col("_d")), F.col("_qn") * F.col("_dn"))
    scored = d.join(q, list(keys)).select(query_id, *keys, doc_id, score.alias("score"))
    order_score = F.round(F.col("score") + F.lit(1e-9), rank_digits) if rank_digits is not None else F.col("score")
    per = [*keys, query_id] if within_keys else [query_id]
    w = Window.partitionBy(*per).orderBy(order_score.desc_nulls_last(), F.col(doc_id).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
