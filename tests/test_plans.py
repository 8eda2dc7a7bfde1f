"""Plan-shape checks: the scale properties the design relies on show up in
``explain("formatted")``."""

from __future__ import annotations

import contextlib
import io
import os
import re

from pyspark.sql import functions as F


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_topk_uses_partial_window_group_limit(spark):
    from seasonlens.operators.retrieval import vector_topk

    corpus = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("key"),
                                     F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    queries = spark.range(3).select(F.col("id").alias("query_id"), F.col("id").alias("key"),
                                    F.array(F.lit(1.0), F.lit(0.0)).alias("query_vec"))
    text = plan(vector_topk(queries, corpus, ["key"], k=5))
    assert text.count("WindowGroupLimit") >= 2  # partial before the shuffle, final after


def test_year_scope_prunes_partitions(spark, tmp_dir):
    from helpers import rows
    from seasonlens.sources.matches import read_player_matches, scoped, write_player_matches

    df = rows(spark, {}, {"year": 2023}).withColumn("month_part", F.lit(1)).withColumn("day_part", F.lit(1))
    path = os.path.join(tmp_dir, "t")
    write_player_matches(df, path)
    text = plan(scoped(read_player_matches(spark, path), puuid="p1", year=2024))
    assert "PartitionFilters: [isnotnull(year" in text and "(year#" in text and "= 2024" in text
    assert "PushedFilters: [IsNotNull(puuid), EqualTo(puuid,p1)]" in text


def test_document_simple_sections_share_one_expand(spark):
    from helpers import dims, rows
    from seasonlens.functions.features import add_features
    from seasonlens.operators.document import build_documents

    d = dims(spark)
    f = d.mode(add_features(rows(spark, {}, {"win": False})))
    text = plan(build_documents(f, d))
    assert len(re.findall(r"\(\d+\) Expand\b", text)) == 2  # simple sections, combo sums: each pass once


def test_facts_share_one_expand(spark):
    from helpers import dims, rows
    from seasonlens.functions.features import add_features
    from seasonlens.operators.facts import fact_numbers

    f = dims(spark).mode(add_features(rows(spark, {}, {"win": False})))
    assert len(re.findall(r"\(\d+\) Expand\b", plan(fact_numbers(f)))) == 1


def test_dimension_join_is_left_to_its_size(spark):
    from seasonlens.functions.lookup import lookup

    dim = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("name"))
    ids = spark.range(5).select(F.col("id").alias("i"))
    assert "BroadcastExchange" in plan(lookup(ids, "i", dim, "n"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = lookup(ids, "i", dim, "n")
        assert "BroadcastExchange" not in plan(shuffled)
        assert sorted(r.n for r in shuffled.collect()) == ["0", "1", "2", "3", "4"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_small_files_share_tasks_and_ids_need_no_content(spark, tmp_dir):
    from pyspark.sql import functions as F
    from seasonlens.sources import matches as M

    own = spark.conf.get("spark.sql.files.openCostInBytes")
    docs = spark.range(300).select(
        F.concat(F.lit("p+ "), F.col("id") % 3).alias("puuid"), F.concat(F.lit("m"), "id").alias("matchId"), F.lit(2024).alias("year"),
        F.lit(1).alias("month_part"), (F.col("id") % 2 + 1).cast("int").alias("day_part"),
        F.concat(F.lit('{"matchId": "m'), "id", F.lit('"}')).alias("value"))
    for _ in range(2):  # a rerun replaces its files
        M.write_date_path_documents(docs, tmp_dir)
    ids = M.list_date_path_files(spark, tmp_dir)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    rows, bad = M.read_date_path_documents(spark, tmp_dir)
    assert bad.count() == 0 and rows.count() == ids.count() == 300
    assert {r.puuid for r in rows.select("puuid").distinct().collect()} == {"p+ 0", "p+ 1", "p+ 2"}
    # Spark's own costs would give a task thirty files
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") == own  # other scans keep theirs


def test_files_without_an_id_or_a_document_are_errors(spark, tmp_dir):
    import pytest
    from seasonlens.sources import matches as M

    cols = "puuid string, matchId string, year int, month_part int, day_part int, value string"
    for row in (("p", None, 2024, 1, 1, "{}"), ("p", "a/b", 2024, 1, 1, "{}"), ("p", "m", 2024, 1, 1, None)):
        with pytest.raises(Exception, match="no file name|no document"):
            M.write_date_path_documents(spark.createDataFrame([row], cols), tmp_dir)
