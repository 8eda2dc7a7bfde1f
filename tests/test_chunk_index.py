"""The chunk index: replaced key by key, registered again from its files, searched without moving it."""

from __future__ import annotations

import hashlib
import re

from seasonlens.operators import chunk_index as ix

DOCS = "puuid string, year int, text string"


def _words(spark, path):
    return {(r.puuid, r.year): r.text for r in ix.read_index(spark, path).collect()}


def test_term_vector_counts_words(spark):
    text = "a b a  c\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(ix.term_vector("t").alias("v")).collect()
    want = [0.0] * ix.DIMENSIONS
    for w in text.split():
        want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % ix.DIMENSIONS] += 1
    assert got[0].v == want and got[1].v is None and got[2].v == [0.0] * ix.DIMENSIONS


def test_documents_are_replaced_per_key(spark, tmp_dir):
    path = f"{tmp_dir}/index"
    first = [("p", 2023, "one"), ("p", 2024, "two"), ("q", 2024, "three"), ("r", 2024, None), (None, 2024, "lost")]
    ix.replace_documents(spark.createDataFrame(first, DOCS), path, buckets=2)
    assert _words(spark, path) == {("p", 2023): "one", ("p", 2024): "two", ("q", 2024): "three"}
    # an emptied document loses its chunks, also where its folder holds nothing else
    ix.replace_documents(spark.createDataFrame([("p", 2023, " "), ("p", 2024, "new"), ("r", 2024, "late")], DOCS), path, buckets=7)
    want = {("p", 2024): "new", ("q", 2024): "three", ("r", 2024): "late"}
    assert _words(spark, path) == want
    ix.replace_documents(spark.createDataFrame([], DOCS), path)
    assert _words(spark, path) == want
    # a later session knows the files only
    (table,) = [t.name for t in spark.catalog.listTables() if t.name == ix._open(spark, path, 9)[0]]
    spark.sql(f"DROP TABLE {table}")
    assert ix._open(spark, path, 9) == (table, 2)
    assert _words(spark, path) == want


def test_search_keeps_the_index_in_place(spark, tmp_dir):
    path = f"{tmp_dir}/index"
    text = " ".join(f"w{i}" for i in range(700))
    ix.replace_documents(spark.createDataFrame([("p", 2024, text), ("q", 2024, text), ("q", 2023, "w0")], DOCS), path, buckets=4)
    queries = spark.createDataFrame([(1, "p", 2024, "w5 w6"), (2, "q", 2023, "w0"), (3, "z", 2024, "w0")], "query_id int, puuid string, year int, ask string") \
        .withColumn("query_vec", ix.term_vector("ask"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ix.search(ix.read_index(spark, path), queries, k=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.query_id, r["rank"], r.puuid) for r in sorted(rows)] == [(1, 1, "p"), (1, 2, "p"), (2, 1, "q")]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # one shuffle: the queries'; none on the index, none for the ranking
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    index_side = plan[: plan.index("Bucketed: true")].rsplit("\n", 1)[0]
    assert "Exchange" not in index_side
