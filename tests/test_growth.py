"""What crosses the shuffle or is written stays near the input: clustering before explodes, compressed text, narrow copies."""

from __future__ import annotations

import glob
import os
import re

from helpers import dims, rows
from pyspark.sql import functions as F

from seasonlens.functions.features import add_features


def _features(spark):
    d = dims(spark)
    games = rows(spark, *[{"matchId": f"m{i}", "items": [1, 2, 1, 0, 3, 0, i]} for i in range(6)])
    return d, d.mode(add_features(games))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_item_slots_are_exploded_after_the_only_shuffle(spark):
    from seasonlens.operators import summaries as su

    d, feat = _features(spark)
    stats = su.item_stats(feat, d)
    text = _plan(su.item_summary(stats))
    shuffles = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "puuid" in x]
    assert len(shuffles) == 1 and "itemId" not in shuffles[0]
    assert text.index("Generate explode") < text.index("Exchange hashpartitioning(puuid")  # plans print the last step first
    used = {r.itemId: r.usageCount for r in stats.collect()}
    assert used == {1: 13, 2: 7, 3: 7, 4: 1, 5: 1}


def test_names_of_ids_listed_twice_still_give_two_rows(spark):
    from seasonlens.operators import summaries as su

    d, feat = _features(spark)
    d.items = spark.createDataFrame([(1, "one"), (1, "uno"), (2, "")], "id long, name string")
    got = sorted((r.itemId, r.itemName, r.usageCount) for r in su.item_stats(feat, d).collect())
    assert got == [(1, "one", 13), (1, "uno", 13), (2, "2", 7), (3, "3", 7), (4, "4", 1), (5, "5", 1)]


def test_raw_matches_are_grouped_by_order_without_another_shuffle(spark):
    from seasonlens.sources import binding

    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = _plan(binding.raw_matches(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 4  # two joins, two sides each


def test_json_table_is_compressed_and_reads_back(spark, tmp_dir):
    from seasonlens.sources.matches import read_player_matches, write_player_matches

    path = os.path.join(tmp_dir, "t")
    games = rows(spark, *[{"matchId": f"m{i}"} for i in range(50)]).withColumns({"month_part": F.lit(1), "day_part": F.lit(2)})
    write_player_matches(games, path, fmt="json")
    files = glob.glob(f"{path}/*/*/*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert {r.matchId for r in read_player_matches(spark, path, fmt="json").collect()} == {f"m{i}" for i in range(50)}


def test_documents_and_facts_stage_games_clustered_by_key(spark, monkeypatch):
    from seasonlens.operators import document as doc
    from seasonlens.operators.facts import FACT_COLUMNS
    from seasonlens.plans import catalog
    from seasonlens import session

    seen = {}
    real = session.stage

    def spy(df, name):
        seen[name] = (_plan(df), df.columns)
        return real(df, name)

    monkeypatch.setattr(session, "stage", spy)
    monkeypatch.setattr(doc, "stage", spy)
    d, feat = _features(spark)
    made = doc.build_documents(feat, d, stage_input=True)
    assert made.count() == 1
    catalog._facts(spark, "/root/testdata/sf0.001")
    for name in ("document_features", "fact_features"):
        assert "REBALANCE_PARTITIONS_BY_COL" in seen[name][0]
    assert set(seen["fact_features"][1]) == {"puuid", "year", *FACT_COLUMNS, "gameDate", "matchId"}
