"""One small hand-built case per semantic rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from helpers import dims, rows
from seasonlens.functions.features import add_features
from seasonlens.functions.lookup import lookup, merge_item_versions
from seasonlens.operators import summaries as su
from seasonlens.operators import streaks as st
from seasonlens.sources.dims import queues_to_modes


def feats(spark, *over, d=None):
    d = d or dims(spark)
    return d.mode(add_features(rows(spark, *over))), d


def test_s1_creation_truncated_to_second(spark):
    f, _ = feats(spark, {"gameCreation": 1_704_067_199_999})
    r = f.select(F.unix_seconds("gameDate").alias("s"), "month", "hour", "dayOfWeek").first()
    assert r.s == 1_704_067_199  # 2023-12-31 23:59:59 UTC
    assert (r.month, r.hour, r.dayOfWeek) == (12, 23, 1)  # a Sunday


def test_s2_zero_duration_gives_null_rates(spark):
    f, _ = feats(spark, {"gameDuration": 0})
    r = f.select("csPerMin", "dmgPerMin", "dmgTakenPerMin", "hoursPlayed").first()
    assert r.csPerMin is None and r.dmgPerMin is None and r.dmgTakenPerMin is None
    assert r.hoursPlayed == 0.0


def test_s3_kda_zero_and_null_deaths(spark):
    f, _ = feats(spark, {"deaths": 0}, {"deaths": None})
    got = sorted(f.select("kda").collect(), key=lambda r: r.kda is None)
    assert got[0].kda == 8.0 and got[1].kda is None


def test_s4_null_win_counts_as_loss(spark):
    f, _ = feats(spark, {"win": True}, {"win": None})
    assert su.global_totals(f).first().winRate == 0.5


def test_s5_rates_are_means_of_ratios(spark):
    f, _ = feats(spark, {"kills": 1, "assists": 0, "deaths": 1}, {"kills": 9, "assists": 0, "deaths": 3})
    assert su.mode_stats(f).first().avgKDA == 2.0  # (1 + 3) / 2, not 10 / 4


def test_s6_best_game_tie_break(spark):
    f, d = feats(spark, {"kills": 4, "assists": 0, "deaths": 1}, {"kills": 2, "assists": 2, "deaths": 1})
    best = su.champion_stats(f, d).first().bestGame
    # equal kda: the later game wins
    assert best.kda == 4.0 and best.kills == 2
    assert best.summonerSpells == ["Flash", "Ignite"] and best.primaryRune == "Domination"


def test_s7_items_per_slot(spark):
    f, d = feats(spark, {"items": [1001, 1001, 0, None, 3020, 0, 0]}, {"items": None}, {"items": []})
    got = {(r.itemName, r.usageCount) for r in su.item_stats(f, d).collect()}
    assert got == {("Boots", 2), ("3020", 1)}


def test_s8_same_name_two_ids_two_entries(spark):
    d = dims(spark, items=[(1, "Sword"), (2, "Sword")])
    f, _ = feats(spark, {"items": [1, 2, 0, 0, 0, 0, 0]}, d=d)
    nested = su.item_summary(su.item_stats(f, d)).collect()
    assert len(nested) == 1 and len(nested[0].modes) == 2


def test_s8b_modes_merge_by_label(spark):
    d = dims(spark, modes=[(1, "Map A"), (2, "Map A")])
    f, _ = feats(spark, {"queueId": 1}, {"queueId": 2}, d=d)
    assert [(r.gameMode, r.gamesPlayed) for r in su.mode_stats(f).collect()] == [("Map A", 2)]


def test_s9_ordered_spell_pairs(spark):
    f, d = feats(spark, {"summoner1Id": 4, "summoner2Id": 14}, {"summoner1Id": 14, "summoner2Id": 4})
    pairs = {(r.spell1Name, r.spell2Name) for r in su.spell_stats(f, d).collect()}
    assert pairs == {("Flash", "Ignite"), ("Ignite", "Flash")}


def test_s10_top5_champions_total_order(spark):
    champs = ["E", "D", "C", "B", "A", "F"]
    f, d = feats(spark, *[{"championName": c} for c in champs], {"championName": "F"})
    top = su.spell_stats(f, d).first().champions
    assert [(c.championName, c.gamesPlayed) for c in top] == [("F", 2), ("A", 1), ("B", 1), ("C", 1), ("D", 1)]


def test_s13_item_fallbacks(spark):
    latest = spark.createDataFrame([(1, ""), (2, "New"), (3, None)], "id bigint, name string")
    old = spark.createDataFrame([(1, "Old"), (3, "")], "id bigint, name string")
    items = merge_item_versions(latest, old)
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "i bigint")
    got = {r.i: r.n for r in lookup(ids, "i", items, "n", empty_is_missing=True).collect()}
    assert got == {1: "Old", 2: "New", 3: "3", 4: "4"}


def test_s13_rune_empty_name_kept_and_s14_null_id(spark):
    runes = spark.createDataFrame([(1, "")], "id bigint, name string")
    ids = spark.createDataFrame([(1,), (2,), (None,)], "i bigint")
    got = {r.i: r.n for r in lookup(ids, "i", runes, "n").collect()}
    assert got == {1: "", 2: "2", None: None}


def test_s15_queue_labels_and_last_duplicate(spark):
    q = spark.createDataFrame(
        [(1, "M", None, None, 0), (2, "M", "D", None, 1), (3, "M", None, "N", 2), (4, "M", "D", "N", 3),
         (1, "X", None, None, 4)],
        "queueId bigint, map string, description string, notes string, pos bigint",
    )
    got = {r.id: r.name for r in queues_to_modes(q, "pos").collect()}
    assert got == {1: "X", 2: "M: D", 3: "M (N)", 4: "M: D (N)"}


def _games(spark, wins, secs=None):
    secs = secs or list(range(len(wins)))
    data = [("p", 2024, dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc), f"m{i:03d}", w)
            for i, (s, w) in enumerate(zip(secs, wins))]
    return spark.createDataFrame(data, "puuid string, year int, gameDate timestamp, matchId string, win boolean")


def test_s16_same_second_games_do_not_blend(spark):
    g = _games(spark, [True, False, True, True], secs=[0, 0, 0, 0])
    runs = sorted((r.streakLength, r.isWinStreak) for r in st.streak_runs(g).collect())
    assert runs == [(1, False), (1, True), (2, True)]


def test_s17_null_outcome_is_no_change(spark):
    g = _games(spark, [True, None, False, False])
    runs = [(r.streakLength, r.isWinStreak) for r in st.streak_runs(g).collect()]
    assert runs == [(4, True)]


def test_s18_s19_longest_ties_and_defaults(spark):
    g = _games(spark, [True, True, False, True, True])
    r = st.longest_streaks(st.streak_runs(g)).select(
        "longestWinStreak.length", F.unix_seconds("longestWinStreak.startDate").alias("start")
    ).first()
    assert r.length == 2
    assert r.start == 1_700_000_000  # earliest of the tied streaks
    only_wins = st.longest_streaks(st.streak_runs(_games(spark, [True, True]))).first()
    assert only_wins.longestLoseStreak.length == 0 and only_wins.longestLoseStreak.startDate is None


def test_s20_sparse_hours(spark):
    f, _ = feats(spark, {}, {})
    hours = {r.hour for r in su.activity_stats(f, "hour").collect()}
    assert hours == {0, 1}


def test_s21_month_from_creation_year_from_start(spark):
    from seasonlens.functions.features import date_path_parts

    df = rows(spark, {"gameCreation": 1_704_067_199_000}).withColumn(
        "gameStartTimestamp", F.lit(1_704_067_260_000)
    )
    r = add_features(date_path_parts(df)).first()
    assert (r.year, r.month_part, r.day_part) == (2024, 1, 1)
    assert r.month == 12


def test_s22_empty_role_is_a_group(spark):
    f, _ = feats(spark, {"teamPosition": ""}, {"teamPosition": "TOP"})
    assert {r.teamPosition for r in su.role_stats(f).collect()} == {"", "TOP"}


def test_s24_absent_key_has_no_document(spark):
    from seasonlens.operators.document import build_documents

    f, d = feats(spark, {"puuid": "a"}, {"puuid": "b", "win": False})
    docs = {r.puuid: r.document for r in build_documents(f, d).collect()}
    assert set(docs) == {"a", "b"}
    g = docs["b"].summary["global"]
    assert g.totalGames == 1 and g.longestWinStreak.length == 0 and g.longestLoseStreak.length == 1


def test_s11_s23_sorted_arrays_and_named_json(spark):
    import json

    from seasonlens.operators.document import build_documents, documents_as_json

    f, d = feats(spark, {"championName": "Zed", "queueId": 1}, {"championName": "Ahri", "queueId": 1},
                 {"championName": "Ahri", "queueId": 2})
    doc = json.loads(documents_as_json(build_documents(f, d)).first().summary_json)
    names = [c["championName"] for c in doc["summary"]["champions"]]
    assert names == sorted(names)
    best = doc["summary"]["champions"][0]["bestGame"]
    assert set(best) >= {"kills", "kda", "gameDate", "summonerSpells"}
    assert best["gameDate"].startswith("2024-01-01T") and len(best["gameDate"]) == 19
    assert doc["playerPUUID"] == "p1" and doc["summary"]["global"]["totalGames"] == 3
