"""Operator tests: property tests against plain-Python statements of the
rules, plus small hand-built cases for ingest, requests, text, retrieval,
progress, scoring, facts and dimension readers."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.operators import streaks as st


# ------------------------------------------------------------- streaks
def python_streaks(games):
    """Reference rule: sorted games; a change needs two known, different outcomes."""
    out, cur, prev = [], None, None
    for i, (t, w) in enumerate(sorted(games)):
        if i == 0 or not (w is not None and prev is not None and w != prev):
            if cur is None:
                cur = [t, t, 0, None]
        else:
            out.append(cur)
            cur = [t, t, 0, None]
        cur[1] = t
        cur[2] += 1
        if w is not None:
            cur[3] = w if cur[3] is None else (cur[3] or w)
        prev = w
    if cur:
        out.append(cur)
    return sorted((c[2], c[3], c[0], c[1]) for c in out)


@settings(max_examples=12, deadline=None)
@given(
    st_.lists(st_.tuples(st_.integers(0, 20_000), st_.sampled_from([True, False, None])), min_size=1, max_size=40),
    st_.sampled_from([1, 7, 60, 3600, 10**9, "range"]),
)
def test_bucketed_streaks_equal_plain_rule(spark, games, bucket):
    rows = [("p", 2024, dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc), f"m{i:04d}", w)
            for i, (s, w) in enumerate(games)]
    df = spark.createDataFrame(rows, "puuid string, year int, gameDate timestamp, matchId string, win boolean")
    got = sorted(
        (r.streakLength, r.isWinStreak, r.s, r.e)
        for r in (st.streak_runs(df, chunking="range", chunks=5) if bucket == "range"
                  else st.streak_runs(df, bucket_seconds=bucket))
        .select("streakLength", "isWinStreak", F.unix_seconds("startDate").alias("s"),
                F.unix_seconds("endDate").alias("e"))
        .collect()
    )
    expected = python_streaks([((1_700_000_000 + s, f"m{i:04d}"), w) for i, (s, w) in enumerate(games)])
    assert got == [(n, k, a[0], b[0]) for n, k, a, b in expected]


# ------------------------------------------------------------- text
@settings(max_examples=25, deadline=None)
@given(st_.text(alphabet=st_.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=12))
def test_percent_encode_matches_python_quote(spark, s):
    from seasonlens.functions.text import percent_encode

    got = spark.createDataFrame([(s,)], "s string").select(percent_encode("s").alias("e")).first().e
    assert got == urllib.parse.quote(s)


def python_extract(text):
    try:
        return "whole", json.loads(text)
    except json.JSONDecodeError:
        m = re.search(r"\[.*\]", text, re.DOTALL)
        if not m:
            return "no_array", None
        try:
            return "extracted", json.loads(m.group(0))
        except json.JSONDecodeError:
            return "bad_array", None


def test_extract_json_array_matches_python(spark):
    from seasonlens.functions.text import extract_json_array
    from seasonlens import schema

    fact = {"fact": "f", "context": "c", "question": "q", "choices": ["a", "b"], "correct_answer": "a"}
    texts = [
        json.dumps([fact]),
        "Sure! Here you go:\n" + json.dumps([fact, fact], indent=2) + "\nEnjoy.",
        "no array at all",
        "broken [ {\"fact\": } ]",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(extract_json_array("t", schema.FACT).alias("r")).collect()
    for t, r in zip(texts, got):
        status, value = python_extract(t)
        assert r.r.status == status
        assert (len(r.r.value) if r.r.value is not None else None) == (len(value) if value else None)


def test_chunk_boundaries(spark):
    from seasonlens.operators.retrieval import chunk_documents

    sizes = [0, 1, 300, 301, 480, 481, 1000]
    docs = spark.createDataFrame([(n, "  " + " ".join(f"w{i}" for i in range(n)) + "\n") for n in sizes],
                                 "id bigint, text string")
    got = {}
    for r in chunk_documents(docs, "id", "text").collect():
        got.setdefault(r.id, []).append((r.chunkNo, r.nTokens, r.text.split(" ")[0]))
    assert 0 not in got
    assert got[1] == [(0, 1, "w0")]
    assert got[300] == [(0, 300, "w0"), (1, 60, "w240")]  # a window starts every 240 tokens, up to the last one
    assert got[301] == [(0, 300, "w0"), (1, 61, "w240")]
    assert [c[0] for c in got[480]] == [0, 1] and [c[0] for c in got[481]] == [0, 1, 2]
    assert sorted(got[1000])[-1][1] == 1000 - 960


def test_vector_topk_filters_and_ranks(spark):
    from seasonlens.operators.retrieval import vector_topk

    corpus = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [1.0, 0.0])],
        "doc_id bigint, key string, embedding array<float>",
    )
    queries = spark.createDataFrame([("q", "a", [1.0, 0.0])], "query_id string, key string, query_vec array<double>")
    got = [(r.rank, r.doc_id) for r in vector_topk(queries, corpus, ["key"], k=2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


# ------------------------------------------------------------- ingest
def _raw(spark, tmp_dir, docs):
    path = os.path.join(tmp_dir, "raw.json")
    with open(path, "w") as fh:
        for d in docs:
            fh.write(json.dumps(d) + "\n")
    from seasonlens import schema

    return spark.read.schema(schema.RAW_MATCH).json(path)


def _participant(puuid, champ, styles=2):
    p = {"puuid": puuid, "championName": champ, "championId": 1, "teamPosition": "TOP", "individualPosition": "TOP",
         "kills": 1, "deaths": 1, "assists": 1, "totalMinionsKilled": 10, "neutralMinionsKilled": 0, "goldEarned": 1,
         "totalDamageDealtToChampions": 1, "totalDamageTaken": 1, "visionScore": 1, "win": True,
         "summoner1Id": 4, "summoner2Id": 14,
         "perks": {"styles": [{"style": 8100, "selections": [{"perk": 8112}]}, {"style": 8300, "selections": []}][:styles]}}
    p.update({f"item{i}": i for i in range(7)})
    return p


def test_extract_one_player_and_all_players(spark, tmp_dir):
    from seasonlens.operators import ingest

    match = {"metadata": {"matchId": "M1"},
             "info": {"gameCreation": 1_704_067_200_000, "gameStartTimestamp": 1_704_067_260_000,
                      "gameDuration": 1800, "gameMode": "CLASSIC", "queueId": 420,
                      "participants": [_participant("a", "First"), _participant("b", "B", styles=1),
                                       _participant("a", "Second")]}}
    raw = _raw(spark, tmp_dir, [match])
    one = ingest.extract_player_rows(raw, "a").collect()
    assert len(one) == 1 and one[0].championName == "First" and one[0].items == list(range(7))
    assert ingest.extract_player_rows(raw, "zzz").count() == 0
    valid, bad = ingest.split_malformed(ingest.extract_player_rows(raw))
    assert [(r.puuid, r.championName, r.year) for r in valid.collect()] == [("a", "First", 2024)]
    assert [(r.puuid, r.reason) for r in bad.collect()] == [("b", "missing rune styles")]


def test_new_matches_and_upsert(spark):
    from seasonlens.operators import ingest

    cand = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "puuid string, matchId string")
    stored = spark.createDataFrame([("a", "1")], "puuid string, matchId string")
    assert sorted(tuple(r) for r in ingest.new_matches(cand, stored).collect()) == [("a", "2"), ("b", "1")]
    old = spark.createDataFrame([("a", "1", 5, 1)], "puuid string, matchId string, kills int, v int")
    new = spark.createDataFrame([("a", "1", 7, 2), ("a", "2", 1, 2)], "puuid string, matchId string, kills int, v int")
    got = sorted(tuple(r) for r in ingest.upsert(old, new, "v").collect())
    assert got == [("a", "1", 7, 2), ("a", "2", 1, 2)]
    paths = spark.createDataFrame([("/store/match-history/a/stats/2024/01/02/EUW_1.json",)], "path string")
    assert [tuple(r) for r in ingest.stored_ids_from_paths(paths).collect()] == [("a", "EUW_1")]


def test_year_bounds_inclusive():
    from seasonlens.operators.ingest import year_bounds

    lo, hi = year_bounds(2024)
    assert lo == 1_704_067_200 and hi == 1_735_689_599


# ------------------------------------------------------------- requests
def test_parse_requests(spark):
    from seasonlens.operators.requests import ERR_FORMAT, ERR_REQUIRED, parse_requests

    req = spark.createDataFrame(
        [("  Hide on bush#KR1 ", None, "KR"), (None, "Faker#T1", None), ("", "", "euw1"), ("NoTag", None, "xx"),
         ("a/b~c*d#e#f", None, " OC1 ")],
        "riotId string, summonerName string, region string",
    )
    got = [r.asDict() for r in parse_requests(req).collect()]
    assert got[0]["game_name"] == "Hide%20on%20bush" and got[0]["tag_line"] == "KR1"
    assert got[0]["routing_value"] == "asia" and got[0]["region_label"] == "KR"
    assert got[1]["handle"] == "Faker#T1" and got[1]["region_code"] == "na1" and got[1]["routing_value"] == "americas"
    assert got[2]["status"] == 400 and got[2]["error"] == ERR_REQUIRED
    assert got[3]["error"] == ERR_FORMAT and got[3]["region_label"] == "XX"
    assert got[4]["game_name"] == urllib.parse.quote("a/b~c*d") and got[4]["tag_line"] == "e%23f"
    assert got[4]["routing_value"] == "sea" and got[4]["account_routing"] == "asia"


def test_routes_and_guard(spark):
    from seasonlens.operators.requests import guard_running, route, work_flags

    keys = spark.createDataFrame([("a", 2024), ("b", 2024), ("c", 2024)], "puuid string, year int")
    summ = keys.where("puuid in ('a', 'b')")
    final = keys.where("puuid = 'a'")
    running = keys.where("puuid in ('a', 'c')")
    w = work_flags(keys, summ, final).withColumn("route", route())
    got = {r.puuid: (r.route, r.action) for r in guard_running(w, running).collect()}
    assert got == {"a": ("facts_only_read", "START"), "b": ("facts_from_summary", "START"), "c": ("full_run", "BUSY")}


# ------------------------------------------------------------- progress, scoring
def test_progress_fold_demo_sequence(spark):
    from seasonlens.streaming.progress import progress_fold

    demo = [("START_RETRIEVE_MATCH", 220, None), ("RETRIEVING_MATCH", None, 40), ("RETRIEVING_MATCH", None, 150),
            ("RETRIEVING_MATCH", None, 220), ("PROCESSING_MATCH", None, None), ("GENERATING_FACTS", None, None),
            ("COMPLETE", None, None)]
    expected = [5, 18, 53, 75, 75, 90, 100]
    for n in range(1, len(demo) + 1):
        df = spark.createDataFrame([(1, i, s, t, c) for i, (s, t, c) in enumerate(demo[:n])],
                                   "job bigint, seq bigint, state string, total bigint, count bigint")
        assert progress_fold(df).first().percent == expected[n - 1]


def test_parse_messages_quarantine(spark):
    from seasonlens.streaming.progress import parse_messages

    raw = spark.createDataFrame([('{"state": "COMPLETE"}',), ("not json",), ('{"total": 3}',)], "value string")
    good, bad = parse_messages(raw)
    assert [r.state for r in good.collect()] == ["COMPLETE"] and bad.count() == 2


def test_score_first_answer_counts(spark):
    from seasonlens.operators.scoring import score

    answers = spark.createDataFrame([("p", "q1", "a", 2), ("p", "q1", "b", 1), ("p", "q2", "x", 1)],
                                    "player string, question string, choice string, ts int")
    facts = spark.createDataFrame([("p", "q1", "b"), ("p", "q2", "y"), ("p", "q3", "z")],
                                  "player string, question string, correct_answer string")
    r = score(answers, facts).first()
    assert (r.answered, r.correct, r.total, r.tier) == (2, 1, 3, "below_half")


def test_facts_validate(spark):
    from seasonlens import schema
    from seasonlens.operators.facts import validate_facts

    good = {"fact": "f", "context": "c", "question": "q", "choices": ["a", "b"], "correct_answer": "a"}
    bad = dict(good, correct_answer="z")
    df = spark.createDataFrame([([good] * 10,), ([good] * 9 + [bad],), (None,)],
                               T.StructType([T.StructField("facts", schema.FACT_ARRAY)]))
    got = [(r.nFacts, r.nValid, r.ok) for r in validate_facts(df).collect()]
    assert got == [(10, 10, True), (10, 9, False), (0, 0, False)]


# ------------------------------------------------------------- dimension readers
def test_dimension_readers(spark, tmp_dir):
    from seasonlens.sources import dims as D

    def put(name, obj):
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as fh:
            json.dump(obj, fh, indent=1)
        return p

    items = put("item.json", {"type": "item", "data": {"1001": {"name": "Boots"}, "3020": {"name": ""}}})
    spells = put("summoner.json", {"data": {"SummonerFlash": {"key": "4", "name": "Flash"}}})
    runes = put("runes.json", [{"id": 8100, "name": "Domination"}, {"id": 8300, "name": "Inspiration"}])
    queues = put("queues.json", [{"queueId": 420, "map": "Map X", "description": "5v5 Ranked Solo", "notes": None},
                                 {"queueId": 0, "map": "Custom games", "description": None, "notes": None},
                                 {"queueId": 420, "map": "Map X", "description": "Ranked", "notes": "new"}])
    assert sorted(tuple(r) for r in D.read_items(spark, items).collect()) == [(1001, "Boots"), (3020, "")]
    assert [tuple(r) for r in D.read_spells(spark, spells).collect()] == [(4, "Flash")]
    assert D.read_rune_styles(spark, runes).count() == 2
    got = {r.id: r.name for r in D.read_queues(spark, queues).collect()}
    assert got == {0: "Custom games", 420: "Map X: Ranked (new)"}


def test_date_path_layout_reader(spark, tmp_dir):
    from helpers import BASE
    from seasonlens.sources.matches import read_date_path_documents

    row = {k: v for k, v in BASE.items() if k not in ("puuid", "year")}
    d = os.path.join(tmp_dir, "match-history", "abc", "stats", "2024", "01", "02")
    os.makedirs(d)
    with open(os.path.join(d, "EUW_1.json"), "w") as fh:
        json.dump(row, fh, indent=2)
    with open(os.path.join(d, "EUW_2.json"), "w") as fh:
        fh.write("{ not json")
    rows, bad = read_date_path_documents(spark, os.path.join(tmp_dir, "match-history"))
    got = rows.collect()
    assert [(r.puuid, r.year, r.month_part, r.day_part, r.kills) for r in got] == [("abc", 2024, 1, 2, 5)]
    assert bad.count() == 1


def test_range_chunked_streaks_split_a_hot_hour(spark):
    # one player, 200 games inside one hour: time buckets give one chunk,
    # range chunking cuts the same games into several ordered pieces
    wins = [(i // 7) % 2 == 0 for i in range(200)]
    rows = [("p", 2024, dt.datetime.fromtimestamp(1_700_000_000 + i, dt.timezone.utc), f"m{i:04d}", w)
            for i, w in enumerate(wins)]
    df = spark.createDataFrame(rows, "puuid string, year int, gameDate timestamp, matchId string, win boolean")
    def key(r):
        return (r.streakLength, r.isWinStreak)
    by_time = sorted(map(key, st.streak_runs(df).collect()))
    by_range = sorted(map(key, st.streak_runs(df, chunking="range", chunks=6).collect()))
    assert by_time == by_range
    assert sum(n for n, _ in by_range) == 200 and len(by_range) == 29


def test_date_path_layout_reader_inferred(spark, tmp_dir):
    from helpers import BASE
    from seasonlens.sources.matches import read_date_path_documents

    row = {k: v for k, v in BASE.items() if k not in ("puuid", "year")}
    d = os.path.join(tmp_dir, "match-history", "xyz", "stats", "2023", "12", "31")
    os.makedirs(d)
    with open(os.path.join(d, "NA_9.json"), "w") as fh:
        json.dump(row, fh, indent=2)
    rows, bad = read_date_path_documents(spark, os.path.join(tmp_dir, "match-history"), infer=True)
    got = rows.collect()
    assert [(r.puuid, r.year, r.matchId, r.perks.primaryStyle) for r in got] == [("xyz", 2023, "m", 8100)]
    assert bad.count() == 0


def test_small_request_helpers(spark):
    from seasonlens.operators.requests import default_year, display_region

    df = spark.createDataFrame([("na1",), ("SG2",), ("zz9",), ("",), (None,)], "c string")
    got = [r.l for r in df.select(display_region(F.col("c")).alias("l")).collect()]
    assert got == ["NA", "SG", "ZZ9", "", ""]
    r = spark.range(1).select(default_year(2023).alias("a"), default_year().alias("b"),
                              (F.year(F.current_date()) - 1).alias("c")).first()
    assert r.a == 2023 and r.b == r.c
