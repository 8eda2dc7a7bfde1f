"""End-to-end: raw match JSON -> ingest job -> summary job -> documents."""

from __future__ import annotations

import json
import os

from test_operators import _participant


def _put(path, obj):
    with open(path, "w") as fh:
        json.dump(obj, fh)


def test_ingest_then_summary(spark, tmp_dir):
    from seasonlens.jobs import ingest_job, summary_job

    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    for i in range(3):
        match = {"metadata": {"matchId": f"M{i}"},
                 "info": {"gameCreation": 1_704_067_200_000 + i * 3_600_000,
                          "gameStartTimestamp": 1_704_067_260_000 + i * 3_600_000, "gameDuration": 1800,
                          "gameMode": "CLASSIC", "queueId": 420,
                          "participants": [_participant("a", "Ahri"), _participant("b", "Zed", styles=1 if i == 0 else 2)]}}
        with open(os.path.join(raw, f"m{i}.json"), "w") as fh:
            fh.write(json.dumps(match) + "\n")
    dims = os.path.join(tmp_dir, "dims")
    os.makedirs(dims)
    _put(os.path.join(dims, "items_latest.json"), {"data": {"1": {"name": "One"}}})
    _put(os.path.join(dims, "items_first.json"), {"data": {"2": {"name": "Two"}}})
    _put(os.path.join(dims, "spells.json"), {"data": {"Flash": {"key": "4", "name": "Flash"}}})
    _put(os.path.join(dims, "runes.json"), [{"id": 8100, "name": "Domination"}])
    _put(os.path.join(dims, "queues.json"), [{"queueId": 420, "map": "Map X", "description": "Ranked", "notes": None}])
    table, out, bad = (os.path.join(tmp_dir, n) for n in ("table", "summary", "bad"))
    ingest_job(spark, raw, table, year=2024, quarantine=bad)
    ingest_job(spark, raw, table, year=2024, quarantine=bad)  # rerun adds nothing new
    assert spark.read.parquet(table).count() == 5
    summary_job(spark, table, dims, out, year=2024)
    docs = {json.loads(r.value)["playerPUUID"]: json.loads(r.value) for r in spark.read.text(f"{out}/documents").collect()}
    assert set(docs) == {"a", "b"}
    assert docs["a"]["summary"]["global"]["totalGames"] == 3
    assert docs["a"]["summary"]["global"]["modes"][0]["gameMode"] == "Map X: Ranked"
    assert docs["b"]["summary"]["global"]["totalGames"] == 2


def test_rerun_for_one_player_keeps_the_others(spark, tmp_dir):
    from helpers import dims, rows
    from seasonlens.operators.document import build_documents, read_documents, write_documents
    from seasonlens.sources.sinks import read_facts, write_facts

    d = dims(spark)
    from seasonlens.functions.features import add_features

    feat = d.mode(add_features(rows(spark, {"puuid": "a"}, {"puuid": "b"}, {"puuid": "a", "year": 2023}, {"puuid": "a"})))
    path = "file://" + os.path.join(tmp_dir, "docs")  # a URI: the stored rows are found through the file system it names
    write_documents(build_documents(feat, d), path)
    write_documents(build_documents(feat.where("puuid = 'a' and year = 2024").limit(1), d), path)
    got = {(r.puuid, r.year): (json.loads(r.value)["summary"]["global"]["totalGames"], json.loads(r.meta)["metadataAttributes"]["puuid"])
           for r in read_documents(spark, path).collect()}
    assert got == {("a", 2024): (1, "a"), ("b", 2024): (1, "b"), ("a", 2023): (1, "a")}
    facts = spark.createDataFrame([("a", 2024, []), ("b", 2024, [])], "puuid string, year int, facts array<struct<fact:string,context:string,question:string,choices:array<string>,correct_answer:string>>")
    write_facts(facts, path + "-facts")
    write_facts(facts.where("puuid = 'b'"), path + "-facts", buckets=5)  # the table keeps its own number
    assert sorted(r.puuid for r in read_facts(spark, path + "-facts").collect()) == ["a", "b"]


def test_ingest_on_a_uri_with_broken_input(spark, tmp_dir):
    from seasonlens.jobs import ingest_job

    raw, table, bad = ("file://" + os.path.join(tmp_dir, n) for n in ("raw", "table", "bad"))
    os.makedirs(os.path.join(tmp_dir, "raw"))
    info = {"gameCreation": 1_704_067_200_000, "gameStartTimestamp": 1_704_067_260_000, "gameDuration": 1800, "gameMode": "CLASSIC", "queueId": 1}
    nobody = {**_participant("x", "Ahri"), "puuid": None}
    lines = [json.dumps({"metadata": {"matchId": "M1"}, "info": {**info, "participants": [nobody, _participant("a", "Ahri"), nobody, _participant("b", "Zed")]}}),
             json.dumps({"metadata": {"matchId": "M2"}, "info": {**info, "gameStartTimestamp": None, "participants": [_participant("a", "Ahri")]}}),
             json.dumps({"metadata": {"matchId": "M3"}, "info": {**info, "participants": []}}), "{broken",
             json.dumps({"metadata": {"matchId": "M4"}, "info": {**info, "participants": [_participant("a", "Ahri")]}}),
             json.dumps({"metadata": {"matchId": "M4"}, "info": {**info, "gameCreation": 1_704_067_200_001, "participants": [_participant("a", "Zed")]}})]
    with open(os.path.join(tmp_dir, "raw", "m.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    for _ in range(2):
        ingest_job(spark, raw, table, year=2024, quarantine=bad)
    got = sorted((r.puuid, r.matchId, r.championName) for r in spark.read.parquet(table).collect())
    assert got == [("a", "M1", "Ahri"), ("a", "M4", "Zed"), ("b", "M1", "Zed")]
    reasons = sorted((r.matchId or "", r.reason) for r in spark.read.parquet(bad).collect())
    assert reasons == [("", "broken document"), ("M1", "missing puuid"), ("M1", "missing puuid"), ("M2", "missing start time"), ("M3", "missing participants")]


def test_shared_folder_is_required_off_a_local_master():
    from seasonlens import session

    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_a_table_without_a_record_of_its_buckets(spark, tmp_dir):
    import pytest

    from seasonlens.sources import sinks

    rows = spark.createDataFrame([(f"p{i}", 2024, i) for i in range(50)], "puuid string, year int, n int")
    path = os.path.join(tmp_dir, "table")
    sinks.replace_keys(rows, path, buckets=32)
    record = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{sinks.LAYOUT}")
    files = record.getFileSystem(spark._jsc.hadoopConfiguration())
    assert sinks._recorded_buckets(spark, path) == 32
    sinks.replace_keys(rows, path, buckets=8)
    assert spark.read.parquet(path).count() == 50
    files.delete(record, True)
    with pytest.raises(ValueError, match="no record"):
        sinks.replace_keys(rows, path, buckets=8)
    sinks.replace_keys(rows.where("n < 5"), path, buckets=32)  # laid out as asked: taken over and recorded
    assert spark.read.parquet(path).count() == 50 and sinks._recorded_buckets(spark, path) == 32
