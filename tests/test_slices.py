"""Large runs go slice by slice: same rows, less on disk."""

from __future__ import annotations

import glob
import os

import pytest
from helpers import dims, rows
from pyspark.sql import functions as F

from seasonlens import session
from seasonlens.functions.features import add_features
from seasonlens.operators import document as doc


def _games(spark, tmp_dir, name="games"):
    """Games of twelve players and one without an id, in files, as slices go by the size of files."""
    games = rows(spark, *[
        {"matchId": f"m{i}", "puuid": None if i % 13 == 12 else f"p{i % 13}", "year": 2023 + i % 2, "championName": "AB"[i % 3 // 2],
         "win": i % 5 < 3, "gameCreation": 1_700_000_000_000 + i * 70_000_000} for i in range(120)])
    path = os.path.join(tmp_dir, name)
    games.withColumns({"month_part": (F.length("matchId") % 3 + 1).cast("int"), "day_part": F.lit(2)}).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _features(spark, tmp_dir):
    d = dims(spark)
    return d, d.mode(add_features(_games(spark, tmp_dir)))


def _staged(spark):
    base = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    return {os.path.basename(p) for p in glob.glob(os.path.join(base, "tables", "*")) if any(f for _, _, f in os.walk(p))}


def _docs(made):
    return sorted((str(r.puuid), r.year, r.summary_json) for r in doc.documents_as_json(made).collect())


@pytest.fixture()
def small_slices(spark, tmp_dir, monkeypatch):
    """Three slices of the games."""
    _games(spark, tmp_dir)
    size = sum(os.path.getsize(f) for f in glob.glob(os.path.join(tmp_dir, "games", "*.parquet")))
    monkeypatch.setattr(session, "SLICE_BYTES", size // 3 + 1)


def test_a_slice_goes_by_the_size_of_files(spark, tmp_dir):
    games = _games(spark, tmp_dir)
    size = sum(os.path.getsize(f) for f in glob.glob(os.path.join(tmp_dir, "games", "*.parquet")))
    assert session.slices_for(games, 8) == 1 and session.slices_for(games, 8, 1) == 8
    assert session.slices_for(games.join(games.select("puuid").distinct(), "puuid"), 99, size) in (2, 3)  # read twice
    assert session.slices_for(spark.createDataFrame([(1,)], "a int"), 8, 1) == 1


def test_staging_leaves_no_shuffle_files(spark):
    sc = spark.sparkContext
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key)
    store = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        return {str(store.getAllFiles().apply(i)) for i in range(store.getAllFiles().size())}

    before = files()
    copy = session.stage(spark.range(1000).repartition(3, F.col("id") % 5), "shuffled")
    left = {f for f in files() - before if "shuffle" in f}
    for _ in range(100):  # they go in the background
        if not left:
            break
        sc._jvm.Thread.sleep(100)
        left = {f for f in files() - before if "shuffle" in f}
    assert not left and copy.count() == 1000
    assert spark.conf.get(key) == own
    session.unstage(copy)


def test_documents_in_slices_are_the_same(spark, tmp_dir, small_slices, monkeypatch):
    d, feat = _features(spark, tmp_dir)
    whole = _docs(doc.build_documents(feat, d))
    before, asked = _staged(spark), []
    real = doc.stage_slices
    monkeypatch.setattr(doc, "stage_slices", lambda df, number, name: asked.append(name) or real(df, number, name))
    made = doc.build_documents(feat, d, stage_input=True)
    assert asked == ["document_rows"]
    assert _docs(made) == whole and len(whole) == 26
    left = {n.rsplit("-", 1)[0] for n in _staged(spark) - before}
    assert left <= {"documents", "item_names"}  # the games' copies are gone


def test_stored_documents_in_slices_are_the_same(spark, tmp_dir, small_slices):
    d, feat = _features(spark, tmp_dir)
    path = os.path.join(tmp_dir, "out")
    doc.write_summaries(feat, d, path, buckets=4)
    files = glob.glob(f"{path}/documents/*/*/part-*")
    assert files and all(f.endswith(".txt.gz") for f in files)
    whole = {(p, y): j for p, y, j in _docs(doc.build_documents(feat, d))}
    read = lambda: sorted((str(r.puuid), r.year, r.value) for r in doc.read_documents(spark, path).collect())
    assert read() == sorted((p, y, j) for (p, y), j in whole.items())
    # a rerun of some players' later games, with another number of buckets: the others stay
    some = feat.where((F.col("puuid") < "p4") & (F.col("month") >= 12))
    again = {(p, y): j for p, y, j in _docs(doc.build_documents(some, d))}
    assert 0 < len(again) < len(whole)
    doc.write_summaries(some, d, path, buckets=9)
    assert read() == sorted((p, y, j) for (p, y), j in (whole | again).items())


def test_fields_of_documents_are_taken_before_the_join(spark, tmp_dir):
    d, feat = _features(spark, tmp_dir)
    path = os.path.join(tmp_dir, "out")
    doc.write_summaries(feat, d, path)
    got = doc.read_documents(spark, path, columns=[F.get_json_object("value", "$.summary.global.totalGames").alias("n")])
    assert got.columns == ["puuid", "year", "n", "meta"] and got.agg(F.sum("n")).first()[0] == 120
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got.where("1 = 1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    joined, below = plan.split("Exchange", 1)
    assert "totalGames" not in joined and "totalGames" in below


def test_matches_are_written_in_slices_of_dates(spark, tmp_dir, small_slices, monkeypatch):
    from seasonlens.sources import matches as M

    games = _games(spark, tmp_dir)
    asked = []
    real = M.stage_slices
    monkeypatch.setattr(M, "stage_slices", lambda df, number, name: asked.append(name) or real(df, number, name))
    key = lambda df: sorted((r.matchId, r.year, r.month_part, r.kills) for r in df.collect())
    for fmt in ("parquet", "json"):
        path = os.path.join(tmp_dir, fmt)
        M.write_player_matches(games.withColumn("kills", F.lit(0).cast("long")), path, fmt=fmt)
        M.write_player_matches(games.where("year = 2024"), path, fmt=fmt)  # only its dates are replaced
        want = games.withColumn("kills", F.when(F.col("year") == 2024, F.col("kills")).otherwise(0))
        assert key(M.read_player_matches(spark, path, fmt)) == key(want)
        M.write_player_matches(games.where("year = 2023"), path, fmt=fmt, mode="append")
        assert M.read_player_matches(spark, path, fmt).count() == 180
    assert asked == ["match_rows"] * 6


def test_a_refresh_in_slices_is_the_same(spark, tmp_dir, monkeypatch):
    from seasonlens.sources.matches import read_player_matches, write_player_matches
    from seasonlens.streaming import runners as R

    monkeypatch.setattr(R, "SLICE_BYTES", 1000)
    monkeypatch.setattr(R, "TOUCHED", 12)
    d, games = dims(spark), _games(spark, tmp_dir).where("puuid is not null")
    table, out = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "docs")
    write_player_matches(games.withColumn("championName", F.lit("?")), table)
    before = _staged(spark)
    some = games.where("puuid <> 'p1'")
    R.refresh_batch(spark, some, 0, read_player_matches(spark, table), out, d)
    write_player_matches(games, table)
    R.refresh_batch(spark, some.where("puuid > 'p2'"), 0, read_player_matches(spark, table), out, d)
    assert {n.rsplit("-", 1)[0] for n in _staged(spark) - before} <= {"item_names"}
    fresh = {(p, y): j for p, y, j in _docs(doc.build_documents(d.mode(add_features(games)), d))}
    old = {(p, y): j for p, y, j in _docs(doc.build_documents(d.mode(add_features(games.withColumn("championName", F.lit("?")))), d))}
    want = {k: fresh[k] if k[0] > "p2" else old[k] for k in fresh if k[0] != "p1"}
    assert {(r.puuid, r.year): r.summary_json for r in R.latest_documents(spark, out).collect()} == want
    assert spark.read.parquet(out).groupBy("version").count().collect()  # versions 1 and 2
    n = F.get_json_object("summary_json", "$.summary.global.totalGames").cast("int").alias("n")
    got = R.latest_documents(spark, out, columns=[n])
    assert got.columns == ["puuid", "year", "n"] and got.agg(F.sum("n")).first()[0] == games.where("puuid <> 'p1'").count()


def test_one_document_files_are_parsed_once(spark, tmp_dir):
    from seasonlens.sources import matches as M

    docs = spark.range(40).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("puuid"), F.concat(F.lit("m"), "id").alias("matchId"), F.lit(2024).alias("year"),
        F.lit(1).alias("month_part"), F.lit(2).alias("day_part"),
        F.when(F.col("id") == 1, F.lit("{")).when(F.col("id") == 2, F.lit("[]")).when(F.col("id") == 3, F.lit('{"kills": 1}'))
        .otherwise(F.concat(F.lit('{"kills": 2, "matchId": "m'), "id", F.lit('"}'))).alias("value"))
    M.write_date_path_documents(docs, tmp_dir)
    for infer in (False, True):
        good, bad = M.read_date_path_documents(spark, tmp_dir, infer)
        for made in (good, bad):
            assert "FileScan json" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted((os.path.basename(r.path), r.reason) for r in bad.collect()) == [
            ("m1.json", "unparsable"), ("m2.json", "no document"), ("m3.json", "missing matchId")]
        assert good.count() == 37 and good.agg(F.sum("kills")).first()[0] == 74
