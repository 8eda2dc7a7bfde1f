"""Command-line jobs: ingest raw matches, build summary documents.

    python -m seasonlens.jobs ingest  --raw RAW --table TABLE [--year Y] [--puuid P] [--quarantine Q]
    python -m seasonlens.jobs summary --table TABLE --dims DIR --out OUT [--year Y] [--puuid P]

Both work on every player at once; ``--puuid`` narrows to one player (the
reference's per-player job) and ``--year`` to one year (partition pruning).
``--dims`` holds the catalogue documents ``items_latest.json``,
``items_first.json``, ``spells.json``, ``runes.json`` and ``queues.json``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seasonlens.functions.features import add_features
from seasonlens.functions.lookup import Dimensions, merge_item_versions
from seasonlens.operators import ingest
from seasonlens.operators.document import build_documents, write_documents
from seasonlens.session import apply_sql_conf, path_exists
from seasonlens.sources import dims as D
from seasonlens.sources.matches import read_date_path_documents, read_player_matches, scoped, write_player_matches


def load_dimensions(spark: SparkSession, folder: str) -> Dimensions:
    f = lambda name: os.path.join(folder, name)
    return Dimensions(
        items=merge_item_versions(D.read_items(spark, f("items_latest.json")), D.read_items(spark, f("items_first.json"))),
        spells=D.read_spells(spark, f("spells.json")),
        runes=D.read_rune_styles(spark, f("runes.json")),
        modes=D.read_queues(spark, f("queues.json")),
    )


def ingest_job(spark: SparkSession, raw: str, table: str, year: int | None = None, puuid: str | None = None,
               quarantine: str | None = None) -> None:
    """B1-B11 + A4: extract player rows, quarantine malformed ones, append only unseen matches."""
    apply_sql_conf(spark)
    matches, broken = ingest.read_raw_matches(spark, raw)
    # malformed rows are split off first: a row without a start time belongs to no year
    valid, bad = ingest.split_malformed(ingest.extract_player_rows(matches, puuid))
    if year is not None:
        valid = ingest.in_year(valid, year)
    valid = ingest.one_per_match(valid.drop("gameStartTimestamp"))
    if path_exists(spark, table):
        valid = ingest.new_matches(valid, read_player_matches(spark, table).select(*ingest.MATCH_KEYS))
    write_player_matches(valid, table, mode="append")
    if quarantine:
        found = bad.unionByName(broken).withColumn("source", F.lit(raw))
        if path_exists(spark, quarantine):  # a rerun over the same input adds only what it did not put there before
            stored = spark.read.schema(found.schema).parquet(quarantine).where(F.col("source") == raw)
            found = found.exceptAll(stored)
        found.write.mode("append").parquet(quarantine)


def summary_job(spark: SparkSession, table: str, dims_folder: str, out: str, year: int | None = None,
                puuid: str | None = None, date_path: bool = False) -> None:
    """E1-E26 + A9-A11: documents for every (player, year) in scope."""
    apply_sql_conf(spark)
    dims = load_dimensions(spark, dims_folder)
    # the stored layout is either partitioned parquet or one JSON document a file under a date path
    stored = read_date_path_documents(spark, table)[0] if date_path else read_player_matches(spark, table)
    feat = dims.mode(add_features(scoped(stored, puuid, year)))
    write_documents(build_documents(feat, dims), out)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seasonlens.jobs")
    sub = parser.add_subparsers(dest="job", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--raw", required=True)
    a.add_argument("--table", required=True)
    a.add_argument("--quarantine")
    b = sub.add_parser("summary")
    b.add_argument("--table", required=True)
    b.add_argument("--dims", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--date-path", action="store_true", help="one JSON document a file under {puuid}/stats/Y/MM/DD/")
    for p in (a, b):
        p.add_argument("--year", type=lambda y: dt.datetime.now(dt.timezone.utc).year - 1 if y == "last" else int(y),
                       help="a calendar year, or 'last' for the one before the current (UTC)")
        p.add_argument("--puuid")
    args, _ = parser.parse_known_args(argv)
    spark = SparkSession.builder.appName(f"seasonlens-{args.job}").getOrCreate()
    if args.job == "ingest":
        ingest_job(spark, args.raw, args.table, args.year, args.puuid, args.quarantine)
    else:
        summary_job(spark, args.table, args.dims, args.out, args.year, args.puuid, args.date_path)


if __name__ == "__main__":
    main()
