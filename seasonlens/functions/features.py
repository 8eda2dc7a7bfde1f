"""Per-row feature columns (C1-C10) as built-in column expressions.

All date parts are computed from epoch seconds through DATE values, so they
do not depend on the session time zone: the result is the UTC calendar.
Divisions use ``try_divide`` so a zero duration gives NULL instead of an
ANSI ``DIVIDE_BY_ZERO`` error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trunc_div(c: str | Column, d: int) -> Column:
    """Integer division truncating toward zero (SQL ``div``)."""
    c = col_of(c)
    return ((c - c % F.lit(d)) / F.lit(d)).cast("long")


def floor_div(c: str | Column, d: int) -> Column:
    """Integer division rounding toward minus infinity (Python ``//``)."""
    c = col_of(c)
    return ((c - F.pmod(c, F.lit(d))) / F.lit(d)).cast("long")


def creation_seconds(ms: str | Column = "gameCreation") -> Column:
    """C1 input: epoch ms -> whole seconds, sub-second part dropped toward zero."""
    return trunc_div(ms, 1000)


def start_seconds(ms: str | Column = "gameStartTimestamp") -> Column:
    """The ingest floors the start time to seconds."""
    return floor_div(ms, 1000)


def utc_date(seconds: Column) -> Column:
    """Calendar date (UTC) of epoch seconds."""
    return F.date_from_unix_date(floor_div(seconds, 86400).cast("int"))


def utc_hour(seconds: Column) -> Column:
    return (F.pmod(seconds, F.lit(86400)) / F.lit(3600)).cast("long").cast("int")


def win_flag(win: str = "win") -> Column:
    """1 for a win; a NULL outcome counts as a loss."""
    return F.when(F.col(win) == F.lit(True), F.lit(1)).otherwise(F.lit(0))


def add_features(df: DataFrame) -> DataFrame:
    """C1-C9 on a player-match DataFrame (gameMode label is added by lookup)."""
    secs = creation_seconds("gameCreation")
    date = utc_date(secs)
    minutes = F.col("gameDuration") / F.lit(60)
    deaths = F.when(F.col("deaths") == 0, F.lit(1)).otherwise(F.col("deaths"))
    return df.withColumns(
        {
            "gameDate": F.timestamp_seconds(secs),
            "month": F.month(date),
            "hour": utc_hour(secs),
            "dayOfWeek": F.dayofweek(date),
            "csPerMin": F.try_divide(
                F.col("totalMinionsKilled") + F.col("neutralMinionsKilled"), minutes
            ),
            "kda": F.try_divide(F.col("kills") + F.col("assists"), deaths),
            "dmgPerMin": F.try_divide(F.col("totalDamageDealtToChampions"), minutes),
            "dmgTakenPerMin": F.try_divide(F.col("totalDamageTaken"), minutes),
            "hoursPlayed": F.col("gameDuration") / F.lit(3600),
        }
    )


def date_path_parts(df: DataFrame, ms_col: str = "gameStartTimestamp") -> DataFrame:
    """Year / month / day (UTC) of the game start, as INT partition keys."""
    date = utc_date(start_seconds(ms_col))
    return df.withColumns(
        {
            "year": F.year(date),
            "month_part": F.month(date),
            "day_part": F.dayofmonth(date),
        }
    )
