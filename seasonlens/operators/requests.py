"""Requests and gating (B12-B20) as column expressions and joins.

The reference answers one HTTP request at a time; here a DataFrame of
requests (or work keys) is normalised, validated, routed and checked
against running work in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlens.functions.text import percent_encode

# Platform region -> routing group (unknown -> americas).
ROUTING = {
    "na1": "americas", "br1": "americas", "la1": "americas", "la2": "americas",
    "euw1": "europe", "eun1": "europe", "tr1": "europe", "ru": "europe",
    "kr": "asia", "jp1": "asia",
    "oc1": "sea", "sg2": "sea", "tw2": "sea", "vn2": "sea",
}
DEFAULT_ROUTING = "americas"
DEFAULT_REGION = "na1"

# Platform region -> display label (unknown -> upper case).
REGION_LABELS = {
    "na1": "NA", "euw1": "EUW", "eun1": "EUNE", "kr": "KR", "br1": "BR", "la1": "LAN", "la2": "LAS",
    "oc1": "OCE", "tr1": "TR", "ru": "RU", "jp1": "JP", "sg2": "SG", "tw2": "TW", "vn2": "VN",
}

# The error texts returned for rejected requests.
ERR_REQUIRED = "Riot ID is required (e.g., GameName#TAG)"
ERR_FORMAT = "Please use Riot ID format: GameName#TAG (e.g., Hide on bush#KR1)"


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def strip(c: Column) -> Column:
    """Leading / trailing whitespace removed (like Python's ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _blank_to_null(c: Column) -> Column:
    return F.when(c == F.lit(""), F.lit(None)).otherwise(c)


def routing_value(region: Column) -> Column:
    """Routing group of a platform region."""
    return F.coalesce(F.try_element_at(_literal_map(ROUTING), region), F.lit(DEFAULT_ROUTING))


def account_routing(routing: Column) -> Column:
    """Account lookups of the ``sea`` group go to ``asia``."""
    return F.when(routing == F.lit("sea"), F.lit("asia")).otherwise(routing)


def display_region(code: Column) -> Column:
    """Display label; unknown -> upper case, NULL or empty -> ''."""
    label = F.coalesce(F.try_element_at(_literal_map(REGION_LABELS), F.lower(code)), F.upper(code))
    return F.when(code.isNull() | (code == F.lit("")), F.lit("")).otherwise(label)


def parse_requests(req: DataFrame, riot_id: str = "riotId", summoner_name: str = "summonerName", region: str = "region") -> DataFrame:
    """Normalise, validate, split and route every request.

    Adds ``handle, region_code, status, error, game_name, tag_line,
    routing_value, account_routing, region_label``.  ``status`` is 200 for a
    valid request and 400 for a rejected one (then the other fields are NULL).
    """
    handle = strip(F.coalesce(_blank_to_null(F.col(riot_id)), _blank_to_null(F.col(summoner_name)), F.lit("")))
    code = F.lower(strip(F.coalesce(_blank_to_null(F.col(region)), F.lit(DEFAULT_REGION))))
    out = req.withColumns({"handle": handle, "region_code": code})
    h = F.col("handle")
    error = (
        F.when(h == F.lit(""), F.lit(ERR_REQUIRED))
        .when(F.instr(h, "#") == 0, F.lit(ERR_FORMAT))
    )
    ok = error.isNull()
    routing = routing_value(F.col("region_code"))
    return out.withColumns(
        {
            "status": F.when(ok, F.lit(200)).otherwise(F.lit(400)),
            "error": error,
            "game_name": F.when(ok, percent_encode(F.substring_index(h, "#", 1))),
            "tag_line": F.when(ok, percent_encode(F.expr("substr(handle, instr(handle, '#') + 1)"))),
            "routing_value": F.when(ok, routing),
            "account_routing": F.when(ok, account_routing(routing)),
            "region_label": display_region(F.col("region_code")),
        }
    )


def default_year(year: int | None = None, as_of: Column | None = None) -> Column:
    """The requested year, by default the calendar year (UTC) before ``as_of``, which is today unless given."""
    if year is not None:
        return F.lit(year)
    return F.year(F.current_date() if as_of is None else as_of) - F.lit(1)


def work_flags(keys: DataFrame, summaries: DataFrame, finals: DataFrame, on: Sequence[str] = ("puuid", "year")) -> DataFrame:
    """``summary_exists`` / ``final_exists`` per work key via left joins."""
    on = list(on)
    s = summaries.select(*on).distinct().withColumn("summary_exists", F.lit(True))
    f = finals.select(*on).distinct().withColumn("final_exists", F.lit(True))
    return (
        keys.join(s, on, "left").join(f, on, "left")
        .withColumn("summary_exists", F.coalesce("summary_exists", F.lit(False)))
        .withColumn("final_exists", F.coalesce("final_exists", F.lit(False)))
    )


def route(summary_exists: str = "summary_exists", final_exists: str = "final_exists") -> Column:
    """Final -> serve facts; summary -> generate facts; else full run."""
    return (
        F.when(F.col(final_exists), F.lit("facts_only_read"))
        .when(F.col(summary_exists), F.lit("facts_from_summary"))
        .otherwise(F.lit("full_run"))
    )


def guard_running(work: DataFrame, running: DataFrame, on: Sequence[str] = ("puuid", "year")) -> DataFrame:
    """``action`` = BUSY for a key already running unless both outputs exist.

    Only requests that still need work are checked, as in the reference.
    """
    on = list(on)
    busy = running.select(*on).distinct().withColumn("_running", F.lit(True))
    needs_work = ~(F.col("summary_exists") & F.col("final_exists"))
    return work.join(busy, on, "left").withColumn(
        "action",
        F.when(needs_work & F.coalesce(F.col("_running"), F.lit(False)), F.lit("BUSY")).otherwise(F.lit("START")),
    ).drop("_running")
