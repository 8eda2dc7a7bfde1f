"""Binding of the driver's test tables to the match data model (FIXTURES B).

The library itself works on player-match rows (``schema.PLAYER_MATCH_FIELDS``
plus ``puuid, year, month_part, day_part``).  The test tables are TPC-H
shaped, so this module derives match-shaped DataFrames from them with
integer arithmetic only, which lets DuckDB compute the same rows as oracle.
Every derived DataFrame is a lazy plan over the parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlens.functions.features import add_features, date_path_parts
from seasonlens.functions.lookup import Dimensions, merge_item_versions
from seasonlens.schema import PARTITION_COLUMNS, PLAYER_MATCH_FIELDS
from seasonlens.sources.dims import queues_to_modes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Fixed values of the binding (FIXTURES B.1): integer mixing constants.
_OFFSET = "(l_partkey*7919 + l_suppkey*104729 + l_linenumber*1299709) % 86400000"
_DAYS = "cast(datediff(cast(l_shipdate as date), date'1970-01-01') as bigint)"

_PLAYER_MATCH_EXPRS = {
    "puuid": "cast(o_custkey div 30 as bigint)",
    "matchId": (
        "concat_ws('_', cast(l_orderkey as string), cast(l_linenumber as string), "
        "cast(l_partkey as string), cast(l_suppkey as string), "
        "cast(cast(round(l_extendedprice*100) as bigint) as string))"
    ),
    "gameCreation": f"{_DAYS}*86400000 + {_OFFSET}",
    "gameStartTimestamp": f"{_DAYS}*86400000 + {_OFFSET} + l_linenumber*60000",
    "gameDuration": (
        "case when l_partkey % 97 = 0 then cast(0 as bigint) "
        "else cast(l_quantity as bigint)*36 + 900 end"
    ),
    "gameMode": "'CLASSIC'",
    "queueId": "cast(substr(o_orderpriority, 1, 1) as bigint)",
    "championName": "p_brand",
    "championId": "cast(substr(p_brand, 7) as bigint)",
    "teamPosition": "case when p_type = 'SMALL' then '' else p_type end",
    "individualPosition": "case when p_type = 'SMALL' then '' else p_type end",
    "kills": "l_partkey % 15",
    "deaths": "l_suppkey % 9",
    "assists": "l_orderkey % 21",
    "totalMinionsKilled": "l_partkey % 300",
    "neutralMinionsKilled": "l_suppkey % 60",
    "goldEarned": "l_orderkey % 15000",
    "totalDamageDealtToChampions": "l_partkey*13 % 40000",
    "totalDamageTaken": "l_suppkey*17 % 35000",
    "visionScore": "l_orderkey % 60",
    "win": "l_quantity >= 20",
    "items": (
        "array(l_partkey % 40, l_suppkey % 40, l_orderkey % 40, l_partkey % 7, "
        "l_suppkey % 7, cast(0 as bigint), l_orderkey % 3)"
    ),
    "summoner1Id": "l_suppkey % 27",
    "summoner2Id": "(l_partkey + l_linenumber) % 27",
    "perks": (
        "named_struct('primaryStyle', l_suppkey % 6, 'subStyle', l_partkey % 6, "
        "'primaryPerk', (l_suppkey % 6)*1000 + l_linenumber)"
    ),
}


def lineitem_orders_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # Both joins are left to Spark's size-based choice: lineitem x orders is
    # shuffled at scale and may spill, part is broadcast while it is small.
    # Orders come last, so the rows leave clustered by order and grouping them by order needs no shuffle.
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )


def player_matches_with_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``m`` keeping the start timestamp (ingest operators need it)."""
    rows = lineitem_orders_part(spark, sf_dir).select(*[F.expr(e).alias(k) for k, e in _PLAYER_MATCH_EXPRS.items()])
    return date_path_parts(rows)


def player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``m``: one stored player-match row per line item, with date keys."""
    return player_matches_with_start(spark, sf_dir).drop("gameStartTimestamp")


def season_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F3 input: (puuid, year, text, ask), a player-year's games in time order as words, and the words of its query."""
    game = F.concat_ws(" ", "championName", "teamPosition", F.when(F.col("win"), F.lit("won")).otherwise(F.lit("lost")))
    games = F.array_sort(F.collect_list(F.struct("gameCreation", "matchId", game.alias("words"))))
    return player_matches(spark, sf_dir).groupBy("puuid", "year").agg(
        F.array_join(F.transform(games, lambda g: g["words"]), " ").alias("text"),
        F.concat(F.max("championName"), F.lit(" won")).alias("ask"))


def date_path_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A2, B7 input: one stored document an order (of its matches the one with the greatest id), some spoilt by the
    order key: cut off, without a match id, an empty list, blank."""
    m = player_matches(spark, sf_dir)
    names = [f for f in m.columns if f != "matchId"]
    order = F.split("matchId", "_")[0].cast("long")
    last = m.groupBy(order.alias("_order")).agg(F.max(F.struct("matchId", *names)).alias("_m")).select("_order", "_m.*")
    fields = [c for c in PLAYER_MATCH_FIELDS.fieldNames() if c != "matchId"]
    whole = F.to_json(F.struct(F.when(F.col("_order") % 59 != 2, F.col("matchId")).alias("matchId"), *fields))
    k = F.col("_order")
    value = F.when(k % 53 == 1, F.substring(whole, 1, 40)).when(k % 61 == 3, F.lit("[]")).when(k % 67 == 4, F.lit(" \n")).otherwise(whole)
    return last.select("puuid", "matchId", *PARTITION_COLUMNS, value.alias("value"))


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table as a local relation (no Python-side RDD)."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(ddl)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


# Fixed values of the binding (FIXTURES B.2): the four queue label forms.
QUEUE_ROWS = [
    (1, "Map A", None, None),
    (2, "Map A", "Ranked", None),
    (3, "Map B", None, "old"),
    (4, "Map B", "Draft", "v2"),
]


def dimensions(spark: SparkSession, sf_dir: str) -> Dimensions:
    part = table(spark, sf_dir, "part")
    latest = part.where("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("id"),
        F.expr("case when p_partkey % 50 = 0 then '' else p_name end").alias("name"),
    )
    old = part.where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    spells = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")
    )
    runes = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")
    )
    queues = literal_rows(spark, QUEUE_ROWS, "queueId bigint, map string, description string, notes string")
    return Dimensions(
        items=merge_item_versions(latest, old),
        spells=spells,
        runes=runes,
        modes=queues_to_modes(queues),
    )


def features(spark: SparkSession, sf_dir: str, dims: Dimensions | None = None) -> DataFrame:
    """Feature table: ``m`` + C1-C9 + the gameMode label."""
    dims = dims or dimensions(spark, sf_dir)
    return dims.mode(add_features(player_matches(spark, sf_dir)))


# ------------------------------------------------------------ raw matches
def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B5 input: one nested match document per order, its line items as
    participants (player id = supplier key).  Line 7 of an order lacks its
    second rune style, so the extraction has malformed rows to quarantine."""
    lines = lineitem_orders_part(spark, sf_dir)
    first_style = "named_struct('style', l_suppkey % 6, 'selections', array(named_struct('perk', (l_suppkey % 6)*1000 + l_linenumber)))"
    second_style = "named_struct('style', l_partkey % 6, 'selections', cast(array() as array<struct<perk:bigint>>))"
    participant = F.struct(
        F.col("l_suppkey").cast("string").alias("puuid"),
        F.col("p_brand").alias("championName"),
        F.expr("cast(substr(p_brand, 7) as bigint)").alias("championId"),
        F.expr("case when p_type = 'SMALL' then '' else p_type end").alias("teamPosition"),
        F.expr("case when p_type = 'SMALL' then '' else p_type end").alias("individualPosition"),
        *[F.expr(_PLAYER_MATCH_EXPRS[c]).alias(c) for c in (
            "kills", "deaths", "assists", "totalMinionsKilled", "neutralMinionsKilled", "goldEarned",
            "totalDamageDealtToChampions", "totalDamageTaken", "visionScore", "win")],
        *[F.expr(_PLAYER_MATCH_EXPRS["items"])[i].alias(f"item{i}") for i in range(7)],
        F.expr(_PLAYER_MATCH_EXPRS["summoner1Id"]).alias("summoner1Id"),
        F.expr(_PLAYER_MATCH_EXPRS["summoner2Id"]).alias("summoner2Id"),
        F.struct(
            F.expr(f"case when l_linenumber = 7 then array({first_style}) else array({first_style}, {second_style}) end").alias("styles")
        ).alias("perks"),
    )
    created = "cast(datediff(cast(o_orderdate as date), date'1970-01-01') as bigint)*86400000 + (o_orderkey*7919) % 86400000"
    per_order = lines.groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("l_linenumber").alias("_ln"), F.col("l_partkey").alias("_pk"),
            F.expr("round(l_extendedprice*100)").alias("_price"), participant.alias("_p"),
        ))).alias("_ps")
    )
    return per_order.select(
        F.struct(F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("matchId")).alias("metadata"),
        F.struct(
            F.expr(created).alias("gameCreation"),
            F.expr(f"{created} + 60000").alias("gameStartTimestamp"),
            F.expr("900 + o_orderkey % 1800").alias("gameDuration"),
            F.lit("CLASSIC").alias("gameMode"),
            F.expr("cast(substr(o_orderpriority, 1, 1) as bigint)").alias("queueId"),
            F.transform("_ps", lambda x: x["_p"]).alias("participants"),
        ).alias("info"),
    )


def stored_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7-B9 'already stored': rows of ``m`` whose part key is even."""
    return player_matches(spark, sf_dir).where(
        F.element_at(F.split("matchId", "_"), 3).cast("long") % 2 == 0
    )


# ------------------------------------------------------------ requests
# Fixed values of the binding: region codes indexed by c_nationkey % 16
# (case and blank variants, one empty, two codes the routing table lacks).
REGION_CODES = [
    "na1", "euw1", "eun1", "KR", "br1", " la1", "la2", "oc1",
    "tr1", "ru", "jp1", "sg2", "tw2", "ph2", "th2", "",
]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12-B16 input: one request per customer, handle variants by key % 10."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    codes = F.array(*[F.lit(x) for x in REGION_CODES])
    v = F.col("c_custkey") % 10
    name = F.col("c_name")
    riot = (
        F.when(v == 0, F.lit(None).cast("string"))
        .when(v == 1, F.lit(""))
        .when(v == 2, F.regexp_replace(name, "#", " "))
        .when(v == 3, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(v == 4, F.concat(F.substring(name, 1, 4), F.lit(" "), F.substring(name, 5, 1000)))
        .when(v == 5, F.concat(name, F.lit("#x/y")))
        .otherwise(name)
    )
    summoner = F.when(v == 0, name).when(v == 1, F.lit("")).otherwise(F.lit(None).cast("string"))
    region = F.when(F.col("c_custkey") % 13 == 0, F.lit(None).cast("string")).otherwise(
        codes[(F.col("c_nationkey") % 16).cast("int")]
    )
    return c.select("c_custkey", riot.alias("riotId"), summoner.alias("summonerName"), region.alias("region"))


# ------------------------------------------------------------ events
# Fixed values of the binding: event type -> progress state.
EVENT_STATES = {
    "signup": "START_RETRIEVE_MATCH",
    "view": "RETRIEVING_MATCH",
    "click": "PROCESSING_MATCH",
    "error": "GENERATING_FACTS",
    "purchase": "COMPLETE",
}


def progress_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G3 input: events as progress messages of job = user."""
    ev = table(spark, sf_dir, "events")
    state = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])[F.col("event_type")]
    return ev.select(
        F.col("user_id").alias("job"),
        F.struct("ts", "event_id").alias("seq"),
        state.alias("state"),
        F.when(F.col("event_type") == "signup", F.lit(100).cast("long")).alias("total"),
        F.floor("value").cast("long").alias("count"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4-G5 input: an event is an answer of user to question = event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("player"),
        F.col("event_type").alias("question"),
        (F.floor("value").cast("long") % 4).alias("choice"),
        "ts", "event_id",
    )


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 input: model replies around the event props, six shapes by id % 6."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    v = F.col("event_id") % 6
    text = (
        F.when(v == 0, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(v == 1, F.concat(F.lit("Here: ["), F.col("props"), F.lit("] done")))
        .when(v == 2, F.concat(F.lit("No list, only "), F.col("props")))
        .when(v == 3, F.col("props"))
        .when(v == 4, F.concat(F.lit("[1, "), F.col("props"), F.lit("]")))
        .otherwise(F.concat(F.lit("Here: ["), F.col("props"), F.lit("; ] done")))
    )
    return ev.select("event_id", text.alias("text"))
