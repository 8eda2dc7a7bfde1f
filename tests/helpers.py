"""Hand-built player-match rows for semantics tests."""

from __future__ import annotations

from seasonlens import schema
from pyspark.sql import types as T

ROW_SCHEMA = T.StructType(
    [T.StructField("puuid", T.StringType()), *schema.PLAYER_MATCH_FIELDS.fields,
     T.StructField("year", T.IntegerType())]
)

BASE = dict(
    puuid="p1", matchId="m", gameCreation=1_704_067_200_000, gameDuration=1800, gameMode="CLASSIC", queueId=1,
    championName="Ahri", championId=103, teamPosition="MIDDLE", individualPosition="MIDDLE", kills=5, deaths=2,
    assists=3, totalMinionsKilled=150, neutralMinionsKilled=30, goldEarned=10000,
    totalDamageDealtToChampions=20000, totalDamageTaken=15000, visionScore=20, win=True,
    items=[1001, 0, 3020, 0, 0, 0, 3340], summoner1Id=4, summoner2Id=14,
    perks={"primaryStyle": 8100, "subStyle": 8300, "primaryPerk": 8112}, year=2024,
)


def rows(spark, *overrides):
    out = []
    for i, o in enumerate(overrides):
        r = dict(BASE)
        r["matchId"] = f"m{i:03d}"
        r["gameCreation"] = BASE["gameCreation"] + i * 3_600_000
        r.update(o)
        out.append(tuple(r[f.name] for f in ROW_SCHEMA.fields))
    return spark.createDataFrame(out, ROW_SCHEMA)


def dims(spark, items=None, spells=None, runes=None, modes=None):
    from seasonlens.functions.lookup import Dimensions

    d = "id bigint, name string"
    return Dimensions(
        items=spark.createDataFrame(items or [(1001, "Boots")], d),
        spells=spark.createDataFrame(spells or [(4, "Flash"), (14, "Ignite")], d),
        runes=spark.createDataFrame(runes or [(8100, "Domination"), (8300, "Inspiration")], d),
        modes=spark.createDataFrame(modes or [(1, "Map A")], d),
    )
