"""Explicit schemas of every document the library reads or writes.

Reading with a declared schema avoids the extra inference pass over the
input (and the type drift between files) that schema inference brings.
"""

from __future__ import annotations

from pyspark.sql import types as T

L = T.LongType()
S = T.StringType()
B = T.BooleanType()

# Participant of a raw match document.
PARTICIPANT = T.StructType(
    [
        T.StructField("puuid", S),
        T.StructField("championName", S),
        T.StructField("championId", L),
        T.StructField("teamPosition", S),
        T.StructField("individualPosition", S),
        *[
            T.StructField(name, L)
            for name in (
                "kills",
                "deaths",
                "assists",
                "totalMinionsKilled",
                "neutralMinionsKilled",
                "goldEarned",
                "totalDamageDealtToChampions",
                "totalDamageTaken",
                "visionScore",
            )
        ],
        T.StructField("win", B),
        *[T.StructField(f"item{i}", L) for i in range(7)],
        T.StructField("summoner1Id", L),
        T.StructField("summoner2Id", L),
        T.StructField(
            "perks",
            T.StructType(
                [
                    T.StructField(
                        "styles",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("style", L),
                                    T.StructField(
                                        "selections",
                                        T.ArrayType(T.StructType([T.StructField("perk", L)])),
                                    ),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)

# Raw match document: metadata + info with all participants.
RAW_MATCH = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField("matchId", S)])),
        T.StructField(
            "info",
            T.StructType(
                [
                    T.StructField("gameCreation", L),
                    T.StructField("gameStartTimestamp", L),
                    T.StructField("gameDuration", L),
                    T.StructField("gameMode", S),
                    T.StructField("queueId", L),
                    T.StructField("participants", T.ArrayType(PARTICIPANT)),
                ]
            ),
        ),
    ]
)

PERKS = T.StructType(
    [
        T.StructField("primaryStyle", L),
        T.StructField("subStyle", L),
        T.StructField("primaryPerk", L),
    ]
)

# One stored player-match row (the 23 fields of the stored document).
PLAYER_MATCH_FIELDS = T.StructType(
    [
        T.StructField("matchId", S),
        T.StructField("gameCreation", L),
        T.StructField("gameDuration", L),
        T.StructField("gameMode", S),
        T.StructField("queueId", L),
        T.StructField("championName", S),
        T.StructField("championId", L),
        T.StructField("teamPosition", S),
        T.StructField("individualPosition", S),
        T.StructField("kills", L),
        T.StructField("deaths", L),
        T.StructField("assists", L),
        T.StructField("totalMinionsKilled", L),
        T.StructField("neutralMinionsKilled", L),
        T.StructField("goldEarned", L),
        T.StructField("totalDamageDealtToChampions", L),
        T.StructField("totalDamageTaken", L),
        T.StructField("visionScore", L),
        T.StructField("win", B),
        T.StructField("items", T.ArrayType(L)),
        T.StructField("summoner1Id", L),
        T.StructField("summoner2Id", L),
        T.StructField("perks", PERKS),
    ]
)

# Player-match table: stored row + the keys the date path carried.
PARTITION_COLUMNS = ("year", "month_part", "day_part")

# Dimension documents as published by the game's static data service.
ITEM_DOC = T.StructType(
    [T.StructField("data", T.MapType(S, T.StructType([T.StructField("name", S)])))]
)
SPELL_DOC = T.StructType(
    [
        T.StructField(
            "data",
            T.MapType(S, T.StructType([T.StructField("key", S), T.StructField("name", S)])),
        )
    ]
)
RUNE_STYLE = T.StructType([T.StructField("id", L), T.StructField("name", S)])
QUEUE = T.StructType(
    [
        T.StructField("queueId", L),
        T.StructField("map", S),
        T.StructField("description", S),
        T.StructField("notes", S),
    ]
)

# Quiz fact and progress message.
FACT = T.StructType(
    [
        T.StructField("fact", S),
        T.StructField("context", S),
        T.StructField("question", S),
        T.StructField("choices", T.ArrayType(S)),
        T.StructField("correct_answer", S),
    ]
)
FACT_ARRAY = T.ArrayType(FACT)

PROGRESS_MESSAGE = T.StructType(
    [
        T.StructField("state", S),
        T.StructField("total", L),
        T.StructField("count", L),
        T.StructField("result", FACT_ARRAY),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("riotId", S),
        T.StructField("summonerName", S),
        T.StructField("region", S),
    ]
)

WORK_KEY = T.StructType(
    [
        T.StructField("puuid", S),
        T.StructField("year", T.IntegerType()),
        T.StructField("summary_exists", B),
        T.StructField("final_exists", B),
        T.StructField("routing_value", S),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", S),
        T.StructField("text", S),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("puuid", S),
        T.StructField("year", T.IntegerType()),
    ]
)
