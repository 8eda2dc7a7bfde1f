"""Quiz facts (F4-F7): deterministic facts from the summaries, and checks.

The reference asks a hosted model for ten facts about a player-year.  The
data behind them is all in the summary sections, so here every fact kind is
a small aggregation per ``(puuid, year)``: the answer is the top row and the
distractors are the next ranks (or fixed offsets for numbers).  Choices are
put in a stable pseudo-random order by hashing, so reruns give the same quiz.

``validate_facts`` checks fact arrays from any source (model output parsed
with ``functions.text.extract_json_array`` included).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonlens import schema
from seasonlens.functions.features import win_flag

KEYS = ("puuid", "year")
FACTS_PER_PLAYER = 10
OUT = ("kind_no", "kind", "fact", "context", "question", "choices", "correct_answer")


def shuffled(choices: Column, seed: Column) -> Column:
    """Choices ordered by md5(seed|choice): stable, engine-independent order."""
    tagged = F.transform(choices, lambda c: F.struct(F.md5(F.concat(seed, F.lit("|"), c)).alias("h"), c.alias("c")))
    return F.transform(F.array_sort(tagged), lambda s: s["c"])


def _seed(keys: Sequence[str], kind: str) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(kind))


# Feature columns the fact numbers read.
FACT_COLUMNS = ("championName", "teamPosition", "month", "gameMode", "win", "visionScore", "assists", "gameDuration", "hour")

# Grouping columns (besides the keys) of the count-based fact kinds.
_FACT_SETS = {
    "champion": ("championName",),
    "role": ("_role",),
    "month": ("month",),
    "mode": ("gameMode",),
    "key": (),
}


def fact_numbers(feat: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Everything the count-based kinds need, one row per key.

    One GROUPING SETS pass counts games and wins per champion, role, month and mode, and the key's own
    numbers; one window ranks the labels of every set; one aggregation collects the leaders of each set (``champion``,
    ``role``, ``month``, ``mode``, ``best``: at most four of (rank, label, value)) beside ``key``.
    The sets are never split into branches, so the pass is not repeated.
    """
    keys = list(keys)
    role = F.when(F.col("teamPosition") == "", F.lit("UNASSIGNED")).otherwise(F.col("teamPosition"))
    base = feat.select(
        *keys, "championName", role.alias("_role"), "month", "gameMode", "win", "visionScore", "assists",
        "gameDuration", "hour",
    )
    cols = [*keys, *[c for cs in _FACT_SETS.values() for c in cs]]
    agg = base.groupingSets([[*keys, *cs] for cs in _FACT_SETS.values()], *cols).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(win_flag()).alias("_w"),
        F.max("visionScore").alias("vision"),
        F.sum("assists").alias("assists"),
        F.min(F.when(F.col("win") & (F.col("gameDuration") > 0), F.col("gameDuration"))).alias("fastest"),
        F.count(F.when((F.col("hour") >= 22) | (F.col("hour") < 4), F.lit(1))).alias("night"),
        F.grouping_id().alias("_gid"),
    )
    gid = {n: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in (*keys, *cs)) for n, cs in _FACT_SETS.items()}
    of = {n: F.col("_gid") == g for n, g in gid.items()}
    label = F.coalesce("championName", "_role", F.col("month").cast("string"), "gameMode")
    pct = (F.col("_w") * 100 / F.col("_n")).cast("long")
    each = Window.partitionBy(*keys, "_gid")
    # Only one label column is set in a set's rows; months rank by number, the others by text.
    ranked = agg.withColumns({"_label": label, "_pct": pct}).withColumns({
        "_r": F.row_number().over(each.orderBy(F.desc("_n"), F.asc("month"), F.asc("_label"))),
        "_b": F.row_number().over(each.orderBy(F.desc(F.col("_n") >= BEST_GAMES), F.desc("_pct"), F.desc("_n"), F.asc("_label"))),
    }).where((F.col("_r") <= 4) | (F.col("_b") <= 4))
    leaders = lambda cond, rank, value: F.array_sort(F.collect_list(
        F.when(cond & (F.col(rank) <= 4), F.struct(F.col(rank).alias("_r"), "_label", F.col(value).alias("_value")))))
    best = of["champion"] & (F.col("_n") >= BEST_GAMES)
    return ranked.groupBy(*keys).agg(
        *[leaders(of[n], "_r", "_n").alias(n) for n in ("champion", "role", "month", "mode")],
        leaders(best, "_b", "_pct").alias("best"),
        F.first(F.when(of["key"], F.struct(F.col("_n").alias("games"), "vision", "assists", "fastest", "night")), ignorenulls=True).alias("key"),
    )


# A champion needs this many games to be the best one.
BEST_GAMES = 3


def _fact(keys, kind_no: int, kind: str, fact: Column, context: str, question: Column, choices: Column, answer: Column,
          given: Column, shuffle: bool = True) -> Column:
    """One fact as a struct, NULL where the key has no data for it (``given``)."""
    return F.when(given, F.struct(
        F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), fact.alias("fact"), F.lit(context).alias("context"),
        question.alias("question"), (shuffled(choices, _seed(keys, kind)) if shuffle else choices).alias("choices"),
        answer.alias("correct_answer")))


def _leader(keys, kind_no, kind, col: str, fact_fmt: str, context: str, question: Column) -> Column:
    """The first of a set's leaders, the next three as distractors."""
    first = F.get(F.col(col), F.lit(0))
    return _fact(keys, kind_no, kind, F.format_string(fact_fmt, first["_label"], first["_value"]), context, question,
                 F.transform(col, lambda t: t["_label"]), first["_label"], F.size(col) > 0)


def _number(keys, kind_no, kind, value: Column, offsets, fact_fmt: str, context: str, question: Column) -> Column:
    """A number, three distractors derived from it."""
    answer = value.cast("string")
    choices = F.array(answer, *[o(value).cast("string") for o in offsets])
    return _fact(keys, kind_no, kind, F.format_string(fact_fmt, value), context, question, choices, answer, value.isNotNull())


def _true_false(keys, kind_no, kind, truth: Column, fact: Column, context: str, question: str, given: Column) -> Column:
    answer = F.when(truth, F.lit("True")).otherwise(F.lit("False"))
    return _fact(keys, kind_no, kind, fact, context, F.lit(question), F.array(F.lit("True"), F.lit("False")), answer, given, shuffle=False)


def fact_candidates(feat: DataFrame, longest: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (key, fact kind), kinds in a fixed order; all kinds are built in one projection."""
    keys = list(keys)
    year = F.col(keys[1])
    rows = fact_numbers(feat, keys).join(longest.select(*keys, F.col("longestWinStreak.length").alias("_streak")), keys, "left")
    key, streak = F.col("key"), F.col("_streak")
    night, games = key["night"], key["games"]
    shift = lambda n: lambda v: v + n
    facts = [
        _leader(keys, 1, "most_played_champion", "champion", "You played %s more than any other champion: %d games.",
                "Comfort picks win games.", F.format_string("Which champion did you play the most in %d?", year)),
        _leader(keys, 2, "favourite_role", "role", "Your favourite role was %s with %d games.",
                "Everyone has a home on the map.", F.lit("Which role did you play the most?")),
        _leader(keys, 3, "busiest_month", "month", "Your busiest month was month %s with %d games.",
                "Some months the queue just calls.", F.lit("In which month did you play the most games?")),
        _leader(keys, 4, "most_played_mode", "mode", "Your most played mode was %s with %d games.",
                "You know what you like.", F.lit("Which game mode did you play the most?")),
        _leader(keys, 5, "best_champion", "best", "Your best champion was %s with a %d%% win rate.",
                "Numbers do not lie.", F.lit("Which champion (3+ games) had your best win rate?")),
        _true_false(keys, 6, "longest_win_streak", streak >= 5, F.format_string("Your longest win streak was %d games.", streak),
                    "Momentum is real.", "True or false: your longest win streak was at least 5 games.", streak.isNotNull()),
        _number(keys, 7, "highest_vision", key["vision"], [shift(7), shift(14), shift(21)],
                "Your highest vision score in one game was %d.", "Wards win wars.",
                F.lit("What was your highest vision score in a single game?")),
        _number(keys, 8, "total_assists", key["assists"],
                [lambda a: a + F.floor(a / 4).cast("long") + 1, lambda a: a + F.floor(a / 2).cast("long") + 2, lambda a: a * 2 + 3],
                "You made %d assists this year.", "A true team player.",
                F.format_string("How many assists did you make in %d?", year)),
        _number(keys, 9, "fastest_win", F.floor(key["fastest"] / 60).cast("long"), [shift(3), shift(6), shift(9)],
                "Your fastest win took %d minutes.", "Quick and clean.", F.lit("How many minutes did your fastest win last?")),
        _true_false(keys, 10, "night_owl", night * 4 > games,
                    F.format_string("%d of your %d games started between 22:00 and 04:00.", night, games),
                    "Late games, bright screens.",
                    "True or false: more than a quarter of your games started between 22:00 and 04:00.", games.isNotNull()),
    ]
    made = rows.select(*keys, F.explode(F.filter(F.array(*facts), lambda f: f.isNotNull())).alias("_f"))
    return made.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in OUT])


def nest_facts(candidates: DataFrame, keys: Sequence[str] = KEYS, limit: int = FACTS_PER_PLAYER) -> DataFrame:
    """Facts per key as ``array<fact>`` in kind order, at most ``limit``."""
    keys = list(keys)
    sorted_ = F.array_sort(F.collect_list(F.struct("kind_no", *[c for c in OUT if c != "kind_no"])))
    fields = [f.name for f in schema.FACT.fields]
    return candidates.groupBy(*keys).agg(
        F.transform(F.slice(sorted_, 1, limit), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("facts")
    )


def validate_facts(df: DataFrame, facts_col: str = "facts", expected: int = FACTS_PER_PLAYER) -> DataFrame:
    """per row, facts count, valid count and an overall ``ok`` flag.

    A fact is valid when its five fields are present, it has choices and the
    correct answer is one of them.
    """
    def valid(f: Column) -> Column:
        present = reduce(lambda x, y: x & y, [f[n].isNotNull() for n in ("fact", "context", "question", "correct_answer")])
        return present & (F.size(f["choices"]) > 0) & F.array_contains(f["choices"], f["correct_answer"])

    n = F.coalesce(F.size(facts_col), F.lit(0))
    nvalid = F.coalesce(F.size(F.filter(facts_col, valid)), F.lit(0))
    return df.withColumns({
        "nFacts": n.cast("long"),
        "nValid": nvalid.cast("long"),
        "ok": (n == expected) & (nvalid == expected),
    })
