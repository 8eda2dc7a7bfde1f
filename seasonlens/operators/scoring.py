"""Answer scoring (G4-G5): first answer per question counts, equality check.

Works on batch and streaming DataFrames alike (``min_by`` aggregation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_answers(answers: DataFrame, player: str, question: str, choice: str, order: Sequence[str]) -> DataFrame:
    """The first answer (by ``order``) of each player to each question."""
    return answers.groupBy(player, question).agg(
        F.min_by(F.col(choice), F.struct(*order)).alias(choice)
    )


def score_tier(correct: Column, total: Column) -> Column:
    """All correct / at least half / below half."""
    return (
        F.when(correct == total, F.lit("all_correct"))
        .when(correct >= total / F.lit(2), F.lit("half_or_more"))
        .otherwise(F.lit("below_half"))
    )


def score(
    answers: DataFrame,
    facts: DataFrame,
    player: str = "player",
    question: str = "question",
    choice: str = "choice",
    correct: str = "correct_answer",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Per player, questions answered, correct answers, quiz size, tier."""
    first = first_answers(answers, player, question, choice, order)
    per_q = facts.select(player, question, correct).join(first, [player, question], "left")
    out = per_q.groupBy(player).agg(
        F.count(F.col(choice)).alias("answered"),
        F.count(F.when(F.col(choice) == F.col(correct), F.lit(1))).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.withColumn("tier", score_tier(F.col("correct"), F.col("total")))
