"""Progress messages (G1-G3): parse, fold to (state, percent) per job.

The fold is mergeable: ``partial_progress`` reduces any set of messages to one small row per job and
``merged_progress`` folds such rows.  A batch query runs both; the stream appends the partial rows of each
micro-batch and readers merge them, so the stream itself keeps no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlens import schema

# Progress states and the percent shown for each.
START = "START_RETRIEVE_MATCH"
RETRIEVING = "RETRIEVING_MATCH"
PROCESSING = "PROCESSING_MATCH"
GENERATING = "GENERATING_FACTS"
COMPLETE = "COMPLETE"
BUSY = "BUSY"
FAIL = "FAIL"
FIXED_PERCENT = {START: 5, PROCESSING: 75, GENERATING: 90, COMPLETE: 100, BUSY: 0, FAIL: 0}
# The text shown for each state ({total} and {count} are filled in).
LABELS = {
    BUSY: "Another seeker is already weaving this tale... ⌛",
    FAIL: "The arcane process has faltered... ❌",
    START: "Peering into {total} echoes...",
    RETRIEVING: "Collecting shards: {count} / {total}",
    PROCESSING: "Distilling patterns from the chaos...",
    GENERATING: "Assembling enchanted trivia...",
    COMPLETE: "Finalizing your chronicle...",
}
KNOWN_STATES = (BUSY, FAIL, START, RETRIEVING, PROCESSING, GENERATING, COMPLETE)


def parse_messages(raw: DataFrame, text_col: str = "value", key_fields=()) -> tuple[DataFrame, DataFrame]:
    """JSON text -> (messages, malformed).  Malformed rows keep their text.

    ``key_fields`` (StructFields, e.g. job and sequence) are parsed next to
    the message fields and must be present for a message to count.
    """
    from pyspark.sql import types as T

    full = T.StructType([*key_fields, *schema.PROGRESS_MESSAGE.fields])
    parsed = raw.withColumn("_m", F.from_json(F.col(text_col), full))
    ok = F.col("_m").isNotNull() & F.col("_m.state").isNotNull()
    for f in key_fields:
        ok = ok & F.col(f"_m.{f.name}").isNotNull()
    good = parsed.where(ok).select("*", "_m.*").drop("_m", text_col)
    bad = parsed.where(~ok).drop("_m")
    return good, bad


def js_round(x: Column) -> Column:
    """Round half up (toward +infinity), as JavaScript's Math.round."""
    return F.floor(x + F.lit(0.5))


def percent_of(state: Column, count: Column, total: Column) -> Column:
    """G1: percent shown for a message; RETRIEVING grows from 5 to at most 75."""
    retrieving = F.least(F.lit(5) + js_round(count / total * F.lit(70)), F.lit(75))
    out = F.when(state == F.lit(RETRIEVING), retrieving)
    for s, p in FIXED_PERCENT.items():
        out = out.when(state == F.lit(s), F.lit(p))
    return out.cast("long")


def label_of(state: Column, count: Column, total: Column) -> Column:
    """G1: text shown for a message."""
    template = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), state)
    filled = F.replace(template, F.lit("{total}"), F.coalesce(total.cast("string"), F.lit("")))
    return F.replace(filled, F.lit("{count}"), F.coalesce(count.cast("string"), F.lit("")))


def partial_progress(messages: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """G1, first half: what one set of messages says about each job, mergeable with other sets.

    (job, last, start, done, messages): the last known message, the last START message's total and the last
    COMPLETE message's result, each with its sequence, and the number of known messages.
    """
    known = messages.where(F.col("state").isin(*KNOWN_STATES))
    if "result" not in messages.columns:
        known = known.withColumn("result", F.lit(None).cast(schema.FACT_ARRAY))
    latest = lambda cond, *cols: F.max_by(F.struct(F.col(seq).alias("seq"), *cols), F.when(cond, F.col(seq)))
    return known.groupBy(job).agg(
        latest(F.lit(True), "state", "count", "total").alias("last"),
        latest(F.col("state") == START, "total").alias("start"),
        latest(F.col("state") == COMPLETE, "result").alias("done"),
        F.count(F.lit(1)).alias("messages"),
    )


def merged_progress(partials: DataFrame, job: str = "job") -> DataFrame:
    """G1, second half: the display state of every job out of the partial rows of any number of message sets."""
    latest = lambda c: F.max_by(c, F.col(f"{c}.seq")).alias(c)
    folded = partials.groupBy(job).agg(latest("last"), latest("start"), latest("done"), F.sum("messages").alias("messages"))
    total = F.coalesce(
        F.nullif(F.col("start.total"), F.lit(0)), F.nullif(F.col("last.total"), F.lit(0)), F.lit(1)
    ).cast("long")
    state, count = F.col("last.state"), F.col("last.count")
    return folded.select(
        job, state.alias("state"), count.alias("count"), total.alias("total"),
        percent_of(state, count, total).alias("percent"), label_of(state, count, total).alias("label"),
        "messages", F.col("done.result").alias("result"),
    )


def progress_fold(messages: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """G1: the display state of every job after all its messages.

    The last known message decides the state.  RETRIEVING divides by the
    total of the latest START message (falling back to the message's own
    total, then 1; a zero counts as missing).  Unknown states are ignored.
    ``result`` is the payload of the last COMPLETE message, where messages carry one.
    """
    return merged_progress(partial_progress(messages, job, seq), job)
