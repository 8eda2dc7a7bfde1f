"""Filter interaction audit: what each quality filter removes under every order of application.

**Transducer.**  A text's UTF-8 bytes pass once through a table of 256 byte classes (white space, capital, continuation byte,
symbol) and a two-state machine (inside or outside a word).  The pass counts words, capitals, code points and symbols
and hands every finished word span to a hash table that compares the whole word before it
takes it for known (a Python set of byte strings: equal hashes are verified by content).  The bytes pass in blocks; the state and the open
word are carried over a block's end, so a text of any length needs one block of work space beside its distinct words.

**Failures.**  Five conditions (words: maximal runs outside ASCII white space, case-sensitive): A too few words, B too few distinct
words, C too many capitals, D a symbol, E a text that a smaller id has too, in the whole table.  Texts are told apart by length and SHA-256.

**Interactions.**  Rows shrink to (part, failed set, labels) with counts.  ``clear[S]``, the documents of a part that fail no filter of
S, is a sum over the 32 sets S; every figure of every order follows from it: a filter with the set P before it removes
``clear[P] - clear[P + f]``.  So 120 orders cost no more passes than one, and nothing is joined or grouped by order.

Defined results: a NULL text is the empty text, a NULL part the empty string; a row with a NULL id never fails E, makes nobody fail it, and has no label;
rows that repeat an id are counted each, and equal ones among them don't fail E against each other;
a label holds if any label row of the id says so; an empty table gives no rows.  Other columns are not read.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, staged, unstage

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
# Bytes that count as symbols, and those that end a word.
SYMBOLS = b"#$%&*|"
WHITE = b" \t\n\x0b\x0c\r"

SPACE, CAPITAL, CONTINUES, SYMBOL = 1, 2, 4, 8
# Bytes that pass the table at a time.
BLOCK = 1 << 20


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(WHITE)] |= SPACE
    table[ord("A"):ord("Z") + 1] |= CAPITAL
    table[0x80:0xC0] |= CONTINUES
    table[list(SYMBOLS)] |= SYMBOL
    return table


CLASSES = _classes()


def transduce(body: bytes) -> tuple[int, int, int, int, int]:
    """(words, distinct words, capitals, code points, symbols) of UTF-8 bytes, in one pass over blocks."""
    words = capitals = points = symbols = 0
    known: set[bytes] = set()
    whole = np.frombuffer(body, dtype=np.uint8)
    start = -1  # where the word began that is open at the block's start; -1 outside a word
    for at in range(0, len(whole), BLOCK):
        cls = CLASSES[whole[at:at + BLOCK]]
        capitals += int(np.count_nonzero(cls & CAPITAL))
        symbols += int(np.count_nonzero(cls & SYMBOL))
        points += len(cls) - int(np.count_nonzero(cls & CONTINUES))
        inside = np.empty(len(cls) + 1, dtype=np.int8)
        inside[0] = start >= 0
        inside[1:] = (cls & SPACE) == 0
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + at  # the state changes before these bytes
        edges = turns.tolist()
        if start >= 0:
            edges.insert(0, start)
        start = edges.pop() if len(edges) % 2 else -1
        words += len(edges) // 2
        known.update([body[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)])
    if start >= 0:
        words += 1
        known.add(body[start:])
    return words, len(known), capitals, points, symbols


def failed(words: int, distinct: int, capitals: int, points: int, symbols: int) -> int:
    """Failed conditions A to D as bits (A is 1)."""
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2 | (symbols > 0) << 3)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, failed, size, digest) for every row; ``failed`` has the bits A to D."""
    counts = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]
    fields = [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("failed", T.IntegerType()),
              T.StructField("size", T.LongType()), T.StructField("digest", T.BinaryType())]

    def make():
        def each(text: str):
            body = text.encode("utf-8")
            found = transduce(body)
            yield *found, failed(*found), len(body), hashlib.sha256(body).digest()

        return each

    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), part.alias("part")).alias("of"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    made = map_texts(rows, "of", fields, make)
    return made.select("of.id", "of.part", *counts, "failed", "size", "digest")


def failures(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, failed, good, toxic, n): the documents of each part by failed set and labels; bit 16 is E.

    Only the row with a text's smallest id meets the text's group (both are keys of that join), so a hot text does not meet in one task.
    """
    first = judged.where("id is not null").groupBy("size", "digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic").where("id is not null") \
        .groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged.select("id", "part", "failed", "size", "digest").join(first, ["id", "size", "digest"], "left").join(known, "id", "left")
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    return rows.groupBy("part", F.col("failed").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("failed"),
                        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _orders() -> Column:
    """An array of every order's steps: the order, the step, its filter's place and the bits of the filters before it."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[g] for g in order), "step": step, "bit": f, "before": sum(1 << g for g in order[:step - 1])})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """Every figure of every order and step, from the counts of ``failures``: one row per part, order and step."""
    every = 1 << len(FILTERS)
    disjoint = (F.col("failed").bitwiseAND(F.col("s")) == 0).cast("long")
    sums = counted.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(every - 1)))).groupBy("part", "s").agg(
        F.sum(F.col("n") * disjoint).alias("all"), F.sum(F.col("n") * F.col("good") * disjoint).alias("good"),
        F.sum(F.col("n") * F.col("toxic") * disjoint).alias("toxic"))
    # 32 entries a part: clear[s], the documents that fail no filter of s
    parts = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("s", "all", "good", "toxic"))).alias("clear"))
    rows = parts.select("part", "clear", F.explode(_orders()).alias("o")).select("part", "clear", "o.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("bit"))
    after, only = F.col("before") + bit, F.lit(every - 1) - bit

    def clear(s: Column, of: str = "all") -> Column:
        return F.get("clear", s)[of]

    def lost(of: str) -> Column:
        return clear(F.col("before"), of) - clear(after, of)

    # what the filter removes over all orders: sets before it, each as often as orders have it there
    n = len(FILTERS)
    times = F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)))
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(every - 1)), F.lit(0).cast("long"), lambda total, s: total + F.when(
        s.bitwiseAND(bit) == 0, (clear(s) - clear(s + bit)) * F.get(times, F.bit_count(s))).otherwise(0))
    return rows.select("part", "filter_order", "step", clear(after).alias("kept"), lost("all").alias("removed"),
                       (clear(F.lit(0)) - clear(bit) - lost("all")).alias("redundant"),
                       (clear(only) - clear(F.lit(every - 1))).alias("unique_fails"),
                       lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Filter interactions of ``docs``: one row per part, order of the five filters and step; see the module's docstring."""
    judged = staged(judge(docs, id_col, text_col, part_col).select("id", "part", "failed", "size", "digest"), "judged")
    counted = staged(failures(judged, labels, id_col), "failures")
    unstage(judged)
    return interactions(counted)
