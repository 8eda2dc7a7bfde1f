"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function) stages; a function takes ``(spark, docs, sf_dir)`` and returns the
documents it keeps, with their columns (the last one returns sequences).  A runner writes each stage's result as Parquet
and hands the written table to the next; ``run`` does so under the shared checkpoint folder.

1. toxicity: fits the classifier on the training labels and drops the documents it rejects;
2. exact dedup: one document of each text (white space aside) stays, the longest original, then the smallest id;
3. near dedup: of documents joined by five-word-shingle Jaccard 0.8 the one with the smallest id stays;
4. secrets: every secret is masked in its text, all documents stay;
5. packing: the texts' tokens as power-of-two sequences.

A NULL text is the empty text for every decision and stays NULL; documents with a NULL id are kept unless a stage rejects their text;
rows that repeat an id are judged each by its own text; an empty table passes through; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasonlens.llm import exact_dedup, jaccard, packing, secrets, toxicity
from seasonlens.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# SQL can't fit the classifier or run the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
