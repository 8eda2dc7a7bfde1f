"""Registered queries of the package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlens.llm import bpe, exact_dedup, filter_audit, html_text, itq, jaccard, licenses, line_quality, packing, pii, prefix_trie, secrets, toxicity
from seasonlens.llm.common import table
from seasonlens.llm.spans import listed, of_kinds


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("covered")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.bpe_encode(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(bpe.bpe_decode(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"))


def _counted(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans."""
    counts = [F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.sha2(listed(of_kinds(F.col("spans"), kinds)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, listed(F.col("spans")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_quality.clean_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuild(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_licenses, op3_html, op4_bpe, op5_secrets, op6_exact_dedup, op7_toxicity, op8_pii, op9_jaccard, op10_itq,
    op11_filter_audit, op12_line_quality, op13_prefix_trie)}
