"""A query for each operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.llm import (
    decontaminate, fill_in_middle, gru_lm, html_text, licences, lines, lz_fingerprint, order_minhash, packing, part_codes, pii, toxicity, url_rules,
)
from verilens.sources.tables import table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in each document as whole text or whole line."""
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark)).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    made = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of each document, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document and benchmark item that are alike."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "start_word", "n_words")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without cross-site boilerplate lines."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary()).withColumnRenamed("id", "doc_id")


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text."""
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document and whether it stands for it."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", F.col("first").alias("is_kept"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of each document."""
    return gru_lm.scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL."""
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.registered(spark)).select("page_id", "host", "path", "rule", "verdict")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and digests of each document's fill-in-middle output and of the text restored from it."""
    made = fill_in_middle.digested(fill_in_middle.pieces(table(spark, sf_dir, "documents")))
    return made.select(F.col("id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each vector, its error, its label's error and the digest of the codebooks."""
    codes, book = part_codes.compressed(table(spark, sf_dir, "embeddings"))
    return part_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(part_codes.digest(book)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_licence_scan, op2_html_extraction, op3_toxicity, op4_decontamination, op5_line_dedup, op6_packing, op7_lz_fingerprint, op8_order_minhash, op9_pii, op10_gru_lm,
        op11_url_rules, op12_fill_in_middle, op13_part_codes)
}
ORACLES: dict[str, str] = {
    "op1_licence_scan": licences.sql(), "op4_decontamination": decontaminate.SQL, "op5_line_dedup": lines.sql(), "op11_url_rules": url_rules.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL, "op13_part_codes": part_codes.sql(),
}
