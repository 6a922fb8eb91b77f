"""Registered queries of this subpackage; ``QUERIES`` and ``ORACLE_SQL`` by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, mixing, order_minhash, pii, quality_rules, secret_scan, sentence_pieces, substring_dedup, url_filter, vector_dedup
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    fixed = F.filter("pii", lambda s: s["fixed"])
    count = lambda kind: F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.array_join(F.transform(fixed, text), ","), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], digest, F.array_join(F.transform("pii", text), ",").alias("spans"))


#: A public SentencePiece model installed on the machine of the driver.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sentence_pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return made.select("doc_id", "n_ids", "ids", "round_trip")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every document, with the spans that went and how many characters, in code points of the original."""
    made = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("doc_id", "text", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed"), spans.alias("spans"), "n_units")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.url_filter(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its class of near-duplicates."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "longest_repeat")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("secrets", lambda s: s["rank"] < 3), text), ",")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("secrets", text), ",").alias("spans"), count(3).alias("n_random"),
    )


QUERIES = {f.__name__: f for f in (op1_pivot_permutation, op2_mixing, op3_pii, op4_sentence_pieces, op5_substring_dedup, op6_url_filter, op7_order_minhash, op8_quality_rules, op9_html_extract, op10_secret_scan)}
