"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm import html, licenses, mixing, neighbours, packing, quality, secrets, simhash, tokens, warc

WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    told = F.transform("licenses", lambda x: F.format_string("%s:%.4f:%d:%d", x["license"], x["coverage"], x["start"], x["end"]))
    return found.select("doc_id", "n_licenses", F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(told, ",").alias("licenses"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as examples, the assistant's alone bearing loss, under limits that all bind."""
    turns = _table(spark, sf_dir, "conversations")
    return packing.pack(turns, public_tokenizers.path(WORD_BPE), END_ID, id_col="conv_id", keys=("turn",), loss_col=F.col("role") == "assistant", tokens=2048, segments=24, loss=768)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records derived from each page's response: what links them, and a digest of each whole record."""
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(id, domain) of the labels: toxic, else clean or low by quality; rows without a label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, up to four, for as many tokens as there are: nine in ten of clean text, one of low, none of toxic text."""
    weights = {"clean": 0.9, "low": 0.1, "toxic": 0.0}
    found = mixing.mix(_table(spark, sf_dir, "documents"), domains_of(_table(spark, sf_dir, "labels")), weights, public_tokenizers.path(WORD_BPE))
    p = F.col("posteriors")
    return found.select("doc_id", "n_tokens", *(p[i].alias(f"p_{d}") for i, d in enumerate(sorted(weights))), "rate", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten operators' queries by name, and one of packing where all its limits bind."""
    found = [
        op1_nearest_neighbours, op2_quality_rules, op3_license_scan, op4_token_counts, op5_simhash_near_dedup,
        op6_packing, op7_secret_scan, op8_warc_derivatives, op9_html_extraction, op10_mixing, instruction_packing,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None of these can be told in SQL at a bearable cost; each is tested against brute force or a round trip."""
    return {}
