"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, each stage on all that the one before kept.

In every stage, rows with null ids, texts or other columns, empty texts and texts of any length pass as its operator says; repeated rows
are judged alike, and an empty table stays empty. Tables with further columns keep them, whatever their names, up to the packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planeweave.llm import mixing, packing, quality, queries, secrets, simhash
from planeweave.llm.common import ensure_checkpoint_dir

#: What a mix without repeats aims at: as many clean tokens as there are, and no others.
WEIGHTS = {"clean": 1.0, "low": 0.0, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from those of their language and source go: ``quality.keep``.

    A null, empty or short text fails. Null languages and sources are values of their own. Repeated rows stay or go together.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a similarity of 0.8 or more, directly or by others, the smallest id stays.

    Of repeated rows one stays, of null and empty texts one, and every row without an id: ``simhash.one_of_each``.
    """
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; every document stays, null and empty texts as they are: ``secrets.redact``."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their fitted rates, none twice: ``mixing.thin``.

    Where no labelled document is left, all rates are alike. Empty texts get the rate of their posteriors, null ids are drawn as one.
    """
    labelled = queries.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.thin(docs, labelled, WEIGHTS, public_tokenizers.path(queries.WORD_BPE))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence: ``packing.pack``. A null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path(queries.WORD_BPE), queries.END_ID)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Outlier estimates, components, tokenizers and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    A stage's folder goes when the next one's is whole. The last of them stays, as the rows that are returned are read from it.
    Nulls, empty tables, repeats and further columns are treated as by the stages.
    """
    ensure_checkpoint_dir(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place = hadoop(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = hadoop(place, str(k)).toString()
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if k:
                store.delete(hadoop(place, str(k - 1)), True)
    return docs
