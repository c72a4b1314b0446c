"""A corpus pipeline over ``documents`` that calls the training-data operators stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents; the last adds
``copies``, how often the mix takes a document.

Defined results, for every stage: an empty table of documents gives an empty table; null texts count as texts without words, lines or shingles; texts are
read whole, however long; rows that repeat are judged alike; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import decontam, linededup, mixing, puquality, simhash
from cadence.llm.common import drop_stored, fold, stored, table

#: No stage sequence with a trained classifier and XXH64 fingerprints can be put in DuckDB SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose positive-unlabelled score is 0.5 or more; without labels all stay."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return puquality.keep_good(docs, puquality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line exactly or within two edits; under 20 characters one edit, under 10 none."""
    return linededup.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near-duplicates on five-word shingles; rows without a doc_id stay, rows that share one are one document."""
    return simhash.keep_one(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item; without items all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_share=0.0)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies; documents without words add nothing to a source and follow its threshold."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
        drop_stored(docs)
        docs = made
    return docs
