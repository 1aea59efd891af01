"""A corpus pipeline over documents, made of the training-data operators.

Every stage takes any columns beside doc_id and text (source for the mix), whatever
their names, and all but the last pass them on. A null id is a value
like any other; an empty table goes through as one; very long texts are read whole, in
memory in proportion to the longest. What each stage does with null and empty texts,
ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pericell.llm import mixing, neardup, packing, quality, secret_scan, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go: null and empty texts too, having too few words. Repeated rows share their verdict."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least id, of equal ids the least hash of the text, of repeated rows one. Texts without words all stay, repeated rows of them as one."""
    return neardup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows. A null text stays null; equal texts come out equal; no row goes."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; repeated rows draw alike, a null source is one of its own, the last."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and their places in sequences; a null text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The stages include operators that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.written(docs, name.replace(" ", "_"))
    return docs
