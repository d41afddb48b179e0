"""A corpus pipeline: quality, lines, near duplicates, benchmark leaks, packing. Every stage works on all that the one before it kept.

The filtering stages keep all columns, whatever their names, and give an empty table for an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, jaccard, lines, packing, quality
from driftline.llm.common import cut, spare, text_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside the held-out fold, does not reject.

    Null and empty texts are judged by their length alone; repeated rows are judged alike; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(cut(quality.training_rows(docs, labels), "labelled")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal or alike to earlier ones; those left without a line go.

    Null and empty texts lose nothing and stay; repeated rows keep the same lines; of equal lines the one of the least id stays.
    """
    return lines.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at a similarity of 0.8 join, the one of the least id.

    Null and empty texts are linked with nothing and stay; of one id's texts the one of the least hash stays; repeated rows of a document that stays, stay.
    """
    return jaccard.representatives(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, edited or not.

    Null and empty texts hold none and stay; repeated rows stay or go together; of one id's texts only those go that hold a passage; without items all stay.
    """
    doc, text = spare(docs, "leaked", "text")
    leaks = decontaminate.keyed_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = cut(leaks.select(F.col("doc_id").alias(doc), F.col("tkey").alias(text)).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key() == F.col(text)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents goes among sequences of 4096 tokens. Null and empty texts are their end id; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]

#: The classifier and the alignment are beyond SQL. Tests hold the stages to brute force, each on what the one before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; what each one keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
