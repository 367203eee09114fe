"""From ``documents`` to packed training sequences, one operator a stage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm import exact, near, packing, quality, suffix
from shotweave.llm.filters import without
from shotweave.llm.groups import fresh
from shotweave.session import ship
from shotweave.storage import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.site_quality(docs, labels, "doc_id", "text", "source", ["lang"])
    return without(docs, "doc_id", judged.where("NOT kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    ship(spark)
    return exact.drop_exact_copies(docs, "doc_id", "text", keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return without(docs, "doc_id", near.near_groups(docs, "doc_id", "text").where("NOT kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; characters cut in two go whole."""
    ship(spark)

    @F.pandas_udf("string")
    def whole_characters(kept: pd.Series) -> pd.Series:
        return kept.map(lambda data: data.decode("utf-8", "ignore"), na_action="ignore")

    kept, spans, changed = fresh(docs, "kept", "spans", "changed")
    cut = suffix.remove_repeats(docs, "doc_id", "text", length=100, kept=kept, spans=spans)
    cut = cut.withColumn(changed, F.size(spans) > 0).drop(spans)
    # Written first, each text once: a task that cuts and decodes would hold two Python workers.
    cut = materialise(
        cut.withColumns({"text": F.when(~F.col(changed), F.col("text")), kept: F.when(F.col(changed), F.col(kept))}), "cut"
    )
    # Only texts that were cut go through Python.
    text = F.when(F.col(changed), whole_characters(F.when(F.col(changed), F.col(kept)))).otherwise(F.col("text"))
    count = F.when(F.col(changed), F.char_length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": count}).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, "doc_id", "text", capacity=1024)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer are not SQL; tests check against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
