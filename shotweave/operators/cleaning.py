"""Cleaning of a task table."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import uniform
from shotweave.functions.text import canonical_key, to_number
from shotweave.operators.joins import attach_by_key
from shotweave.operators.prefix import global_ordinal
from shotweave.storage import materialise

# Fixed values.
MIN_ROWS = 20
SAMPLE_SEED = 42


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns are all present."""
    return df.na.drop(subset=list(columns))


def coerce_numeric(df: DataFrame, label: str) -> DataFrame:
    """The label as DOUBLE; rows that do not read as a number are dropped."""
    return df.withColumn(label, to_number(F.col(label))).na.drop(subset=[label])


def coerce_label(df: DataFrame, label: str) -> DataFrame:
    """The label as BIGINT, cut toward zero."""
    numeric = coerce_numeric(df, label)
    # Beyond BIGINT a class label has no meaning, and the cast would fail.
    return numeric.withColumn(label, F.col(label).try_cast("bigint")).na.drop(subset=[label])


def with_canonical_key(
    df: DataFrame, text: str, key: str = "canonical_key", expression: Column | None = None
) -> DataFrame:
    """Add the identity of the text; rows without one are dropped.

    The default key is missing exactly where a text has nothing but blanks.
    Asking the text is cheap; asking the key would compute it twice.
    """
    if expression is None:
        written = F.col(text).rlike(r"\S")
        return df.where(written).withColumn(key, canonical_key(F.col(text)))
    return df.withColumn(key, expression).na.drop(subset=[key])


def dedup_keep_first(
    df: DataFrame, key: str = "canonical_key", order: str = "row_id"
) -> DataFrame:
    """One row per key, the earliest by ``order``; the key column is dropped.

    Every task keeps one row per key before the shuffle, so a key that holds a
    third of the table moves one row per task.  The shuffle is on a digest,
    not on the text.
    """
    columns = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*columns), F.col(order)).alias("kept")
    digest = F.sha2(F.col(key).cast("string"), 256).alias("digest")
    return df.groupBy(digest).agg(first).select("kept.*")


def has_min_rows(df: DataFrame, n: int = MIN_ROWS) -> bool:
    """Whether a task has at least ``n`` rows; warns when it has not."""
    found = df.limit(n).count()
    if found < n:
        warnings.warn(f"only {found} rows, fewer than {n}: task skipped", stacklevel=2)
    return found >= n


def keep_large_tasks(df: DataFrame, task: str, n: int = MIN_ROWS) -> DataFrame:
    """Rows of the tasks with at least ``n`` rows, for many tasks at once.

    Tasks with most rows are met where they are, not in one task of Spark.
    """
    counts = df.where(F.col(task).isNotNull()).groupBy(task).agg(F.count("*").alias("__rows"))
    large = materialise(counts.where(F.col("__rows") >= n), "large-tasks")
    return attach_by_key(df, large, task, "__rows").select(*df.columns)


def sample_fraction(
    df: DataFrame, fraction: float, order: str = "row_id", seed: int = SAMPLE_SEED
) -> DataFrame:
    """Each row with probability ``fraction``; the whole table from 1.0 on."""
    if fraction >= 1.0:
        return df
    return df.where(uniform(seed, F.col(order)) < F.lit(fraction))


def sample_exact(
    df: DataFrame, fraction: float, order: str = "row_id", seed: int = SAMPLE_SEED
) -> DataFrame:
    """Exactly the rounded share of the rows, chosen by hash.

    Costs a range shuffle of the row ids; ``sample_fraction`` needs none.
    """
    if fraction >= 1.0:
        return df
    ids = df.select(order, uniform(seed, F.col(order)).alias("__u"))
    ranked = global_ordinal(ids, [F.col("__u"), F.col(order)], "__rank")
    wanted = df.agg(F.bround(F.count("*") * F.lit(fraction), 0)).scalar()
    chosen = ranked.where(F.col("__rank") < wanted).select(order)
    return df.join(chosen, order, "left_semi")
