"""Group split: no group straddles train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column
from shotweave.operators.joins import attach_by_key
from shotweave.operators.prefix import global_prefix_sum
from shotweave.storage import materialise

# Fixed values.
TRAIN_SHARE, VALIDATION_SHARE, TEST_SHARE = 0.8, 0.1, 0.1


def with_group_key(
    df: DataFrame, group: Column | str, text: str, name: str = "group_key"
) -> DataFrame:
    """The group of a row; rows without one form a group of their own text."""
    group = F.col(group) if isinstance(group, str) else as_column(group)
    return df.withColumn(name, F.coalesce(F.nullif(group, F.lit("")), F.col(text)))


def split_groups(
    df: DataFrame,
    group: str = "group_key",
    order: str = "row_id",
    valid: float = VALIDATION_SHARE,
    test: float = TEST_SHARE,
) -> DataFrame:
    """(group, size, split) for every group.

    Groups are taken from the largest to the smallest, ties by first row.
    Validation is filled first and takes groups while its share is below
    ``valid``; then test; the rest is train.  Because a split only grows,
    validation is a prefix of that order and test the stretch after it, so a
    running sum of sizes decides both.
    """
    sizes = df.groupBy(group).agg(
        F.count("*").alias("size"), F.min(order).alias("first_row")
    )
    placed = global_prefix_sum(
        sizes, [F.col("size").desc(), F.col("first_row").asc()], {"size": "before"}
    )
    totals = placed.agg(F.sum("size").alias("n"))
    n = totals.scalar()
    in_valid = F.col("before") / n < F.lit(valid)
    valid_rows = placed.where(in_valid).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("valid_rows")
    ).scalar()
    in_test = (F.col("before") - valid_rows) / n < F.lit(test)
    split = (
        F.when(in_valid, F.lit("validation")).when(in_test, F.lit("test")).otherwise(F.lit("train"))
    )
    return placed.select(group, "size", split.alias("split"))


def group_split(
    df: DataFrame,
    group: str = "group_key",
    order: str = "row_id",
    train: float = TRAIN_SHARE,
    valid: float = VALIDATION_SHARE,
    test: float = TEST_SHARE,
    task: str | None = None,
) -> DataFrame:
    """Every row with its ``split``.

    Rows and groups meet on a digest of 16 bytes, because a group key can be a whole text.
    Rows without a group form one.  With ``task`` the table holds many tasks and
    each is split as if it were alone, all in the same jobs; rows without a task
    form one.
    """
    if abs(train + valid + test - 1.0) >= 1e-9:
        raise ValueError("the three shares must add up to 1")
    digest = F.coalesce(F.sha2(F.col(group).cast("string"), 256), F.lit(""))
    if task is not None:
        digest = F.sha2(F.concat(task_key(task), F.lit("\0"), digest), 256)
    keyed = df.withColumn("__group", F.unhex(F.substring(digest, 1, 32)))
    if task is None:
        groups = split_groups(keyed, "__group", order, valid, test)
    else:
        groups = split_groups_by_task(keyed.withColumn("__task", task_key(task)), "__task", "__group", order, valid, test)
    return attach_by_key(keyed, materialise(groups, "groups"), "__group", "size").drop("__group")


def task_key(task: str) -> Column:
    """A task's name as a key that also stands for rows without one."""
    return F.coalesce(F.concat(F.lit("="), F.col(task).cast("string")), F.lit("-"))


def split_groups_by_task(
    df: DataFrame, task: str, group: str, order: str, valid: float = VALIDATION_SHARE, test: float = TEST_SHARE
) -> DataFrame:
    """(group, size, split) for the groups of every task; a group lies in one task.

    One running sum goes over the groups of all tasks, in order of task.  What
    stands at a task's first group is taken off, so a task with most of the groups
    is spread over many partitions like any other.
    """
    sizes = df.groupBy(task, group).agg(F.count("*").alias("size"), F.min(order).alias("first_row"))
    placed = materialise(
        global_prefix_sum(sizes, [F.col(task), F.col("size").desc(), F.col("first_row").asc()], {"size": "before"}), "placed"
    )
    totals = placed.groupBy(task).agg(
        F.sum("size").alias("__n"), F.min("before").alias("__start"), F.count("*").alias("__groups")
    )
    placed = attach_by_key(placed, materialise(totals, "totals"), task, "__groups").withColumn(
        "before", F.col("before") - F.col("__start")
    )
    in_valid = F.col("before") / F.col("__n") < F.lit(valid)
    filled = placed.groupBy(task).agg(
        F.coalesce(F.sum(F.when(in_valid, F.col("size"))), F.lit(0)).alias("__valid"), F.count("*").alias("__groups")
    )
    judged = attach_by_key(placed, materialise(filled, "filled"), task, "__groups")
    in_test = (F.col("before") - F.col("__valid")) / F.col("__n") < F.lit(test)
    split = F.when(in_valid, F.lit("validation")).when(in_test, F.lit("test")).otherwise(F.lit("train"))
    return judged.select(group, "size", split.alias("split"))
