"""Instruction records from task tables, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.prompts import (
    CLASSIFICATION,
    REGRESSION,
    Wording,
    classification_prompt,
    no_shots,
    regression_prompt,
)
from shotweave.functions.hashing import as_column
from shotweave.functions.text import format_label, label_text, lossless_words
from shotweave.operators.balance import IMBALANCE_RATIO, oversample_by_task, oversample_minority
from shotweave.operators.bpe import Tokenizer, bpe_join, bpe_tokens
from shotweave.operators.cleaning import (
    coerce_label,
    coerce_numeric,
    dedup_keep_first,
    drop_missing,
    has_min_rows,
    keep_large_tasks,
    with_canonical_key,
)
from shotweave.operators.joins import attach_counted
from shotweave.operators.masking import MASK, join_pieces, masked
from shotweave.operators.prefix import global_ordinal
from shotweave.operators.shots import apply_shortfall, shots_array
from shotweave.operators.similarity import build_index, knn, neighbour_rows
from shotweave.operators.split import group_split, task_key, with_group_key
from shotweave.storage import fits_broadcast, materialise


@dataclass(frozen=True)
class Masking:
    """How texts are cut into tokens and put together again.

    The default loses nothing: the hidden token in place of the mask gives the
    source text, blanks and case included.
    """

    tokenise: Callable[[Column], Column] = lossless_words
    detokenise: Callable[[Column], Column] = join_pieces
    has_mask: bool = True
    seed: int = 42

    @staticmethod
    def with_tokenizer(tokenizer: Tokenizer, seed: int = 42) -> Masking:
        return Masking(
            lambda text: bpe_tokens(text, tokenizer), bpe_join, tokenizer.has(MASK), seed
        )

    def apply(self, text, *key) -> Column:
        """The masked text; ``key`` identifies the draw."""
        drawn = masked(
            text, F.col("tokens"), *key, seed=self.seed, detokenise=self.detokenise,
            has_mask=self.has_mask,
        )
        return drawn["masked"]


@dataclass(frozen=True)
class RecordConfig:
    """Options of a record build."""

    task: str
    task_text: str
    shots: int = 0
    masking: Masking = field(default_factory=Masking)
    fingerprint: dict = field(default_factory=dict)
    exclude_self: bool = True
    wording: Wording | None = None


def clean_classification(
    df: DataFrame, text: str, label: str, key: Column | None = None, order: str = "row_id"
) -> DataFrame:
    """Rows with text and whole-number label, first of each canonical key."""
    cleaned = coerce_label(drop_missing(df, text, label), label)
    return dedup_keep_first(with_canonical_key(cleaned, text, expression=key), order=order)


def prepare_classification(
    df: DataFrame, text: str, label: str, group: Column | str, key: Column | None = None,
    augment: bool = False, ratio: int = IMBALANCE_RATIO, **balance,
) -> DataFrame | None:
    """Clean, deduplicate, check the size, split by group and balance train.

    Returns None, with a warning, for a task that is too small.
    """
    cleaned = materialise(clean_classification(df, text, label, key), "cleaned")
    if not has_min_rows(cleaned):
        return None
    split = group_split(with_group_key(cleaned, group, text))
    if not augment:
        return split.withColumn("is_augmented", F.lit(False))
    split = materialise(split, "split")
    train = oversample_minority(
        split.where(F.col("split") == "train"), label, text, ratio=ratio, **balance
    )
    rest = split.where(F.col("split") != "train").withColumn("is_augmented", F.lit(False))
    return train.unionByName(rest)


def prepare_classification_tasks(
    df: DataFrame, task: str, text: str, label: str, group: Column | str, key: Column | None = None,
    augment: bool = False, ratio: int = IMBALANCE_RATIO, order: str = "row_id", **balance,
) -> DataFrame:
    """:func:`prepare_classification` for a table of many tasks, in the same few jobs.

    Every task comes out as it would alone: its own duplicates, split and balance.
    Tasks that are too small, and rows without a task, leave no rows.
    """
    numeric = coerce_label(drop_missing(df, task, text, label), label)
    cleaned = with_canonical_key(numeric, text, "__key", expression=key)
    both = F.struct(F.col(task).cast("string"), F.col("__key").cast("string"))
    first = dedup_keep_first(cleaned.withColumn("__both", F.to_json(both)).drop("__key"), "__both", order)
    large = keep_large_tasks(materialise(first, "cleaned"), task)
    split = group_split(with_group_key(large, group, text), order=order, task=task)
    if not augment:
        return split.withColumn("is_augmented", F.lit(False))
    split = materialise(split, "split")
    train = oversample_by_task(
        split.where(F.col("split") == "train"), task, label, text, order=order, ratio=ratio, **balance
    )
    rest = split.where(F.col("split") != "train").withColumn("is_augmented", F.lit(False))
    return train.unionByName(rest)


def build_classification(df: DataFrame, config: RecordConfig) -> DataFrame:
    """Records of a split table (row_id, text, label, split).

    Every text is masked afresh where it appears; examples come from train.
    """
    text, masking = F.col("text"), config.masking
    base = df.select("row_id", "text", "label", "split").withColumn("tokens", masking.tokenise(text))
    if config.shots > 0:
        base = build_index(base, "text", keep_all=True, **config.fingerprint)
        train = base.where(F.col("split") == "train")
        near = knn(base, train, config.shots, exclude_self=config.exclude_self)
        shots = shots_array(
            neighbour_rows(near), train.select("row_id", "text", "label", "tokens"),
            masking.apply(text, F.col("query_id"), "shot", F.col("neighbour_id")),
            label_text(F.col("label")),
        )
        joined = base.join(shots.withColumnRenamed("query_id", "row_id"), "row_id", "left")
        base = apply_shortfall(joined, config.shots, "use_what_is_there")
    else:
        base = base.withColumn("shots", no_shots())
    shown = base.withColumn("input", masking.apply(text, F.col("row_id"), "query"))
    prompt = classification_prompt(
        F.col("input"), config.task_text, F.col("shots"), config.wording or CLASSIFICATION
    )
    return shown.select(
        "row_id", F.lit(config.task).alias("task"), "split", prompt.alias("instruction"), "input",
        label_text(F.col("label")).alias("output"), text.alias("original_text"),
    )


def value_range(df: DataFrame, label: str) -> DataFrame:
    """One row: smallest and largest label, (0, 0) without any."""
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.min(label), zero).alias("low"), F.coalesce(F.max(label), zero).alias("high")
    )


def build_regression(
    df: DataFrame, config: RecordConfig, range_source: DataFrame | None = None
) -> DataFrame:
    """Records of a table (row_id, text, label), neighbours from the same table.

    The whole table also gives the value range unless ``range_source`` is
    passed.  With examples asked for, a row that finds fewer is dropped.
    """
    text, masking = F.col("text"), config.masking
    cleaned = coerce_numeric(drop_missing(df, "text", "label"), "label").select(
        "row_id", "text", "label"
    )
    known = value_range(cleaned if range_source is None else range_source, "label")
    base = cleaned.withColumn("tokens", masking.tokenise(text))
    if config.shots > 0:
        base = build_index(base, "text", **config.fingerprint)
        near = knn(base, base, config.shots, exclude_self=config.exclude_self)
        shots = shots_array(neighbour_rows(near), base, "text", format_label(F.col("label")))
        joined = base.join(shots.withColumnRenamed("query_id", "row_id"), "row_id", "left")
        base = apply_shortfall(joined, config.shots, "drop_query")
    else:
        base = base.withColumn("shots", no_shots())
    ranged = base.withColumns(
        {
            "input": masking.apply(text, F.col("row_id"), "query"),
            "low": known.select("low").scalar(), "high": known.select("high").scalar(),
        }
    )
    prompt = regression_prompt(
        F.col("input"), config.task_text, F.col("low"), F.col("high"), F.col("shots"),
        config.wording or REGRESSION,
    )
    return ranged.select(
        "row_id", F.lit(config.task).alias("task"), prompt.alias("instruction"), "input",
        format_label(F.col("label")).alias("output"), text.alias("original_text"),
    )


def _numbered(df: DataFrame, task: str) -> DataFrame:
    """Rows with a ``number`` that is unique over all tasks and in row order within each."""
    keyed, both = df.withColumn("__task", task_key(task)), ["__task", "row_id"]
    # Only ids are put in order; texts stay where they are if the numbers are few.
    numbers = materialise(global_ordinal(keyed.select(*both), [F.col(c) for c in both], "number"), "numbers")
    return keyed.join(F.broadcast(numbers) if fits_broadcast(numbers) else numbers, both).drop("__task")


def _shots_by_task(
    base: DataFrame, index: DataFrame, config: RecordConfig, text: Column, label: Column
) -> DataFrame:
    """``base`` with the examples of every row, found in the rows of its own task.

    ``text`` is an expression over the example's row and the asking row's ``asked``.
    """
    near = knn(
        base, index, config.shots, "number", "number", exclude_self=config.exclude_self, task="task"
    )
    asked = base.select(F.col("number").alias("query_id"), F.col("row_id").alias("asked"))
    chosen = neighbour_rows(near, "number").select("query_id", "rank", "neighbour_id").join(asked, "query_id")
    offered = index.select("number", "row_id", "text", "label")
    shots = shots_array(chosen, offered, text, label, "number", config.masking.tokenise(F.col("text")))
    return base.join(shots.withColumnRenamed("query_id", "number"), "number", "left")


def build_classification_tasks(
    df: DataFrame, task: str, task_text: Column | str, config: RecordConfig
) -> DataFrame:
    """:func:`build_classification` for a split table of many tasks, in the same few jobs.

    ``task`` names the column of tasks and ``task_text`` (a column, or an
    expression over a row) says what each is about; those of ``config`` are not
    read.  Every task comes out as it would alone: its examples are its own train
    rows, masked by its own row ids, which need to be unique within a task only.
    Rows without a task are one task.
    """
    text, masking = F.col("text"), config.masking
    base = df.select(
        "row_id", F.col(task).alias("task"), as_column(task_text).alias("task_text"), "text", "label", "split"
    )
    if config.shots > 0:
        base = build_index(_numbered(base, "task"), "text", keep_all=True, **config.fingerprint)
        train = base.where(F.col("split") == "train")
        fresh = masking.apply(text, F.col("asked"), "shot", F.col("row_id"))
        joined = _shots_by_task(base, train, config, fresh, label_text(F.col("label")))
        base = apply_shortfall(joined, config.shots, "use_what_is_there")
    else:
        base = base.withColumn("shots", no_shots())
    tokens = masking.tokenise(text)
    shown = base.withColumn("tokens", tokens).withColumn("input", masking.apply(text, F.col("row_id"), "query"))
    prompt = classification_prompt(
        F.col("input"), F.col("task_text"), F.col("shots"), config.wording or CLASSIFICATION
    )
    return shown.select(
        "row_id", "task", "split", prompt.alias("instruction"), "input",
        label_text(F.col("label")).alias("output"), text.alias("original_text"),
    )


def value_range_by_task(df: DataFrame, task: str, label: str) -> DataFrame:
    """(task, low, high): smallest and largest label of every task, (0, 0) without any."""
    zero = F.lit(0.0)
    return df.groupBy(task).agg(
        F.coalesce(F.min(label), zero).alias("low"), F.coalesce(F.max(label), zero).alias("high")
    )


def build_regression_tasks(
    df: DataFrame, task: str, task_text: Column | str, config: RecordConfig
) -> DataFrame:
    """:func:`build_regression` for a table of many tasks, in the same few jobs.

    Arguments as in :func:`build_classification_tasks`; every task has its own
    value range.
    """
    text, masking = F.col("text"), config.masking
    rows = df.select(
        "row_id", F.col(task).alias("task"), as_column(task_text).alias("task_text"), "text", "label"
    )
    base = coerce_numeric(drop_missing(rows, "text", "label"), "label").withColumn("__task", task_key("task"))
    ranges = materialise(value_range_by_task(base, "__task", "label"), "ranges")
    if config.shots > 0:
        base = build_index(_numbered(base.drop("__task"), "task"), "text", **config.fingerprint)
        joined = _shots_by_task(base, base, config, text, format_label(F.col("label")))
        base = apply_shortfall(joined, config.shots, "drop_query").withColumn("__task", task_key("task"))
    else:
        base = base.withColumn("shots", no_shots())
    shown = base.withColumn("tokens", masking.tokenise(text)).withColumn(
        "input", masking.apply(text, F.col("row_id"), "query")
    )
    ranged = attach_counted(shown.drop("tokens"), ranges, "__task")
    prompt = regression_prompt(
        F.col("input"), F.col("task_text"), F.col("low"), F.col("high"), F.col("shots"),
        config.wording or REGRESSION,
    )
    return ranged.select(
        "row_id", "task", prompt.alias("instruction"), "input",
        format_label(F.col("label")).alias("output"), text.alias("original_text"),
    )
