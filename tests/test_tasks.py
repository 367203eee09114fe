"""A table of many tasks against a loop over its tasks."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import records
from shotweave.operators.balance import oversample_by_task, oversample_minority
from shotweave.operators.split import group_split
from shotweave.plans.records import (
    RecordConfig, build_classification, build_classification_tasks, build_regression, build_regression_tasks,
    prepare_classification, prepare_classification_tasks,
)


def task_rows():
    rng = random.Random(7)
    rows = []
    for task, n, share in (("big", 400, 0.03), ("even", 60, 0.5), ("small", 7, 0.4), ("one class", 30, 0.0), ("rare", 90, 0.02)):
        for i in range(n):
            text = " ".join(rng.choice(["red", "green", "blue", "x", "yy"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 4)))
            rows.append((task, i, text, int(rng.random() < share), f"g{rng.randint(0, n // 6)}" if i % 5 else None))
    rows += [(None, 1000 + i, f"no task {i}", i % 2, "g") for i in range(25)]
    rng.shuffle(rows)
    return rows


SCHEMA = "task string, row_id bigint, text string, label int, source string"


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame(task_rows(), SCHEMA).repartition(3).cache()


def seen(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_below", [0, 2**24])
def test_split_and_balance(spark, tasks, monkeypatch, broadcast_below):
    monkeypatch.setattr("shotweave.storage.BROADCAST_BELOW", broadcast_below)
    columns = ("task", "row_id", "text", "label", "split", "is_augmented")
    found = seen(prepare_classification_tasks(tasks, "task", "text", "label", "source", augment=True), *columns)
    expected = []
    for task in ("big", "even", "small", "one class", "rare"):
        alone = prepare_classification(tasks.where(F.col("task") == task), "text", "label", "source", augment=True)
        if alone is not None:
            expected += seen(alone, *columns)
    assert found == sorted(expected, key=str)
    assert {r[0] for r in found} == {"big", "even", "one class", "rare"} and any(r[-1] for r in found)


def test_rows_without_a_task_are_one(spark, tasks):
    keyed = tasks.withColumn("group_key", F.col("source"))
    split = seen(group_split(keyed, task="task").where("task IS NULL"), "row_id", "split")
    assert split == seen(group_split(keyed.where("task IS NULL")), "row_id", "split") and len(split) == 25


def test_one_source_of_a_task_with_a_large_quota(spark):
    rows = [("a", i, "a b c", 0) for i in range(1, 12501)] + [("a", 0, "one two three", 1), ("b", 3, "u v", 0), ("b", 4, "u w", 1)]
    df = spark.createDataFrame(rows, "task string, row_id bigint, text string, label int")
    grown = oversample_by_task(df, "task", "label", "text")
    alone = oversample_minority(df.where("task = 'a'"), "label", "text").where("is_augmented")
    added = seen(grown.where("is_augmented"), "row_id", "text", "label")
    assert added == seen(alone, "row_id", "text", "label") and len(added) == 2499
    assert grown.count() == len(rows) + 2499


def test_no_tasks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prepare_classification_tasks(empty, "task", "text", "label", "source", augment=True).count() == 0


def test_arrays_of_the_learnt_tokenizer(spark):
    library = pytest.importorskip("tokenizers")
    from shotweave.operators.bpe import bpe_train, word_counts

    source = "/root/testdata/sf0.001"
    trained = bpe_train(word_counts(spark.read.parquet(f"{source}/conversations.parquet"), "text"))
    other = library.ByteLevelBPETokenizer(vocab=trained.ids, merges=list(trained.merges))
    texts = {r["row_id"]: r for r in records.conversation_records(spark, source).collect()}
    for row in records.concat_arrays_bpe(spark, source).collect():
        of = texts[row["row_id"]]
        prompt = other.encode(of["instruction"].strip() + "\n" + of["input"].strip()).ids[: records.CONCAT_LENGTH]
        target = other.encode(of["output"].strip()).ids[: max(records.CONCAT_LENGTH - 1 - len(prompt), 0)]
        assert row["input_ids"] == ",".join(map(str, prompt + target))
        assert row["labels"] == ",".join(map(str, [-100] * len(prompt) + target))


@pytest.mark.parametrize("shots, names", [(0, ("even", "rare")), (2, ("big", "one class", "rare"))])
def test_records_of_many_tasks(spark, tasks, shots, names):
    split = prepare_classification_tasks(tasks, "task", "text", "label", "source").cache()
    columns = ("row_id", "task", "split", "instruction", "input", "output", "original_text")
    about = F.concat(F.lit("say which "), F.col("task"))
    found = seen(build_classification_tasks(split, "task", about, RecordConfig("", "", shots)), *columns)
    expected = []
    for task in names:
        config = RecordConfig(task, f"say which {task}", shots)
        expected += seen(build_classification(split.where(F.col("task") == task), config), *columns)
    assert [r for r in found if r[1] in names] == sorted(expected, key=str) and len(found) == split.count()


@pytest.mark.parametrize("shots, names", [(0, ("even", "rare")), (2, ("big", "small", "rare"))])
def test_numbers_of_many_tasks(spark, tasks, shots, names):
    rows = tasks.withColumn("label", F.col("row_id") / 7 + F.length("text")).withColumn(
        "label", F.when(F.col("row_id") % 11 > 0, F.col("label"))
    )
    columns = ("row_id", "task", "instruction", "input", "output", "original_text")
    about = F.coalesce(F.concat(F.lit("say how "), F.col("task")), F.lit("say"))
    found = seen(build_regression_tasks(rows, "task", about, RecordConfig("", "", shots)), *columns)
    expected = []
    for task in names:
        config = RecordConfig(task, f"say how {task}", shots)
        expected += seen(build_regression(rows.where(F.col("task") == task), config), *columns)
    assert [r for r in found if r[1] in names] == sorted(expected, key=str)
    assert any(r[1] is None for r in found)


def test_records_of_no_tasks(spark):
    empty = spark.createDataFrame([], SCHEMA).withColumn("split", F.lit("train"))
    config = RecordConfig("", "", 2)
    assert build_classification_tasks(empty, "task", F.lit("x"), config).count() == 0
    assert build_regression_tasks(empty, "task", F.lit("x"), config).count() == 0
