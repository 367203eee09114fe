import random

import pytest
from pyspark.sql import functions as F

from shotweave.operators import split
from shotweave.functions.text import label_text, rotations
from shotweave.operators.balance import oversample_minority
from shotweave.operators.cleaning import (
    coerce_label, coerce_numeric, dedup_keep_first, has_min_rows, with_canonical_key,
)
from shotweave.operators.prefix import global_ordinal, global_prefix_sum
from shotweave.operators.split import group_split, with_group_key


def test_numbers_follow_plain_notation(spark):
    texts = [" 0.7 ", "1f", "1d", "inf", "abc", None, "1e400", "-3"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, label string")
    found = {r["row_id"]: r["label"] for r in coerce_numeric(df, "label").collect()}
    assert found == {0: 0.7, 7: -3.0}


def test_class_labels_are_cut_toward_zero(spark):
    df = spark.createDataFrame([(1, 0.7), (2, -0.7), (3, 1.9)], "row_id int, label double")
    assert {r["row_id"]: r["label"] for r in coerce_label(df, "label").collect()} == {1: 0, 2: 0, 3: 1}


def test_label_text(spark):
    df = spark.createDataFrame([(1,), (0,), (2,), (-1,)], "label int")
    texts = [r[0] for r in df.select(label_text(F.col("label"))).collect()]
    assert texts == ["Yes", "No", "No", "No"]


def test_first_row_keeps_its_text(spark):
    rows = [(5, "a  b"), (2, "A b "), (3, "   "), (4, None)]
    df = with_canonical_key(spark.createDataFrame(rows, "row_id int, text string"), "text")
    once = dedup_keep_first(df)
    assert [tuple(r) for r in once.collect()] == [(2, "A b ")]
    assert dedup_keep_first(with_canonical_key(once, "text")).count() == 1


def test_size_gate(spark):
    assert has_min_rows(spark.range(20))
    with pytest.warns(UserWarning, match="only 19 rows"):
        assert not has_min_rows(spark.range(19))


def greedy(groups, valid=0.1, test=0.1):
    """Plain reading of the rule: largest group first, fill validation, test, train."""
    n = sum(size for size, _ in groups.values())
    filled = {"validation": 0, "test": 0}
    result = {}
    for name in sorted(groups, key=lambda g: (-groups[g][0], groups[g][1])):
        if filled["validation"] / n < valid:
            result[name] = "validation"
        elif filled["test"] / n < test:
            result[name] = "test"
        else:
            result[name] = "train"
        if result[name] in filled:
            filled[result[name]] += groups[name][0]
    return result


@pytest.mark.parametrize("sizes", [[5, 3, 1, 1], [7], [1] * 30, [40, 1, 1, 1], [2, 2, 2, 2, 2, 2]])
def test_split_equals_the_greedy_rule(spark, sizes):
    keys = [g for g, size in enumerate(sizes) for _ in range(size)]
    random.Random(len(keys)).shuffle(keys)
    df = spark.createDataFrame([(i, f"g{g}") for i, g in enumerate(keys)], "row_id long, group_key string")
    groups = {f"g{g}": (size, keys.index(g)) for g, size in enumerate(sizes)}
    rows = group_split(df).collect()
    assert len(rows) == len(keys)
    assert {r["group_key"]: r["split"] for r in rows} == greedy(groups)


@pytest.mark.parametrize("broadcast_below", [0, 2**24])
def test_hot_and_cold_groups_are_both_joined(spark, monkeypatch, broadcast_below):
    monkeypatch.setattr("shotweave.storage.BROADCAST_BELOW", broadcast_below)
    # One group holds a third of the rows, the others one row each.
    df = spark.range(6000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("group_key"),
    )
    split = group_split(df)
    assert split.count() == 6000
    per_group = split.groupBy("group_key").agg(F.count_distinct("split").alias("n"))
    assert per_group.where("n > 1").count() == 0
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"validation": 2000, "test": 600, "train": 3400}


@pytest.mark.parametrize("task", [None, "task"])
def test_groups_meet_on_sixteen_bytes(spark, monkeypatch, task):
    """A digest as 64 characters was most of what a split of short keys shuffled."""
    seen, attach = [], split.attach_by_key

    def attached(rows, keyed, key, size, *rest):
        if key == "__group":
            seen.append({n for r in rows.select(F.octet_length(key).alias("n")).collect() for n in r})
        return attach(rows, keyed, key, size, *rest)

    monkeypatch.setattr(split, "attach_by_key", attached)
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("group_key"), F.lit("t").alias("task"))
    assert split.group_split(df, task=task).count() == 60
    assert seen == [{16}]


def test_rows_without_a_group_are_kept(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "row_id long, group_key string")
    rows = {r["row_id"]: r["split"] for r in group_split(df).collect()}
    assert rows == {1: "validation", 3: "validation", 2: "test"}


def test_empty_group_falls_back_to_the_text(spark):
    df = spark.createDataFrame([(None, "t1"), ("", "t2"), ("g", "t3")], "g string, text string")
    assert [r["group_key"] for r in with_group_key(df, "g", "text").collect()] == ["t1", "t2", "g"]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_running_sum_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("w"))
        rows = global_prefix_sum(df, [F.col("k").desc()], {"w": "before"}).orderBy(F.desc("k")).collect()
        total = 0
        for row in rows:
            assert row["before"] == total
            total += row["w"]
        ordinals = [r["at"] for r in global_ordinal(df, [F.col("k")], "at").orderBy("k").collect()]
        assert ordinals == list(range(1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("large, small, added", [(11, 2, 0), (10, 2, 0), (30, 2, 4)])
def test_oversampling_targets(spark, large, small, added):
    rows = [(i, f"some words for row {i}", int(i < large)) for i in range(large + small)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    grown = oversample_minority(df, "label", "text")
    new = grown.where("is_augmented").collect()
    assert len(new) == added and grown.count() == len(rows) + added
    assert all(r["label"] == 0 for r in new)
    assert not {r["text"] for r in new} & {t for _, t, _ in rows}
    assert grown.select("row_id").distinct().count() == grown.count()


def test_rows_without_a_variant_take_no_share(spark):
    rows = [(i, "word", 1) for i in range(30)] + [(30, "same same", 0), (31, "a b", 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    new = oversample_minority(df, "label", "text").where("is_augmented").collect()
    assert [r["text"] for r in new] == ["b a"] * 4


def test_variants_differ_from_the_source(spark):
    df = spark.createDataFrame([("a b a b",), ("x",), ("a b c",)], "text string")
    found = [r[0] for r in df.select(rotations(F.col("text"))).collect()]
    assert found == [["b a b a"], [], ["b c a", "c a b"]]
