"""Rounding, masking, scoring and hot-key edges."""

import contextlib
import io
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotweave.functions.text import decimal_text, format_label, lossless_words, rounded
from shotweave.operators import scoring
from shotweave.operators.balance import oversample_minority
from shotweave.operators.cleaning import keep_large_tasks
from shotweave.operators.masking import MASK, TAG_PREFIX, TOO_SHORT, mask_token
from shotweave.operators.metrics import evaluate_classification, r2, roc_auc
from shotweave.operators.shots import random_shots
from shotweave.sources.tables import read_task
from shotweave.storage import cleanup, materialise, scratch_dir

NUMBERS = [
    2.00005, 2.675, 0.125, 0.375, 1 / 32, 3 / 32, 0.5, 1.5, 2.5, 0.00005, 0.00015, -0.125, -2.675, 12345678.90625, 1e10 + 0.5,
    0.1, 0.2, 0.3, 1 / 3, 99.99995, 0.99995, 0.0, 123456789012.5, 1e15, 0.045, 1.005, 4.35, 0.03125, 0.09375,
]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr("shotweave.operators.joins.fits_broadcast", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decimals_are_those_of_the_exact_value(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    rows = df.select("x", decimal_text(F.col("x"), 2).alias("two"), format_label(F.col("x")).alias("four"), rounded(F.col("x"), 4).alias("r"))
    for row in rows.collect():
        assert row["two"] == "%.2f" % row["x"] and row["four"] == "%.4f" % row["x"] and row["r"] == round(row["x"], 4)


def test_masking_loses_nothing(spark):
    texts = ["CC(=O)Oc1  B Cl", "  a\tb \n C  d  ", "one two", "", "   ", None, "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string").withColumn("tokens", lossless_words(F.col("text")))
    for row in mask_token(df, "text", "tokens", "row_id").collect():
        if row["mask_tag"] == TOO_SHORT:
            assert row["masked"] == row["text"]
        else:
            hidden = row["mask_tag"].removeprefix(TAG_PREFIX)
            assert row["masked"].replace(MASK, hidden) == row["text"] and row["masked"] != row["text"]


def test_probabilities_that_are_no_numbers(spark):
    answers = {"nan": ("maybe", math.nan), "none": ("maybe", None), "low": ("maybe", 0.2), "high": ("maybe", 0.7), "yes": ("Yes", math.nan)}

    def model(prompts):
        found = [answers[p] for p in prompts]
        return pd.DataFrame({"model_output": [a for a, _ in found], "p_yes": pd.Series([p for _, p in found], dtype=object)})

    df = spark.createDataFrame([(p,) for p in answers], "instruction string").repartition(1)
    judged = scoring.resolve_label(scoring.predict(df, model))
    rows = {r["instruction"]: (r["predicted_label"], r["yes_prob"]) for r in judged.collect()}
    assert rows["nan"][0] == 0 and math.isnan(rows["nan"][1])
    assert rows["none"] == (0, 0.5) and rows["low"] == (0, 0.2) and rows["high"] == (1, 0.7) and rows["yes"] == (1, 1.0)
    assert {r["instruction"] for r in scoring.finite_only(judged).collect()} == set(answers) - {"nan"}


def test_answers_of_blanks_are_invalid(spark):
    df = spark.createDataFrame([("\n",), ("",), (" \t",), (None,), ("x",)], "model_output string")
    assert tuple(scoring.invalid_count(df).first()) == (4, 5)


def test_one_row_has_no_r2_and_ties_round_to_even(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "task string, true_value double, predicted_value double")
    assert {r["task"]: r["r2"] for r in r2(df, "task").collect()} == {"a": None, "b": 1.0}
    rows = [("t", "s", 1, int(i > 0), 0.5) for i in range(32)]
    df = spark.createDataFrame(rows, "task string, strategy string, true_label int, predicted_label int, yes_prob double")
    values = {r["metric"]: r["value"] for r in evaluate_classification(df).collect()}
    assert values["ACC"] == round(31 / 32, 4) == 0.9688


def test_random_shots_grow_linearly(spark):
    queries, index = spark.range(6).toDF("row_id"), spark.range(100, 180).toDF("row_id")
    found = random_shots(queries, index, 50).collect()
    for q in range(6):
        mine = [r for r in found if r["query_id"] == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 51)) and len({r["neighbour_id"] for r in mine}) == 50
    assert random_shots(queries, index, 81).count() == 0 and random_shots(queries, index, 0).count() == 0


def test_hot_tasks_are_not_shuffled(spark, no_broadcast):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3900, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("task"),
        F.lit("s").alias("strategy"), (F.col("id") % 2).cast("int").alias("true_label"),
        (F.col("id") % 97 / 97.0).alias("yes_prob"), (F.col("id") % 2).cast("int").alias("predicted_label"),
    )
    kept = keep_large_tasks(df, "task", 20)
    assert kept.columns == df.columns and kept.count() == 4000
    shown = plan(kept)
    assert "BroadcastHashJoin LeftAnti" in shown and "BroadcastHashJoin Inner" in shown
    areas = {r["task"]: r["roc_auc"] for r in roc_auc(df, "task").collect()}
    assert set(areas) == {"hot", "t0", "t1", "t2", "t3", "t4"} and areas["hot"] == pytest.approx(0.5, abs=0.05)
    nulls = df.withColumn("task", F.when(F.col("task") != "hot", F.col("task")))
    assert {r["task"]: r["roc_auc"] for r in roc_auc(nulls, "task").collect()}[None] == areas["hot"]


def test_rows_of_a_file_are_not_shuffled_for_their_number(spark, tmp_path, no_broadcast):
    (tmp_path / "t.csv").write_text("text,label\n" + "".join(f"x{i},{i}\n" for i in range(50)))
    df = read_task(spark, str(tmp_path), "text", "label")
    assert "SortMergeJoin" not in plan(df)
    assert [r["label"] for r in df.orderBy("row_id").collect()] == [str(i) for i in range(50)]


def test_one_source_row_with_a_large_quota(spark):
    major = spark.range(1, 50_001).select(F.col("id").alias("row_id"), F.lit("a b c").alias("text"), F.lit(0).alias("label"))
    minor = spark.createDataFrame([(0, "one two three", 1)], "row_id bigint, text string, label int")
    grown = oversample_minority(major.unionByName(minor), "label", "text", ratio=5)
    added = grown.where("is_augmented")
    assert added.count() == 9_999 and added.select("row_id").distinct().count() == 9_999
    assert {r["text"] for r in added.select("text").distinct().collect()} == {"two three one", "three one two"}
    assert "sequence(0" not in plan(grown)


def test_scratch_tables_can_be_removed(spark):
    written = materialise(spark.range(3), "cleanup")
    path = written.inputFiles()[0]
    assert scratch_dir(spark) in path and cleanup(spark) > 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        written.count()
