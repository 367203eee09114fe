import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotweave.functions.parsing import parse_number, parse_yes_no
from shotweave.operators.metrics import (
    evaluate_classification, evaluate_regression, pr_auc, r2, rmse, roc_auc,
)
from shotweave.operators.scoring import (
    ModelFactory, finite_only, invalid_count, predict, resolve_label,
)
from shotweave.plans.scoring import (
    CLASSIFY, CLASSIFY_STRATEGIES, REGRESS, REGRESS_STRATEGIES, score, scoring_prompts,
)


def test_answers(spark):
    df = spark.createDataFrame([(" Yes.",), ("NO",), ("None",), ("maybe",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(parse_yes_no(F.col("a"))).collect()] == [1, 0, 0, None, None, None]
    df = spark.createDataFrame([("x .5e-3",), ("abc -1.2.3",), ("none",), (None,), ("1e-5",)], "a string")
    assert [r[0] for r in df.select(parse_number(F.col("a"))).collect()] == [0.5, -1.2, 0.0, 0.0, 1.0]


def test_fallback_rules(spark):
    rows = [("yes", 0.1, 0.9, False), ("hm", 0.6, 0.3, False), ("", 0.2, 0.6, False), ("hm", None, None, False),
            ("yes", 0.9, 0.1, True)]
    df = spark.createDataFrame(rows, "model_output string, p_yes double, p_no double, failed boolean")
    found = [(r["predicted_label"], r["yes_prob"]) for r in resolve_label(df, "p_yes").collect()]
    assert found == [(1, 1.0), (1, 0.6), (0, 0.2), (0, 0.5), (0, 0.5)]
    ratio = [r["yes_prob"] for r in resolve_label(df, "ratio").collect()]
    assert ratio[1] == pytest.approx(2 / 3) and ratio[2] == pytest.approx(0.25)
    assert [r["yes_prob"] for r in resolve_label(df, "default").collect()] == [1.0, 0.5, 0.5, 0.5, 0.5]
    assert tuple(invalid_count(df).first()) == (2, 5)


def test_finite_rows(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (float("inf"),), (None,)], "yes_prob double")
    assert [r[0] for r in finite_only(df).collect()] == [0.5]


def pairwise_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def trapezoid(rows):
    positives = sum(y for y, _ in rows)
    area, last = 0.0, (0.0, 1.0)
    for threshold in sorted({s for _, s in rows}, reverse=True):
        chosen = [y for y, s in rows if s >= threshold]
        point = (sum(chosen) / positives, sum(chosen) / len(chosen))
        area += (point[0] - last[0]) * (point[1] + last[1]) / 2
        last = point
    return area


@pytest.mark.parametrize("seed", [1, 2])
def test_areas_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"t{rng.randint(0, 3)}", int(rng.random() < 0.4), rng.randint(0, 12) / 12) for _ in range(300)]
    df = spark.createDataFrame(rows, "task string, true_label int, yes_prob double")
    roc = {r["task"]: r["roc_auc"] for r in roc_auc(df, "task").collect()}
    pr = {r["task"]: r["pr_auc"] for r in pr_auc(df, "task").collect()}
    for task in roc:
        mine = [(y, s) for t, y, s in rows if t == task]
        assert roc[task] == pytest.approx(pairwise_auc(mine))
        assert pr[task] == pytest.approx(trapezoid(mine))
    every = [(y, s) for _, y, s in rows]
    assert roc_auc(df).first()["roc_auc"] == pytest.approx(pairwise_auc(every))


def test_special_areas(spark):
    rows = [("one class", 1, 0.3), ("one class", 1, 0.9), ("none", 0, 0.2), ("flat", 1, 0.5), ("flat", 0, 0.5)]
    df = spark.createDataFrame(rows, "task string, true_label int, yes_prob double")
    assert {r["task"]: r["roc_auc"] for r in roc_auc(df, "task").collect()} == {
        "one class": None, "none": None, "flat": 0.5,
    }
    assert {r["task"]: r["pr_auc"] for r in pr_auc(df, "task").collect()} == {
        "one class": 1.0, "none": 0.5, "flat": 0.75,
    }


def test_regression_metrics(spark):
    rows = [("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("wrong", 2.0, 3.0), ("wrong", 2.0, 2.0),
            ("line", 1.0, 1.5), ("line", 2.0, 2.0), ("line", 3.0, 2.5)]
    df = spark.createDataFrame(rows, "task string, true_value double, predicted_value double")
    assert {r["task"]: r["r2"] for r in r2(df, "task").collect()} == {
        "exact": 1.0, "wrong": 0.0, "line": 0.75,
    }
    found = {r["task"]: r["rmse"] for r in rmse(df, "task").collect()}
    assert found["line"] == pytest.approx((0.5 / 3) ** 0.5)
    long = evaluate_regression(df, by=("task",))
    assert {(r["task"], r["metric"]) for r in long.collect()} == {
        (t, m) for t in ("exact", "wrong", "line") for m in ("RMSE", "R2")
    }


def test_area_follows_the_task_name(spark):
    rows = [(t, "s", y, y, s) for t in ("a_LOW", "b") for y, s in ((1, 0.9), (0, 0.2))]
    df = spark.createDataFrame(
        rows, "task string, strategy string, true_label int, predicted_label int, yes_prob double"
    )
    found = {(r["task"], r["metric"]): r["value"] for r in evaluate_classification(df).collect()}
    assert found == {("a_LOW", "ACC"): 1.0, ("a_LOW", "PRC-AUC"): 1.0, ("b", "ACC"): 1.0, ("b", "ROC-AUC"): 1.0}
    plain = evaluate_classification(df, area="roc").collect()
    assert {r["metric"] for r in plain} == {"AUC", "ACC"}


def test_failed_prompts_get_an_empty_answer(spark):
    def model(prompts: pd.Series) -> pd.DataFrame:
        if prompts.str.contains("bad").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"model_output": prompts.str.upper()})

    df = spark.createDataFrame([("ok",), ("bad",), ("fine",)], "instruction string").coalesce(1)
    found = {r["instruction"]: (r["model_output"], r["p_yes"], r["failed"]) for r in predict(df, model).collect()}
    assert found == {"ok": ("OK", None, False), "bad": ("", None, True), "fine": ("FINE", None, False)}


RECORD = "row_id long, instruction string, input string, output string, original_text string"


def class_records(spark):
    train = [(i, "stored", f"m{i}", ["Yes", "No"][i % 2], f"alpha w{i}") for i in range(8)]
    test = [(100, "stored", "mq", "Yes", "alpha w3"), (101, "stored", "mr", " no ", "")]
    return spark.createDataFrame(test, RECORD), spark.createDataFrame(train, RECORD)


def test_stored_masked_examples(spark):
    test, train = class_records(spark)
    rows = {r["row_id"]: r["instruction"] for r in scoring_prompts(test, train, "T", CLASSIFY, 2).collect()}
    assert rows[100].startswith("Task: Classification\n") and "[SMILES] m3\n[Label] No\n\n" in rows[100]
    assert rows[100].endswith("[SMILES] mq\n[Classification Label]:")
    # An empty original falls back to the input, which has a fingerprint.
    assert rows[101].count("[Label]") == 2


@pytest.mark.parametrize("strategy", ["similarity", "diversity", "random"])
def test_strategies(spark, strategy):
    test, train = class_records(spark)
    rows = {
        r["row_id"]: r["instruction"]
        for r in scoring_prompts(test, train, "T", CLASSIFY_STRATEGIES, 4, strategy).collect()
    }
    assert rows[100].count("Label: ") == 4
    if strategy == "diversity":
        assert rows[100].count("Label: Yes") == 2
    # An empty original is taken as it is, has no fingerprint and gets no examples.
    assert "Label: " not in rows[101] and "masked as '[MASK]'" in rows[101]


def test_shortfall_of_regression_styles(spark):
    train = [(i, "stored", f"m{i}", str(i + 0.5), f"alpha w{i}") for i in range(3)] + [(9, "s", "m", "n/a", "alpha")]
    test = [(100, "stored", "mq", "2.0", "alpha w1"), (101, "stored", "mr", "n/a", "alpha w2")]
    test, train = spark.createDataFrame(test, RECORD), spark.createDataFrame(train, RECORD)
    few = {r["row_id"]: r["instruction"] for r in scoring_prompts(test, train, "T", REGRESS, 5).collect()}
    assert few == {100: "stored", 101: "stored"}
    zero = scoring_prompts(test, train, "T", REGRESS_STRATEGIES, 5, "random").collect()
    assert all("between 0.50 and 2.50" in r["instruction"] and "Value: " not in r["instruction"] for r in zero)
    shown = scoring_prompts(test, train, "T", REGRESS, 2).where("row_id = 100").first()["instruction"]
    assert "SMILES: alpha w1\nPredicted Value: 1.5\n\n" in shown
    with pytest.raises(ValueError, match="diversity"):
        scoring_prompts(test, train, "T", REGRESS, 2, "diversity")


def test_scoring_end_to_end(spark):
    test, train = class_records(spark)
    prompts = scoring_prompts(test, train, "T", CLASSIFY_STRATEGIES, 2)

    def model(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"model_output": ["yes" if "mq" in p else "no" for p in batch]})

    scored = score(prompts, model, CLASSIFY_STRATEGIES, "task_a")
    assert scored.results.count() == 2
    assert {r["metric"]: r["value"] for r in scored.metrics.collect()} == {"ACC": 1.0, "ROC-AUC": 1.0}

    def number(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"model_output": ["about 2.0 units"] * len(batch)})

    rows = spark.createDataFrame([(1, "p", "m", "1.0", "t"), (2, "p", "m", "3.0", "t"), (3, "p", "m", "x", "t")], RECORD)
    scored = score(rows, number, REGRESS, "task_b")
    assert [r["predicted_value"] for r in scored.results.collect()] == [2.0, 2.0]
    assert {r["metric"]: r["value"] for r in scored.metrics.collect()} == {"RMSE": 1.0, "R2": 0.0}


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda prompts: pd.DataFrame({"model_output": prompts.str.upper()})

    factory = ModelFactory(uuid.uuid4().hex, load)
    df = spark.range(400).select(F.concat(F.lit("p"), "id").alias("instruction")).repartition(16)
    for _ in range(2):
        assert {r["model_output"] for r in predict(df, factory).collect()} == {f"P{i}" for i in range(400)}
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) > 0


def test_a_model_that_does_not_load_ends_the_job(spark):
    def load():
        raise OSError("no weights")

    df = spark.createDataFrame([("p",)], "instruction string")
    with pytest.raises(Exception, match="no weights"):
        predict(df, ModelFactory(uuid.uuid4().hex, load)).collect()


def test_batches_are_bounded_by_their_text(spark):
    def model(prompts):
        seen = int(prompts.fillna("").str.len().sum())
        return pd.DataFrame({"model_output": [f"{len(prompts)} {seen}"] * len(prompts)})

    lengths = [5, 90, 10, 300, 1, 1, 98, 100]
    df = spark.createDataFrame([("x" * n,) for n in lengths] + [(None,)], "instruction string").coalesce(1)
    found = [r["model_output"] for r in predict(df, model, batch_chars=100).collect()]
    assert found == ["2 95"] * 2 + ["1 10"] + ["1 300"] + ["3 100"] * 3 + ["2 100"] * 2
