"""Accuracy, ROC-AUC, PR-AUC, RMSE and R2 per task.

Every metric is one pass of partial aggregation.  The two areas need running
counts over the scores; they come from a prefix sum over all tasks at once, so
a task with most of the rows is spread over many partitions like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column
from shotweave.functions.text import rounded
from shotweave.operators.joins import attach_by_key
from shotweave.operators.prefix import global_prefix_sum
from shotweave.storage import materialise

# Fixed values.
PR_MARKER = "low"
DIGITS = 4


def accuracy(df: DataFrame, *by: str, y: str = "true_label", p: str = "predicted_label") -> DataFrame:
    """Share of rows whose label is right."""
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def _digest(names: list[str]) -> Column:
    shown = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names]
    return F.sha2(F.to_json(F.array(*shown)), 256)


def _curve(
    df: DataFrame, by: tuple[str, ...], y: str, score: str, right: Column | None = None
) -> DataFrame:
    """One row per task and score, from high to low, with counts before it.

    ``tp`` and ``fp`` are the positives and negatives at the score;
    ``tp_before`` and ``fp_before`` those above it in the same task.
    ``right`` optionally counts rows that meet a condition.
    """
    points = df.groupBy(*by, F.col(score).alias("__score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("tp"),
        F.sum(1 - F.col(y).cast("bigint")).alias("fp"),
        F.count_if(F.lit(False) if right is None else right).alias("right"),
    )
    order = [*[F.col(b) for b in by], F.col("__score").desc()]
    running = global_prefix_sum(points, order, {"tp": "tp_all", "fp": "fp_all"})
    totals = running.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(
        F.min("tp_all").alias("tp_start"), F.min("fp_all").alias("fp_start"),
        F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"), F.count("*").alias("__points"),
    )
    if by:
        # A digest stands for the task, so that NULL is a task as well.
        totals = materialise(
            totals.withColumn("__key", _digest([f"__{b}" for b in by])).drop(*[f"__{b}" for b in by]), "totals"
        )
        joined = attach_by_key(running.withColumn("__key", _digest(list(by))), totals, "__key", "__points")
        joined = joined.drop("__key")
    else:
        joined = running.withColumn("t", totals.select(F.struct("*")).scalar()).select("*", "t.*")
    return joined.withColumns(
        {
            "tp_before": F.col("tp_all") - F.col("tp_start"),
            "fp_before": F.col("fp_all") - F.col("fp_start"),
        }
    )


def _roc_area() -> Column:
    # Twice the area in whole numbers, so that any order of adding gives the same.
    wide = "decimal(38,0)"
    steps = F.col("fp").cast("decimal(19,0)") * (
        2 * F.col("tp_before") + F.col("tp")
    ).cast("decimal(19,0)")
    area = F.sum(steps.cast(wide)).cast("double")
    pairs = 2.0 * F.max("positives") * F.max("negatives")
    return F.when(pairs > 0, area / pairs)


def _pr_area() -> Column:
    tp, fp = F.col("tp_before") + F.col("tp"), F.col("fp_before") + F.col("fp")
    precision = tp / (tp + fp)
    seen = F.col("tp_before") + F.col("fp_before")
    earlier = F.when(seen > 0, F.col("tp_before") / seen).otherwise(F.lit(1.0))
    area = F.sum(F.col("tp") * (precision + earlier) / 2)
    positives = F.max("positives")
    # Without positives recall counts as one at every score.
    return F.when(positives > 0, area / positives).otherwise(F.lit(0.5))


def roc_auc(df: DataFrame, *by: str, y: str = "true_label", score: str = "yes_prob") -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL with one class only."""
    return _curve(df, by, y, score).groupBy(*by).agg(_roc_area().alias("roc_auc"))


def pr_auc(df: DataFrame, *by: str, y: str = "true_label", score: str = "yes_prob") -> DataFrame:
    """Trapezoid area under precision over recall; 0.5 without any positive."""
    return _curve(df, by, y, score).groupBy(*by).agg(_pr_area().alias("pr_auc"))


def metric_for_task(task) -> Column:
    """Which area a task reports: PRC-AUC when its name contains ``low``."""
    low = F.lower(as_column(task)).contains(PR_MARKER)
    return F.when(low, F.lit("PRC-AUC")).otherwise(F.lit("ROC-AUC"))


def _square_error(y: str, p: str) -> Column:
    return F.pow(F.col(y) - F.col(p), F.lit(2.0))


def rmse(df: DataFrame, *by: str, y: str = "true_value", p: str = "predicted_value") -> DataFrame:
    """Root of the mean squared error."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(_square_error(y, p))).alias("rmse"))


def _r2(y: str, p: str) -> Column:
    residual = F.sum(_square_error(y, p))
    # The spread is updated around a running mean, not as a difference of squares.
    spread = F.regr_syy(F.col(y), F.lit(1.0))
    constant = F.min(y) == F.max(y)
    perfect = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    known = F.when(constant, perfect).otherwise(1 - residual / spread)
    return F.when(F.count(F.col(y)) >= 2, known)


def r2(df: DataFrame, *by: str, y: str = "true_value", p: str = "predicted_value") -> DataFrame:
    """Share of variance explained; may be negative.

    With constant truth it is 1 for exact predictions and 0 otherwise; of fewer
    than two rows it is NULL.
    """
    return df.groupBy(*by).agg(_r2(y, p).alias("r2"))


def _long(wide: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by..., metric, value), rounded; metrics that do not apply are left out."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), rounded(value, DIGITS).alias("value"), keep.alias("keep"))
            for name, (value, keep) in values.items()
        ]
    )
    return (
        wide.select(*by, F.explode(entries).alias("m"))
        .where(F.col("m.keep"))
        .select(*by, "m.metric", "m.value")
    )


def evaluate_classification(
    df: DataFrame, by: tuple[str, ...] = ("task", "strategy"), task: str = "task",
    y: str = "true_label", p: str = "predicted_label", score: str = "yes_prob",
    area: str = "by_task",
) -> DataFrame:
    """Long table of ACC and the area metric.

    ``by_task`` chooses ROC-AUC or PRC-AUC by task name; ``roc`` always
    reports the first, under the name AUC.  With one class the accuracy is
    still reported and the area is NULL.  All from one running count.
    """
    curve = _curve(df, by, y, score, F.col(y) == F.col(p))
    rows = F.max("positives") + F.max("negatives")
    wide = curve.groupBy(*by).agg(
        _roc_area().alias("roc"), _pr_area().alias("pr"), (F.sum("right") / rows).alias("acc")
    )
    always = F.lit(True)
    if area == "roc":
        return _long(wide, list(by), {"AUC": (F.col("roc"), always), "ACC": (F.col("acc"), always)})
    chosen = metric_for_task(F.col(task))
    return _long(
        wide, list(by),
        {
            "ACC": (F.col("acc"), always),
            "ROC-AUC": (F.col("roc"), chosen == "ROC-AUC"),
            "PRC-AUC": (F.col("pr"), chosen == "PRC-AUC"),
        },
    )


def evaluate_regression(
    df: DataFrame, by: tuple[str, ...] = ("task", "strategy"),
    y: str = "true_value", p: str = "predicted_value",
) -> DataFrame:
    """Long table of RMSE and R2."""
    wide = df.groupBy(*by).agg(
        F.sqrt(F.avg(_square_error(y, p))).alias("rmse"), _r2(y, p).alias("r2")
    )
    always = F.lit(True)
    return _long(wide, list(by), {"RMSE": (F.col("rmse"), always), "R2": (F.col("r2"), always)})
