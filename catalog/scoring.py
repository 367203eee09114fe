"""Reading of model answers and metrics, over one prediction per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    JUDGED, PREDICTIONS, Query, YES_NO, documents, h, predictions, strip,
)
from catalog.models import stub_model
from shotweave.functions.parsing import parse_number, parse_yes_no, true_label, true_value
from shotweave.operators.metrics import (
    accuracy, evaluate_classification, evaluate_regression, metric_for_task, pr_auc, r2, rmse,
    roc_auc,
)
from shotweave.operators.scoring import (
    finite_only, invalid_count, predict, resolve_label, with_true_label,
)
from shotweave.sources.records import write_metrics
from shotweave.storage import scratch_path

BY = ("task", "strategy")


def answered(spark, sf):
    d = documents(spark, sf).select("row_id", F.col("text").alias("instruction"))
    return predict(d, stub_model).drop("instruction")


def yes_no(spark, sf):
    return predictions(spark, sf).select("row_id", parse_yes_no(F.col("model_output")).alias("parsed"))


def _resolved(rule: str) -> Query:
    def run(spark, sf):
        rows = resolve_label(predictions(spark, sf), rule)
        return rows.select("row_id", "predicted_label", F.round("yes_prob", 6).alias("yes_prob"))

    return run


def number(spark, sf):
    return predictions(spark, sf).select("row_id", parse_number(F.col("number_output")).alias("value"))


def truths(spark, sf):
    p = predictions(spark, sf)
    return p.select(
        "row_id", true_label(F.col("output")).alias("true_label"),
        true_value(F.col("number_output")).alias("true_value"),
    )


def invalid(spark, sf):
    return invalid_count(predictions(spark, sf), "task")


def finite(spark, sf):
    p = F.col("p_yes")
    odd = F.when(p < 0.1, F.lit("NaN").cast("double")).when(p > 0.9, F.lit("Infinity").cast("double"))
    rows = predictions(spark, sf).select("row_id", F.coalesce(odd, p).alias("yes_prob"))
    return finite_only(rows)


def _judged(spark, sf):
    rows = with_true_label(resolve_label(predictions(spark, sf), "p_yes"))
    return rows.withColumns(
        {"predicted_value": parse_number(F.col("number_output")), "true_value": F.col("value")}
    )


def _metric(function, name: str) -> Query:
    def run(spark, sf):
        wide = function(_judged(spark, sf), *BY)
        return wide.withColumn(name, F.round(name, 6))

    return run


def overall_auc(spark, sf):
    """One value over all tasks: every row in one group."""
    wide = roc_auc(_judged(spark, sf))
    return wide.select(F.round("roc_auc", 6).alias("roc_auc"))


def chosen_metric(spark, sf):
    return predictions(spark, sf).select("row_id", metric_for_task(F.col("task")).alias("metric"))


def classification_report(spark, sf):
    return evaluate_classification(_judged(spark, sf))


def regression_report(spark, sf):
    return evaluate_regression(_judged(spark, sf))


def metrics_written(spark, sf):
    path = scratch_path(spark, "scores")
    write_metrics(regression_report(spark, sf), path)
    read = spark.read.schema("task string, strategy string, metric string, value double").json(f"{path}_metrics")
    return read.select("task", "strategy", "metric", "value")


QUERIES: dict[str, Query] = {
    "predict_stub": answered,
    "parse_yes_no": yes_no,
    "resolve_label": _resolved("p_yes"),
    "resolve_label_ratio": _resolved("ratio"),
    "resolve_label_default": _resolved("default"),
    "parse_number": number,
    "truth_label": truths,
    "invalid_count": invalid,
    "finite_filter": finite,
    "accuracy": _metric(accuracy, "accuracy"),
    "roc_auc": _metric(roc_auc, "roc_auc"),
    "roc_auc_overall": overall_auc,
    "pr_auc": _metric(pr_auc, "pr_auc"),
    "metric_selection": chosen_metric,
    "rmse": _metric(rmse, "rmse"),
    "r2": _metric(r2, "r2"),
    "evaluate_classification": classification_report,
    "evaluate_regression": regression_report,
    "write_metrics": metrics_written,
}


def _resolved_sql(usable: str) -> str:
    return f"""WITH {PREDICTIONS},
      parsed AS (SELECT row_id, CASE WHEN NOT failed THEN {YES_NO} END AS y,
        CASE WHEN NOT failed THEN {usable} END AS u FROM predictions)
      SELECT row_id, coalesce(y, CASE WHEN u >= 0.5 THEN 1 WHEN u < 0.5 THEN 0 END, 0) AS predicted_label,
        round(coalesce(y::DOUBLE, u, 0.5::DOUBLE), 6) AS yes_prob FROM parsed"""


CURVE = f"""{JUDGED},
points AS (SELECT task, strategy, yes_prob AS score, sum(true_label) AS tp, sum(1 - true_label) AS fp,
    sum((true_label = predicted_label)::INTEGER) AS hits
  FROM judged GROUP BY ALL),
curve AS (SELECT *, sum(tp) OVER w - tp AS tpb, sum(fp) OVER w - fp AS fpb,
    sum(tp) OVER (PARTITION BY task, strategy) AS p, sum(fp) OVER (PARTITION BY task, strategy) AS n
  FROM points WINDOW w AS (PARTITION BY task, strategy ORDER BY score DESC)),
areas AS (SELECT task, strategy, sum(hits) / max(p + n) AS acc,
    sum(fp * (tpb + tp / 2)) / (max(p) * max(n)) AS roc,
    sum(tp * ((tpb + tp) / (tpb + tp + fpb + fp)
      + CASE WHEN tpb + fpb > 0 THEN tpb / (tpb + fpb) ELSE 1 END) / 2) / max(p) AS pr
  FROM curve GROUP BY ALL)"""

ERRORS = f"""{JUDGED},
means AS (SELECT task, strategy, avg(value) AS m FROM judged GROUP BY ALL),
errors AS (SELECT task, strategy, sqrt(avg(pow(value - predicted_value, 2))) AS rmse,
    1 - sum(pow(value - predicted_value, 2)) / sum(pow(value - m, 2)) AS r2
  FROM judged JOIN means USING (task, strategy) GROUP BY ALL)"""

_REGRESSION_SQL = f"""WITH {ERRORS} SELECT task, strategy, 'RMSE' AS metric, round(rmse, 4) AS value FROM errors
      UNION ALL SELECT task, strategy, 'R2', round(r2, 4) FROM errors"""

ORACLES: dict[str, str] = {
    "predict_stub": f"""WITH a AS (SELECT doc_id AS row_id, {h('text')} AS n FROM documents)
      SELECT row_id, CASE WHEN n % 97 = 0 THEN '' ELSE ['Yes', 'no', 'hm'][1 + n % 3] END AS model_output,
        CASE WHEN n % 97 <> 0 THEN (n % 101) / 100.0::DOUBLE END AS p_yes,
        CASE WHEN n % 97 <> 0 THEN (n % 7) / 10.0::DOUBLE END AS p_no, n % 97 = 0 AS failed FROM a""",
    "parse_yes_no": f"WITH {PREDICTIONS} SELECT row_id, {YES_NO} AS parsed FROM predictions",
    "resolve_label": _resolved_sql("p_yes::DOUBLE"),
    "resolve_label_ratio": _resolved_sql("(p_yes::DOUBLE + 1e-9) / (p_yes::DOUBLE + p_no::DOUBLE + 1e-9)"),
    "resolve_label_default": _resolved_sql("NULL::DOUBLE"),
    "parse_number": f"""WITH {PREDICTIONS} SELECT row_id,
      coalesce(nullif(regexp_extract(number_output, '[-+]?\\d*\\.?\\d+'), '')::DOUBLE, 0.0::DOUBLE) AS value
      FROM predictions""",
    "truth_label": f"""WITH {PREDICTIONS} SELECT row_id,
      CASE WHEN lower({strip('output')}) = 'yes' THEN 1 ELSE 0 END AS true_label,
      CASE WHEN regexp_full_match({strip('number_output')}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
        THEN try_cast({strip('number_output')} AS DOUBLE) END AS true_value FROM predictions""",
    "invalid_count": f"""WITH {PREDICTIONS} SELECT task,
      count(*) FILTER (regexp_matches(coalesce(model_output, ''), '^\\s*$') OR failed) AS invalid, count(*) AS total
      FROM predictions GROUP BY task""",
    "finite_filter": f"""WITH {PREDICTIONS} SELECT row_id, p_yes::DOUBLE AS yes_prob FROM predictions
      WHERE p_yes >= 0.1 AND p_yes <= 0.9""",
    "accuracy": f"""WITH {JUDGED} SELECT task, strategy,
      round(avg((true_label = predicted_label)::INTEGER), 6) AS accuracy FROM judged GROUP BY ALL""",
    "roc_auc": f"WITH {CURVE} SELECT task, strategy, round(roc, 6) AS roc_auc FROM areas",
    "roc_auc_overall": f"""WITH {JUDGED},
      points AS (SELECT yes_prob AS score, sum(true_label) AS tp, sum(1 - true_label) AS fp FROM judged GROUP BY 1),
      curve AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) - tp AS tpb FROM points)
      SELECT round(sum(fp * (tpb + tp / 2)) / (sum(tp) * sum(fp)), 6) AS roc_auc FROM curve""",
    "pr_auc": f"WITH {CURVE} SELECT task, strategy, round(pr, 6) AS pr_auc FROM areas",
    "metric_selection": f"""WITH {PREDICTIONS} SELECT row_id,
      CASE WHEN contains(lower(task), 'low') THEN 'PRC-AUC' ELSE 'ROC-AUC' END AS metric FROM predictions""",
    "rmse": f"WITH {ERRORS} SELECT task, strategy, round(rmse, 6) AS rmse FROM errors",
    "r2": f"WITH {ERRORS} SELECT task, strategy, round(r2, 6) AS r2 FROM errors",
    "evaluate_classification": f"""WITH {CURVE}
      SELECT task, strategy, 'ACC' AS metric, round(acc, 4) AS value FROM areas
      UNION ALL SELECT task, strategy, 'ROC-AUC', round(roc, 4) FROM areas WHERE NOT contains(lower(task), 'low')
      UNION ALL SELECT task, strategy, 'PRC-AUC', round(pr, 4) FROM areas WHERE contains(lower(task), 'low')""",
    "evaluate_regression": _REGRESSION_SQL,
    "write_metrics": _REGRESSION_SQL,
}
