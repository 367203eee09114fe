"""Scoring of a model: prompts with retrieved examples, answers, metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.parsing import true_value
from shotweave.functions.prompts import (
    CLASSIFICATION_SCORING,
    CLASSIFICATION_TAGGED,
    REGRESSION,
    REGRESSION_SCORING,
    Wording,
    classification_prompt,
    no_shots,
    regression_prompt,
)
from shotweave.functions.text import retrieval_text
from shotweave.operators.metrics import evaluate_classification, evaluate_regression
from shotweave.operators.scoring import (
    finite_only,
    predict,
    resolve_label,
    resolve_value,
    with_true_label,
    with_true_value,
)
from shotweave.operators.shots import (
    POOL_SIZE,
    apply_shortfall,
    pool_rows,
    random_shots,
    select_shots,
    shots_array,
)
from shotweave.operators.similarity import build_index, candidate_pool, knn, neighbour_rows
from shotweave.plans.records import value_range
from shotweave.storage import materialise


@dataclass(frozen=True)
class ScoringStyle:
    """The choices in which the scoring runs differ."""

    kind: str
    wording: Wording
    text_rule: str
    shot_text: str
    policy: str
    pool: int | None
    random_from: str
    label_rule: str = "p_yes"
    area: str = "by_task"


# The four scoring runs.
CLASSIFY = ScoringStyle(
    "classification", CLASSIFICATION_TAGGED, "or", "input", "use_what_is_there", None, "pool",
    "p_yes", "roc",
)
CLASSIFY_STRATEGIES = ScoringStyle(
    "classification", CLASSIFICATION_SCORING, "default", "retrieval_text", "zero_shot", POOL_SIZE,
    "pool", "ratio",
)
REGRESS = ScoringStyle(
    "regression", REGRESSION, "default", "retrieval_text", "keep_instruction", None, "index",
)
REGRESS_STRATEGIES = ScoringStyle(
    "regression", REGRESSION_SCORING, "default", "retrieval_text", "zero_shot", None, "index",
)


def scoring_prompts(
    test: DataFrame, train: DataFrame, task_text: str, style: ScoringStyle, shots: int,
    strategy: str = "similarity", seed: int = 42, fingerprint: dict | None = None,
) -> DataFrame:
    """Test records with ``instruction`` replaced by the prompt to score.

    Both inputs are records (row_id, instruction, input, output,
    original_text).  Where no example is shown the policy of the style says
    whether the stored instruction stays or a prompt without examples is made.
    """
    regression = style.kind == "regression"
    if regression and strategy == "diversity":
        raise ValueError("diversity needs yes/no labels")
    lookup = retrieval_text(F.col("original_text"), F.col("input"), style.text_rule)
    options = fingerprint or {}
    queries = build_index(
        test.withColumn("retrieval_text", lookup), "retrieval_text", keep_all=True, **options
    )
    known = train.withColumn("retrieval_text", lookup)
    if regression:
        known = known.where(true_value(F.col("output")).isNotNull())
    index = build_index(known, "retrieval_text", **options)
    low_high = value_range(known.select(true_value(F.col("output")).alias("v")), "v")

    if shots <= 0:
        prepared = queries.withColumn("shots", no_shots())
    else:
        if strategy == "random" and style.random_from == "index":
            chosen = random_shots(queries.where(F.col("packed").isNotNull()), index, shots, seed=seed)
        elif style.pool is None:
            chosen = neighbour_rows(knn(queries, index, shots))
        else:
            pool = pool_rows(candidate_pool(queries, index, style.pool), index, "output")
            chosen = select_shots(pool, strategy, shots, seed)
        listed = shots_array(chosen, index, style.shot_text, "output")
        prepared = queries.join(listed.withColumnRenamed("query_id", "row_id"), "row_id", "left")
    prepared = apply_shortfall(prepared, shots, style.policy)

    if regression:
        ranged = prepared.withColumns(
            {"low": low_high.select("low").scalar(), "high": low_high.select("high").scalar()}
        )
        prompt = regression_prompt(
            F.col("input"), task_text, F.col("low"), F.col("high"), F.col("shots"), style.wording
        )
    else:
        ranged = prepared
        prompt = classification_prompt(F.col("input"), task_text, F.col("shots"), style.wording)
    if style.policy != "zero_shot":
        prompt = F.when(F.size("shots") > 0, prompt).otherwise(F.col("instruction"))
    return ranged.withColumn("instruction", prompt).select(*test.columns)


@dataclass(frozen=True)
class Scored:
    """All result rows and the long metrics table."""

    results: DataFrame
    metrics: DataFrame


def score(
    prompts: DataFrame, model: Callable[[pd.Series], pd.DataFrame], style: ScoringStyle,
    task: str, strategy: str = "similarity",
) -> Scored:
    """Ask the model and judge its answers."""
    named = prompts.withColumns({"task": F.lit(task), "strategy": F.lit(strategy)})
    kept = ["row_id", "task", "strategy", "instruction", "input", "output", "model_output"]
    if style.kind == "regression":
        judged = materialise(resolve_value(predict(with_true_value(named), model)), "scored")
        return Scored(judged.select(*kept, "predicted_value"), evaluate_regression(judged))
    # Written once: rows and metrics must come from the same answers.
    answered = predict(with_true_label(named), model)
    judged = materialise(resolve_label(answered, style.label_rule), "scored")
    return Scored(
        judged.select(*kept, "predicted_label", "yes_prob"),
        evaluate_classification(finite_only(judged), area=style.area),
    )
