"""From model answers to labels, values and valid rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.functions.parsing import (
    DECISION_THRESHOLD,
    DEFAULT_LABEL,
    DEFAULT_PROBABILITY,
    fallback_probability,
    parse_number,
    parse_yes_no,
    true_label,
    true_value,
)
from shotweave.functions.text import strip

PREDICTION_FIELDS = [
    T.StructField("model_output", T.StringType()),
    T.StructField("p_yes", T.DoubleType()),
    T.StructField("p_no", T.DoubleType()),
    T.StructField("failed", T.BooleanType()),
]


Model = Callable[[pd.Series], pd.DataFrame]

#: Characters of prompts that a model gets at once.
BATCH_CHARS = 1 << 18


@dataclass(frozen=True)
class ModelFactory:
    """How a worker gets its model: ``load()`` runs once in each worker process.

    Only the name and the function travel to the tasks.  The name tells models
    apart; a worker that meets it again, in whatever job, keeps the model it has.
    """

    name: str
    load: Callable[[], Model]


_MODELS: dict[str, Model] = {}


def model_of(model: Model | ModelFactory) -> Model:
    """The model itself, loaded where this worker does not have it yet."""
    if not isinstance(model, ModelFactory):
        return model
    if model.name not in _MODELS:
        _MODELS[model.name] = model.load()
    return _MODELS[model.name]


def _stretches(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of prompts of about ``most`` characters; a longer prompt stands alone."""
    begin = size = 0
    for at, length in enumerate(lengths):
        if at > begin and size + length > most:
            yield begin, at
            begin, size = at, 0
        size += length
    if begin < len(lengths):
        yield begin, len(lengths)


def predict(
    df: DataFrame, model: Model | ModelFactory, prompt: str = "instruction", batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """Add a model's answers: ``model_output``, ``p_yes``, ``p_no``, ``failed``.

    ``model`` maps a batch of prompts to a frame with ``model_output`` and,
    where known, the two probabilities; a :class:`ModelFactory` loads it on the
    workers, and an error there is no failed prompt but ends the job.  A batch has
    prompts of at most ``batch_chars`` characters in all, or one.  A batch that
    fails is halved until the prompts that fail stand alone; those get an empty
    answer.  A probability that is None, or whose column the model leaves out, is
    NULL; NaN stays NaN.
    """
    schema = T.StructType(df.schema.fields + PREDICTION_FIELDS)
    place = df.columns.index(prompt)

    def number(value) -> float | None:
        return None if value is None or value is pd.NA else float(value)

    def ask(answer: Model, prompts: pd.Series) -> list[tuple]:
        answers = answer(prompts)
        if len(answers) != len(prompts):
            raise ValueError("a model must answer every prompt")
        known = answers.reindex(columns=["model_output"]).astype(object)
        texts = [None if t is None or t is pd.NA or t != t else str(t) for t in known["model_output"]]
        numbers = [
            [number(v) for v in answers[p]] if p in answers.columns else [None] * len(texts) for p in ("p_yes", "p_no")
        ]
        return list(zip(texts, *numbers, [False] * len(texts)))

    def ask_all(answer: Model, prompts: pd.Series) -> list[tuple]:
        try:
            return ask(answer, prompts)
        except Exception:
            if len(prompts) == 1:
                return [("", None, None, True)]
            half = len(prompts) // 2
            return ask_all(answer, prompts[:half]) + ask_all(answer, prompts[half:])

    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()
            for begin, end in _stretches(lengths, batch_chars):
                part = batch.slice(begin, end - begin)
                answers = zip(*ask_all(model_of(model), part.column(place).to_pandas()))
                added = [pa.array(values, kind) for values, kind in zip(answers, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def resolve_label(df: DataFrame, rule: str = "p_yes") -> DataFrame:
    """Add ``predicted_label`` and ``yes_prob`` for every answer.

    A readable answer is certain.  Otherwise the fallback probability of
    ``rule`` decides, and without one the row gets the default label and
    probability.  A probability that is not a number decides for no and stays
    with the row.  A failed row always gets the default.
    """
    parsed = F.when(~_flag(df, "failed"), parse_yes_no(F.col("model_output")))
    usable = F.when(~_flag(df, "failed"), fallback_probability(F.col("p_yes"), F.col("p_no"), rule))
    probability = F.coalesce(parsed.cast("double"), usable, F.lit(DEFAULT_PROBABILITY))
    sure = ~F.isnan(usable) & (usable >= DECISION_THRESHOLD)
    guessed = F.when(usable.isNotNull(), sure.cast("int"))
    return df.withColumns(
        {
            "predicted_label": F.coalesce(parsed, guessed, F.lit(DEFAULT_LABEL)),
            "yes_prob": probability,
        }
    )


def resolve_value(df: DataFrame) -> DataFrame:
    """Add ``predicted_value``: the first number of the answer, else 0."""
    return df.withColumn("predicted_value", parse_number(F.col("model_output")))


def with_true_label(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``true_label`` from the expected answer."""
    return df.withColumn("true_label", true_label(F.col(output)))


def with_true_value(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``true_value``; rows whose expected answer is no number are dropped."""
    return df.withColumn("true_value", true_value(F.col(output))).na.drop(subset=["true_value"])


def invalid_count(df: DataFrame, *by: str) -> DataFrame:
    """Empty or failed answers (``invalid``) and all rows (``total``)."""
    empty = strip(F.coalesce(F.col("model_output"), F.lit(""))) == ""
    return df.groupBy(*by).agg(
        F.count_if(empty | _flag(df, "failed")).alias("invalid"), F.count("*").alias("total")
    )


def finite_only(df: DataFrame, probability: str = "yes_prob") -> DataFrame:
    """Rows whose probability is a finite number."""
    p = F.col(probability)
    return df.where(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf"))))
