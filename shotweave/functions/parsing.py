"""Expressions that read a model's answer and the expected answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column
from shotweave.functions.text import strip, to_number

# Fixed values.
ANSWER_NUMBER_PATTERN = r"[-+]?\d*\.?\d+"
DEFAULT_LABEL, DEFAULT_PROBABILITY, DEFAULT_VALUE = 0, 0.5, 0.0
SMOOTHING = 1e-9
DECISION_THRESHOLD = 0.5


def parse_yes_no(answer) -> Column:
    """1 for an answer starting with yes, 0 for no, else NULL."""
    text = F.lower(strip(answer))
    return F.when(text.startswith("yes"), F.lit(1)).when(text.startswith("no"), F.lit(0))


def parse_number(answer, default: float | None = DEFAULT_VALUE) -> Column:
    """First decimal number in an answer; exponents are not read."""
    found = F.nullif(
        F.regexp_extract(as_column(answer), ANSWER_NUMBER_PATTERN, 0), F.lit("")
    )
    return F.coalesce(found.try_cast("double"), F.lit(default).cast("double"))


def true_label(output) -> Column:
    """1 when the expected answer is yes, else 0."""
    return F.when(F.lower(strip(output)) == "yes", F.lit(1)).otherwise(F.lit(0))


def true_value(output) -> Column:
    """The expected number; NULL marks a row that scoring skips."""
    return to_number(strip(output))


def fallback_probability(p_yes, p_no, rule: str) -> Column:
    """P(yes) for an answer that could not be read, before the default.

    ``p_yes`` takes the probability as it is, ``ratio`` relates it to P(no),
    ``default`` ignores both.
    """
    p_yes, p_no = as_column(p_yes), as_column(p_no)
    if rule == "p_yes":
        return p_yes
    if rule == "ratio":
        return (p_yes + SMOOTHING) / (p_yes + p_no + SMOOTHING)
    if rule == "default":
        return F.lit(None).cast("double")
    raise ValueError(f"unknown rule {rule!r}: use 'p_yes', 'ratio' or 'default'")
