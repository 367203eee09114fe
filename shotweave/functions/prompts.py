"""Prompt text as Column expressions.

A prompt is described by a :class:`Wording`; the functions below only lay the
pieces out.  The wordings further down are the defaults, other domains pass
their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column
from shotweave.functions.text import decimal_text


@dataclass(frozen=True)
class Wording:
    """Fixed parts of one prompt family; ``{task}`` stands for the task text."""

    opening: str
    answer_rule: str
    examples_header: str
    query_header: str
    zero_shot_note: str
    text_tag: str
    label_tag: str
    ending: str


# Prompt formats.
_RULE_LONG = (
    "Your output MUST be exactly 'Yes' or 'No'. Do NOT include any additional text, "
    "explanations, or examples after your answer.\n\n"
)
_RULE_SHORT = (
    "Your output MUST be exactly 'Yes' or 'No'. Do NOT include any additional text or "
    "explanations.\n\n"
)
_RULE_NUMBER = (
    "The expected output is a single numerical value, typically between {low} and {high}. "
    "Your output MUST be only the number. Do NOT include units, text, or explanations.\n\n"
)
_NOTE_LONG = (
    "Analyze the following molecule's structure. Note that a key part of the molecule has "
    "been masked and is represented by '[MASK]'.\n\n"
)
_NOTE_SHORT = (
    "Analyze the following molecule's structure. Note that a key part has been masked as "
    "'[MASK]'.\n\n"
)
_CLASSIFIER = "You are an expert molecule classifier. Your task is to {task}.\n"
_CHEMIST = "You are an expert molecular chemist. Your task is to {task}.\n"
_HEADER_SIMILAR = "Here are some examples based on molecules with similar structures:\n"
_HEADER_PROVIDED = "Here are some examples based on the provided molecules:\n"
_ASK_CLASS = "Now, based on these examples, classify the following molecule:\n"
_ASK_VALUE = "Now, based on these examples, predict the value for the following molecule:\n"

CLASSIFICATION = Wording(
    _CLASSIFIER, _RULE_LONG, _HEADER_SIMILAR, _ASK_CLASS, _NOTE_LONG,
    "SMILES: ", "Label: ", "Label:",
)
CLASSIFICATION_SCORING = Wording(
    _CLASSIFIER, _RULE_SHORT, _HEADER_PROVIDED, _ASK_CLASS, _NOTE_SHORT,
    "SMILES: ", "Label: ", "Label:",
)
CLASSIFICATION_TAGGED = Wording(
    "Task: Classification\n" + _CLASSIFIER, _RULE_LONG,
    "Here are some examples based on similar molecules:\n", _ASK_CLASS, "",
    "[SMILES] ", "[Label] ", "[Classification Label]:",
)
REGRESSION = Wording(
    _CHEMIST, _RULE_NUMBER, _HEADER_SIMILAR, _ASK_VALUE, _NOTE_SHORT,
    "SMILES: ", "Predicted Value: ", "Predicted Value:",
)
REGRESSION_SCORING = Wording(
    _CHEMIST, _RULE_NUMBER, _HEADER_PROVIDED, _ASK_VALUE, _NOTE_SHORT,
    "SMILES: ", "Predicted Value: ", "Predicted Value:",
)
# End of fixed values.

#: Type of an ordered list of examples.
SHOTS_TYPE = "array<struct<text:string,label:string>>"


def no_shots() -> Column:
    """An empty example list."""
    return F.array().cast(SHOTS_TYPE)


def _fill(pattern: str, values: dict[str, Column]) -> Column:
    """Concatenate a pattern with ``{name}`` places filled by Columns."""
    pieces, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def _prompt(wording: Wording, text, shots, values: dict[str, Column]) -> Column:
    shots = F.coalesce(as_column(shots), no_shots())
    lead = _fill(wording.opening + wording.answer_rule, values)
    query = F.concat(
        F.lit(wording.text_tag), as_column(text), F.lit("\n" + wording.ending)
    )
    examples = F.array_join(
        F.transform(
            shots,
            lambda s: F.concat(
                F.lit(wording.text_tag), s["text"],
                F.lit("\n" + wording.label_tag), s["label"], F.lit("\n\n"),
            ),
        ),
        "",
    )
    few_shot = F.concat(
        F.lit(wording.examples_header), examples, F.lit(wording.query_header)
    )
    body = F.when(F.size(shots) > 0, few_shot).otherwise(F.lit(wording.zero_shot_note))
    return F.concat(lead, body, query)


def classification_prompt(
    text, task, shots=None, wording: Wording = CLASSIFICATION
) -> Column:
    """Yes/No prompt for a (masked) text, with or without examples."""
    return _prompt(wording, text, shots, {"task": as_column(task)})


def regression_prompt(
    text, task, low, high, shots=None, wording: Wording = REGRESSION
) -> Column:
    """Number prompt that also states the range of known labels."""
    values = {
        "task": as_column(task),
        "low": decimal_text(low, 2),
        "high": decimal_text(high, 2),
    }
    return _prompt(wording, text, shots, values)
