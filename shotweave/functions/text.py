"""Text expressions: keys, labels, numbers and surface variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column

#: Plain decimal notation, as accepted for labels.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(col) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(as_column(col), r"(?U)^\s+|\s+$", "")


def canonical_key(text) -> Column:
    """Default identity of a text: lower case, single blanks, trimmed.

    Empty results are NULL, which the cleaning step reads as "cannot be
    parsed".  Domain users pass their own expression instead.
    """
    folded = F.regexp_replace(F.lower(as_column(text)), r"\s+", " ")
    return F.nullif(F.trim(folded), F.lit(""))


def words(text) -> Column:
    """Words of the canonical key; NULL for an empty text."""
    return F.split(canonical_key(text), " ", -1)


def lossless_words(text) -> Column:
    """Words with the blanks before them; put together they are the text again.

    Blanks at the end stay with the last word.  Text without words has none.
    """
    return F.regexp_extract_all(as_column(text), F.lit(r"\s*\S+(\s+$)?"), F.lit(0))


def to_number(col) -> Column:
    """DOUBLE for plain decimal notation, else NULL.

    ``try_cast`` alone accepts Java suffixes such as ``1f``; values that
    overflow to infinity also become NULL.
    """
    text = F.trim(as_column(col).cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def label_text(label) -> Column:
    """``Yes`` for a label of exactly one, ``No`` for everything else."""
    return F.when(as_column(label) == 1, F.lit("Yes")).otherwise(F.lit("No"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, so that expressions stay small."""
    return F.transform(F.array(value), then)[0]


def _scaled(value: Column, digits: int, then: Callable[[Column], Column]) -> Column:
    """``then`` of |value| times 10^digits as a whole number, ties of the exact value to even.

    The value is cut in two halves whose products with the power of ten are
    exact, so a tie is one in the binary value and not in its shortest decimal.
    """
    power = F.lit(float(10**digits))

    def cut(size: Column) -> Column:
        return _bound(size * F.lit(134217729.0), lambda wide: halves(size, wide - (wide - size)))

    def halves(size: Column, high: Column) -> Column:
        return _bound(
            F.struct((high * power).alias("high"), ((size - high) * power).alias("low")),
            lambda x: _bound(F.floor(x["high"]), lambda whole: add(whole, x["high"] - whole, x["low"])),
        )

    def add(whole: Column, one: Column, two: Column) -> Column:
        return _bound(
            F.struct(whole.alias("whole"), one.alias("one"), two.alias("two")),
            lambda x: _bound(x["one"] + x["two"], lambda rest: settle(x["whole"], x["one"], x["two"], rest)),
        )

    def settle(whole: Column, one: Column, two: Column, rest: Column) -> Column:
        part = rest - one
        lost = (one - (rest - part)) + (two - part)  # what adding the two has rounded away
        return _bound(
            F.struct((whole + F.floor(rest)).alias("base"), (rest - F.floor(rest)).alias("left"), lost.alias("lost")),
            lambda x: _bound(
                x["base"] + (
                    (x["left"] > 0.5) | ((x["left"] == 0.5) & ((x["lost"] > 0) | ((x["lost"] == 0) & (x["base"] % 2 == 1))))
                ).cast("bigint"),
                then,
            ),
        )

    return _bound(F.abs(value), cut)


#: Beyond this a double has no decimals to round.
_NO_DECIMALS = 1e11


def decimal_text(value, digits: int) -> Column:
    """A number with so many decimals, as ``%.nf`` of its exact binary value."""
    power = F.lit(10**digits)

    def shown(number: Column) -> Column:
        text = _scaled(number, digits, lambda scaled: F.concat(
            F.when(number < 0, F.lit("-")).otherwise(F.lit("")), F.floor(scaled / power).cast("string"), F.lit("."),
            F.lpad((scaled % power).cast("string"), digits, "0"),
        ))
        return F.when(F.abs(number) < _NO_DECIMALS, text).otherwise(F.format_string(f"%.{digits}f", number))

    return _bound(as_column(value).cast("double"), shown)


def rounded(value, digits: int) -> Column:
    """A number rounded to so many decimals, ties of the exact value to even."""

    def near(number: Column) -> Column:
        sign = F.when(number < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        size = _scaled(number, digits, lambda scaled: sign * scaled / F.lit(float(10**digits)))
        return F.when(F.abs(number) < _NO_DECIMALS, size).otherwise(number)

    return _bound(as_column(value).cast("double"), near)


def format_label(value) -> Column:
    """A numeric label with four decimals and no thousands separator."""
    return decimal_text(value, 4)


def retrieval_text(original, masked, rule: str = "or") -> Column:
    """Text used to look up neighbours.

    ``or`` skips a NULL or empty original; ``default`` skips only a missing
    (NULL) one.
    """
    original, masked = as_column(original), as_column(masked)
    if rule == "or":
        return F.coalesce(F.nullif(original, F.lit("")), masked)
    if rule == "default":
        return F.coalesce(original, masked)
    raise ValueError(f"unknown rule {rule!r}: use 'or' or 'default'")


def rotations(text, limit: int = 10) -> Column:
    """Surface variants of a text: its word list rotated by 1, 2, ... places.

    At most ``limit`` different strings, none equal to the (blank-normalised)
    source.
    """
    tokens = F.split(F.trim(F.regexp_replace(as_column(text), r"\s+", " ")), " ", -1)
    n = F.size(tokens)
    turned = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), F.least(n - 1, F.lit(limit)))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.array_join(
            F.concat(F.slice(tokens, i + 1, n), F.slice(tokens, F.lit(1), i)), " "
        ),
    )
    source = F.array_join(tokens, " ")
    return F.filter(F.array_distinct(turned), lambda v: v != source)
