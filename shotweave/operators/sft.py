"""Token arrays for supervised fine-tuning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.text import strip
from shotweave.operators.prefix import global_ordinal
from shotweave.storage import materialise

# Fixed values.
IGNORE = -100
CONCAT_LENGTH = 1024
PADDED_LENGTH = 512
PROMPT_PATTERN = ("Instruction:\n", "\n\nInput:\n", "\n\nOutput:\n")

#: Turns a text into ids: ``lambda text: bpe_ids(text, tok)``.
Encoder = Callable[[Column], Column]


def _repeat(value, n) -> Column:
    return F.array_repeat(F.lit(value), n.cast("int"))


def sft_concat(df: DataFrame, encode: Encoder, max_length: int = CONCAT_LENGTH) -> DataFrame:
    """Add ``input_ids`` and ``labels``: prompt, then target, at most ``max_length``.

    The prompt is cut first; the target gets what is left less one.  Labels
    ignore the prompt.
    """
    prompt = F.concat(strip(F.col("instruction")), F.lit("\n"), strip(F.col("input")))
    encoded = df.withColumns({"__p": encode(prompt), "__t": encode(strip(F.col("output")))})
    cut = encoded.withColumn("__p", F.slice("__p", 1, max_length))
    room = F.greatest(F.lit(max_length - 1) - F.size("__p"), F.lit(0))
    cut = cut.withColumn("__t", F.slice("__t", F.lit(1), room))
    return cut.withColumns(
        {
            "input_ids": F.concat("__p", "__t"),
            "labels": F.concat(_repeat(IGNORE, F.size("__p")), F.col("__t")),
        }
    ).drop("__p", "__t")


def sft_padded(
    df: DataFrame, encode: Encoder, pad_id: int, eos: str | Column,
    max_length: int = PADDED_LENGTH,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels`` of fixed length.

    ``eos`` is the end token's text, or an array of its ids.  Labels ignore
    the prompt; padding on the right keeps its id as label.
    """
    before, between, after = PROMPT_PATTERN
    prompt = F.concat(
        F.lit(before), F.col("instruction"), F.lit(between), F.col("input"), F.lit(after)
    )
    if isinstance(eos, str):
        full = encode(F.concat(prompt, F.col("output"), F.lit(eos)))
    else:
        full = F.concat(encode(F.concat(prompt, F.col("output"))), eos)
    encoded = df.withColumns({"__full": full, "__prompt": F.size(encode(prompt))})
    cut = encoded.withColumn("__full", F.slice("__full", 1, max_length))
    used, missing = F.size("__full"), F.lit(max_length) - F.size("__full")
    ids = F.concat(F.col("__full"), _repeat(pad_id, missing))
    hidden = F.least(F.col("__prompt"), F.lit(max_length))
    return cut.withColumns(
        {
            "input_ids": ids,
            "attention_mask": F.concat(_repeat(1, used), _repeat(0, missing)),
            "labels": F.concat(
                _repeat(IGNORE, hidden), F.slice(ids, hidden + 1, F.lit(max_length))
            ),
        }
    ).drop("__full", "__prompt")


def pad_batches(
    df: DataFrame, batch_size: int, pad_id: int, order: str = "row_id",
    label_pad: int | None = None, columns: tuple[str, str] = ("input_ids", "labels"),
) -> DataFrame:
    """Number the batches and pad ids and labels to the longest row of each.

    Labels are padded with the pad id as well, unless ``label_pad`` says
    otherwise.  Only ids and lengths are numbered, not the arrays.
    """
    ids, labels = columns
    numbered = materialise(
        global_ordinal(df.select(order, F.size(ids).alias("__n")), [F.col(order)], "__at"), "batches"
    )
    batch = Window.partitionBy("batch_id")
    sized = numbered.withColumn("batch_id", F.expr(f"__at div {batch_size}")).withColumn(
        "__width", F.max("__n").over(batch)
    )
    joined = df.join(sized.select(order, "batch_id", "__width"), order)
    label_value = pad_id if label_pad is None else label_pad

    def widen(column: str, value: int) -> Column:
        return F.concat(F.col(column), _repeat(value, F.col("__width") - F.size(column)))

    return joined.withColumns(
        {ids: widen(ids, pad_id), labels: widen(labels, label_value)}
    ).drop("__width")
