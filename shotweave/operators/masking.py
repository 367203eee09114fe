"""Replace one token of a text by the mask token."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column, portable_hash

# Fixed values.
MASK = "[MASK]"
TOO_SHORT = "Too_Short_To_Mask"
NO_MASK_TOKEN = "Mask_Token_Not_Found"
TAG_PREFIX = "BPE_Token:_"
UNMASKED_BELOW = 3


def join_words(tokens) -> Column:
    """Detokeniser of blank-separated words."""
    return F.array_join(tokens, " ")


def join_pieces(tokens) -> Column:
    """Detokeniser of tokens that carry their own blanks."""
    return F.array_join(tokens, "")


def masked(
    text,
    tokens,
    *key,
    seed: int = 42,
    detokenise: Callable[[Column], Column] = join_pieces,
    has_mask: bool = True,
) -> Column:
    """STRUCT(masked, tag): the text with one token replaced.

    ``key`` identifies the draw: a row id, or a row id and the role of the
    text, so that a text is masked afresh wherever it is shown.
    """
    text, tokens = as_column(text), as_column(tokens)
    n = F.size(tokens)
    at = F.pmod(portable_hash(seed, *key), n).cast("int")
    changed = F.concat(
        F.slice(tokens, F.lit(1), at), F.array(F.lit(MASK)), F.slice(tokens, at + 2, n)
    )

    def unchanged(tag: str) -> Column:
        return F.struct(text.alias("masked"), F.lit(tag).alias("tag"))

    hidden = F.struct(
        detokenise(changed).alias("masked"),
        F.concat(F.lit(TAG_PREFIX), F.get(tokens, at)).alias("tag"),
    )
    short = F.coalesce(n, F.lit(0)) < UNMASKED_BELOW
    return F.when(short, unchanged(TOO_SHORT)).otherwise(
        hidden if has_mask else unchanged(NO_MASK_TOKEN)
    )


def mask_token(
    df: DataFrame, text: str, tokens: str, *key: str, masked_as: str = "masked",
    tag_as: str = "mask_tag", **options,
) -> DataFrame:
    """Add the masked text and the tag of the hidden token."""
    drawn = masked(F.col(text), F.col(tokens), *[F.col(k) for k in key], **options)
    named = df.withColumn("__masked", drawn)
    return named.withColumns(
        {masked_as: F.col("__masked.masked"), tag_as: F.col("__masked.tag")}
    ).drop("__masked")
