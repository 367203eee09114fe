"""Hashed bit-set fingerprints and Tanimoto similarity."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from shotweave.functions.hashing import as_column, portable_hash
from shotweave.functions.text import canonical_key, words

#: Fixed value: width of the bit vector.
N_BITS = 2048


def shingles(text, size: int = 1, unit: str = "word") -> Column:
    """Distinct runs of ``size`` neighbouring words or characters."""
    if unit == "word":
        tokens, glue = words(text), " "
    elif unit == "char":
        tokens, glue = F.split(canonical_key(text), ""), ""
    else:
        raise ValueError(f"unknown unit {unit!r}: use 'word' or 'char'")
    if size == 1:
        return F.array_distinct(tokens)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), glue))
    return F.when(tokens.isNotNull(), F.array_distinct(runs))


def fingerprint(text, bits: int = N_BITS, size: int = 1, unit: str = "word") -> Column:
    """Sorted distinct bit positions of a text; NULL for an empty text."""
    hashed = F.transform(
        shingles(text, size, unit),
        lambda s: F.pmod(portable_hash(s), F.lit(bits)).cast("int"),
    )
    return F.sort_array(F.array_distinct(hashed))


def tanimoto(a, b) -> Column:
    """Shared bits over all bits of two bit-position arrays."""
    a, b = as_column(a), as_column(b)
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def pack_bits(bits, width: int = N_BITS) -> Column:
    """Bit positions as a fixed-width BINARY, for vectorised comparison."""

    @pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        present = column.notna()
        arrays = column[present].to_list()
        dense = np.zeros((len(arrays), width), dtype=np.uint8)
        if arrays:
            rows = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
            dense[rows, np.concatenate(arrays).astype(np.int64)] = 1
        packed = pd.Series([None] * len(column), index=column.index, dtype=object)
        packed[present] = [row.tobytes() for row in np.packbits(dense, axis=1)]
        return packed

    return pack(as_column(bits))


def packed_fingerprint(
    text, bits: int = N_BITS, size: int = 1, unit: str = "word", width: int = N_BITS
) -> Column:
    """:func:`pack_bits` of :func:`fingerprint`; a word is hashed once per batch of texts."""
    # Single words are cut out of the key where they are hashed, as ``words`` does.
    whole = unit == "word" and size == 1

    @arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        if whole:
            column = pc.split_pattern(column, " ")
        words = column.flatten().dictionary_encode()
        # The same as portable_hash, which joins nothing to a single part.
        hashes = [md5(w or b"").digest()[:4] for w in words.dictionary.cast(pa.binary()).to_pylist()]
        places = np.frombuffer(b"".join(hashes), dtype=">u4").astype(np.int64) % bits
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        dense = np.zeros((len(column), width), dtype=np.uint8)
        if len(places):
            dense[np.repeat(np.arange(len(column)), lengths), places[words.indices.to_numpy()]] = 1
        rows = np.packbits(dense, axis=1)
        empty = column.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if none else row.tobytes() for none, row in zip(empty, rows)], pa.binary())

    return pack(canonical_key(text) if whole else shingles(text, size, unit))


def packed_size(packed, width: int = N_BITS) -> Column:
    """Number of set bits of a packed fingerprint."""
    digits = F.hex(as_column(packed))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(width // 32 - 1)),
        lambda i: F.bit_count(
            F.conv(F.substring(digits, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
        ),
    )
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)
