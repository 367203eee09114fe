"""Order MinHash fingerprints: likeness that falls with edit distance.

A text's k-mers are numbered by occurrence, so repeats count.  Each of
``FUNCTIONS`` hash functions selects the ``CHOSEN`` smallest numbered k-mers,
puts them back in the order of the text and hashes that tuple.  Texts that
differ by few edits, and keep their order, share most tuples.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import mix, window_hashes
from shotweave.llm.groups import GROUP_BYTES
from shotweave.operators.prefix import global_prefix_sum

#: Code points of a k-mer, smallest ones taken, tuples of a fingerprint.
WIDTH, CHOSEN, FUNCTIONS = 8, 2, 32

_FACTORS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
#: The low bits of a k-mer's hash, which make room for its place when sorted.
_PLACE = np.uint64((1 << 24) - 1)


def kmers(text: str) -> np.ndarray:
    """Hashes of all k-mers of code points; a short text is one."""
    points = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    return window_hashes(points, min(WIDTH, len(points))) if len(points) else points


def _numbered(head: np.ndarray, tail: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hashes with occurrence numbers of head + tail, then those of ``other`` as in head + other."""
    joined = np.concatenate([head, tail, other])
    n = len(joined)
    if n <= int(_PLACE):
        ordered = np.sort((joined & ~_PLACE) | np.arange(n, dtype=np.uint64))
        at, value = (ordered & _PLACE).astype(np.int64), ordered & ~_PLACE
    else:
        at = np.argsort(joined & ~_PLACE, kind="stable")
        value = joined[at] & ~_PLACE
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    first = np.repeat(start, np.diff(np.append(start, n)))
    number = np.arange(n) - first
    in_tail = (at >= len(head)) & (at < len(head) + len(tail))
    before = np.cumsum(in_tail) - in_tail
    number = np.where(at >= len(head) + len(tail), number - (before - before[first]), number)
    out = np.empty(n, np.uint64)
    out[at] = mix(value + number.astype(np.uint64) * _NEXT)
    return out


def _smallest(values: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``CHOSEN`` smallest of each function and their positions."""
    if not len(values):
        return np.zeros((FUNCTIONS, 0), np.uint64), np.zeros((FUNCTIONS, 0), np.int64)
    found, places, rows = [], [], np.arange(FUNCTIONS)
    step = 1 << 15
    for a in range(0, len(values), step):
        hashed = values[a : a + step] * _FACTORS[:, None]
        for _ in range(min(CHOSEN, hashed.shape[1])):
            least = hashed.argmin(axis=1)
            found.append(hashed[rows, least])
            places.append(least + (a + shift))
            hashed[rows, least] = ~np.uint64(0)
    return np.stack(found, axis=1), np.stack(places, axis=1)


def _tuples(parts: list[tuple[np.ndarray, np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    """One 32-bit hash per function of the chosen k-mers in text order."""
    found, places = (np.concatenate(p, axis=1) for p in zip(*parts))
    if not found.shape[1]:
        return np.zeros(FUNCTIONS, np.uint32)
    order = np.argsort(found, axis=1, kind="stable")[:, :CHOSEN]
    chosen = np.sort(np.take_along_axis(places, order, axis=1), axis=1)
    out = np.full(FUNCTIONS, chosen.shape[1], np.uint64)
    for column in chosen.T:
        out = mix(out * _NEXT + hashes[column])
    return np.maximum((out >> np.uint64(32)).astype(np.uint32), 1)


def fingerprint(text: str) -> np.ndarray:
    """The tuple hashes of one text; all zero for an empty one."""
    return fingerprints(text, 0, "")[0]


def fingerprints(text: str, cut: int, put: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Tuples of a text, and of it with its last ``cut`` code points replaced by ``put``."""
    edited = text[: len(text) - cut] + put
    all_of, all_edited = kmers(text), kmers(edited)
    shared = max(len(text) - cut - WIDTH + 1, 0)
    if min(len(text), len(edited)) < WIDTH:
        shared = 0
    head, tail, other = all_of[:shared], all_of[shared:], all_edited[shared:]
    if edited == text:
        other = other[:0]
    if not len(head) + len(tail) + len(other):
        zero = np.zeros(FUNCTIONS, np.uint32)
        return zero, zero, edited
    numbered = _numbered(head, tail, other)
    n = len(all_of)
    first = _smallest(numbered[:shared], 0)
    own = _tuples([first, _smallest(numbered[shared:n], shared)], all_of)
    if edited == text:
        return own, own, edited
    return own, _tuples([first, _smallest(numbered[n:], shared)], all_edited), edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit_fingerprints(df: DataFrame, doc_id: str, text: str, share: int = 4) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how near they are.

    The edited form replaces the last floor(n / ``share``) code points by the
    first as many, or all, of the next row in order of id; after the last comes
    the first.  Columns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.

    Rows are laid out in blocks of consecutive ids and bounded bytes; the first
    row of a block also goes to the block before it, so one shuffle moves every
    text once.  A null text is empty; a null id comes first; rows with the same
    id are ordered by a hash of their text, and repeated rows follow each other.
    An empty table gives no rows; other columns are not looked at.
    """
    ids = F.coalesce(df[doc_id].cast("bigint"), F.lit(-(2**63)))
    rows = df.select(
        df[doc_id].alias("doc_id"), ids.alias("id"), F.coalesce(df[text], F.lit("")).alias("text")
    )
    sizes = rows.select("id", (F.octet_length("text") + 1).cast("bigint").alias("size"))
    line = global_prefix_sum(sizes, [F.asc("id")], {"size": "start"})
    firsts = line.groupBy(F.floor(F.col("start") / GROUP_BYTES)).agg(F.min("id").alias("id"))
    # One id per block.
    bounds = np.array(sorted({row["id"] for row in firsts.collect()}), np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def blocks_of(ids):
        block = np.searchsorted(bounds, ids.to_numpy(), "right") - 1
        first = bounds[block] == ids.to_numpy()
        import pandas as pd

        before = (block - 1) % len(bounds)
        return pd.Series([[b, ~p] if f else [b] for b, p, f in zip(block.tolist(), before.tolist(), first.tolist())])

    # A negative number is the block before, which needs the row as a successor only.
    sent = rows.withColumn("block", F.explode(blocks_of("id"))).select(
        "doc_id", "id", "text", (F.col("block") < 0).alias("extra"),
        F.when(F.col("block") < 0, -1 - F.col("block")).otherwise(F.col("block")).alias("block"),
        F.xxhash64("text").alias("copy"),
    )
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def compute(table: pa.Table) -> pa.Table:
        extra = table["extra"].to_numpy()
        order = np.lexsort((table["copy"].to_numpy(), table["id"].to_numpy(), extra))
        own = int((~extra).sum())
        order = order[: own + 1]
        texts = table["text"].take(pa.array(order)).to_pylist()
        out: list[list] = [[] for _ in range(6)]
        prints = []
        for i in range(own):
            now, following = texts[i], texts[i + 1]
            cut = len(now) // share
            mine, edited, changed = fingerprints(now, cut, following[:cut])
            prints.append(mine)
            for column, value in zip(out, (
                len(now), hashlib.sha256(changed.encode()).hexdigest(), mine.astype(">u4").tobytes().hex(),
                edited.astype(">u4").tobytes().hex(), likeness(mine, edited), 0.0,
            )):
                column.append(value)
        prints.append(fingerprint(texts[own]) if own else None)
        out[5] = [likeness(a, b) for a, b in zip(prints, prints[1:])]
        ids = table["doc_id"].take(pa.array(order[:own]))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([ids, *[pa.array(c, k) for c, k in zip(out, kinds)]], names=schema.names)

    return sent.groupBy("block").applyInArrow(compute, schema)
