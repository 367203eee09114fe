"""Byte-level pair merging with a segment tree over byte positions.

A piece keeps, for every byte position that still starts a token, the rank of
the pair of that token and the next one.  A segment tree over the positions has
the smallest rank, the leftmost of equal ones, at its root.  A merge changes the
leaves of the merged token, of the one it swallowed and of its left neighbour,
and each change climbs log(length) nodes.  Pieces of up to ``LANE`` bytes climb
side by side, one row of a numpy matrix each; a longer piece has a tree of its
own, so a run of a million letters costs n log n as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shotweave.llm.arrays import blocks, ragged, text_buffer
from shotweave.llm.pieces import PieceEncoder

#: Longest piece that is merged beside others.
LANE = 64
_NONE = np.int64(1) << 40


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: token bytes by id, and the rank of every mergeable pair."""

    tokens: list[bytes]
    slots: np.ndarray
    ranks: np.ndarray

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``_NONE`` where the pair is no token."""
        keys = (left.astype(np.int64) << 20) | right
        at = _slot(keys, len(self.slots))
        found = self.slots[at]
        miss = np.flatnonzero((found != keys) & (found != -1))
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            found = self.slots[at[miss]]
            miss = miss[(found != keys[miss]) & (found != -1)]
        return np.where(self.slots[at] == keys, self.ranks[at], _NONE)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(64 - size.bit_length() + 1)
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def load_ranks(path: str | None = None) -> Ranks:
    """Read a rank file: one base64 token and its id a line."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ids.values()) + 1)
    keys, ranks = [], []
    for token, rank in ids.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                keys.append((left << 20) | right)
                ranks.append(rank)
    size = 1 << (4 * len(keys)).bit_length()
    slots, values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    key, rank = np.array(keys, np.int64), np.array(ranks, np.int64)
    at = _slot(key, size)
    while len(key):
        _, first = np.unique(at, return_index=True)
        free = first[slots[at[first]] == -1]
        slots[at[free]], values[at[free]] = key[free], rank[free]
        rest = np.ones(len(key), bool)
        rest[free] = False
        key, rank, at = key[rest], rank[rest], (at[rest] + 1) & (size - 1)
    return Ranks(tokens, slots, values)


def _merge_lanes(ids: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merge pieces of the rows of a matrix; -1 where a byte starts no token."""
    n, leaves = ids.shape
    nxt = np.tile(np.arange(1, leaves + 1), (n, 1))
    nxt = np.where(nxt < lengths[:, None], nxt, leaves).ravel()
    prv = np.tile(np.arange(-1, leaves - 1), (n, 1)).ravel()
    tree = np.full((n, 2 * leaves), _NONE, np.int64)
    row, col = np.nonzero(np.arange(leaves - 1) < lengths[:, None] - 1)
    rank = ranks.of(ids[row, col], ids[row, col + 1])
    tree[row, leaves + col] = np.where(rank < _NONE, rank * leaves + col, _NONE)
    node = leaves
    while node > 1:
        half = node // 2
        tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
        node = half
    tree, ids = tree.ravel(), ids.ravel()
    rows = np.arange(n)
    while True:
        best = tree[rows * (2 * leaves) + 1]
        live = best < _NONE
        rows, best = rows[live], best[live]
        if not len(rows):
            return ids.reshape(n, leaves)
        at, base, top = best % leaves, rows * leaves, rows * (2 * leaves)
        merged = best // leaves
        gone = nxt[base + at]
        after = nxt[base + gone]
        before = prv[base + at]
        ids[base + at], ids[base + gone] = merged, -1
        nxt[base + at] = after
        right = after < leaves
        prv[(base + after)[right]] = at[right]
        left = before >= 0
        tree[top + leaves + gone] = _NONE
        value = np.full(len(rows), _NONE, np.int64)
        rank = ranks.of(merged[right], ids[(base + after)[right]])
        value[right] = np.where(rank < _NONE, rank * leaves + at[right], _NONE)
        tree[top + leaves + at] = value
        rank = ranks.of(ids[(base + before)[left]], merged[left])
        tree[(top + leaves + before)[left]] = np.where(rank < _NONE, rank * leaves + before[left], _NONE)
        for leaf, up in ((gone, top), (at, top), (before[left], top[left])):
            node = (leaf + leaves) >> 1
            while len(node) and node[0]:
                tree[up + node] = np.minimum(tree[up + 2 * node], tree[up + 2 * node + 1])
                node = node >> 1


def _merge_long(piece: bytes, single: np.ndarray, ranks: Ranks) -> list[int]:
    """One long piece: the same tree in lists, where scalar steps are quick."""
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    none = (int(_NONE), 0)
    start = single[np.frombuffer(piece, np.uint8)]
    pair = ranks.of(start[:-1], start[1:]).tolist()
    ids = start.tolist()
    tree = [none] * (2 * leaves)
    tree[leaves : leaves + n - 1] = [(rank, at) for at, rank in enumerate(pair)]
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    slots, values, mask = ranks.slots, ranks.ranks, len(ranks.slots) - 1
    shift = 64 - len(slots).bit_length() + 1
    known: dict[int, int] = {}

    def rank_of(left: int, right: int) -> int:
        key = (left << 20) | right
        if key not in known:
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> shift
            while slots[at] != key and slots[at] != -1:
                at = (at + 1) & mask
            known[key] = int(values[at]) if slots[at] == key else int(_NONE)
        return known[key]

    def put(leaf: int, value: tuple[int, int]) -> None:
        node = leaf + leaves
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1][0] < _NONE:
        merged, at = tree[1]
        gone = nxt[at]
        after, before = nxt[gone], prv[at]
        ids[at], ids[gone], nxt[at] = merged, -1, after
        put(gone, none)
        if after < n:
            prv[after] = at
            put(at, (rank_of(merged, ids[after]), at))
        else:
            put(at, none)
        if before >= 0:
            put(before, (rank_of(ids[before], merged), before))
    return [token for token in ids if token >= 0]


class SegmentTreeEncoder:
    """Ids of distinct pieces, whatever their length."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.single = np.zeros(256, np.int64)
        for rank, token in enumerate(ranks.tokens):
            if len(token) == 1:
                self.single[token[0]] = rank

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(lengths) - lengths
        counts = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        leaves, shorter = 2, 0
        while leaves <= LANE:
            rows = np.flatnonzero((lengths > shorter) & (lengths <= leaves))
            for part in np.array_split(rows, max(1, len(rows) * leaves // (1 << 20))):
                if not len(part):
                    continue
                ids = np.full((len(part), leaves), -1, np.int64)
                ids[np.arange(leaves) < lengths[part][:, None]] = self.single[raw[ragged(begins[part], lengths[part])]]
                merged = _merge_lanes(ids, lengths[part], self.ranks)
                kept = merged >= 0
                counts[part] = kept.sum(axis=1)
                found.append((part, merged[kept]))
            shorter, leaves = leaves, leaves * 2
        for i in np.flatnonzero(lengths > LANE):
            ids = np.array(_merge_long(pieces[i], self.single, self.ranks), np.int64)
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        out = np.zeros(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        for part, ids in found:
            out[ragged(starts[part], counts[part])] = ids
        return out, counts


class Decoder:
    """Bytes of id sequences."""

    def __init__(self, ranks: Ranks) -> None:
        self.lengths = np.fromiter(map(len, ranks.tokens), np.int64, len(ranks.tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(ranks.tokens), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all sequences, and n + 1 offsets into them."""
        lengths = self.lengths[ids]
        running = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=running[1:])
        return self.raw[ragged(self.starts[ids], lengths)], running[offsets]


@lru_cache(maxsize=1)
def _tools(key: str, shared) -> tuple[PieceEncoder, Decoder]:
    """One encoder with its cache for each worker and vocabulary."""
    ranks = shared.value
    return PieceEncoder(SegmentTreeEncoder(ranks)), Decoder(ranks)


def encode(df: DataFrame, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Add the token ids of a whole text as ARRAY<INT>; null and empty give [].

    Needs no shuffle.  Other columns pass unchanged; one that already has the name
    of the new one is replaced.
    """
    df = df.drop(ids) if ids in df.columns and ids != text else df
    shared, key = _shared(df, path)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(key, shared)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            for a, b in blocks(offsets):
                found, at = encoder(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str | None = None, data: str = "decoded") -> DataFrame:
    """Add the bytes of ARRAY<INT> ids as BINARY; null and [] give no bytes.

    A column that already has the name of the new one is replaced.
    """
    df = df.drop(data) if data in df.columns and data != ids else df
    shared, key = _shared(df, path)
    schema = T.StructType([*df.schema.fields, T.StructField(data, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(key, shared)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lengths = np.asarray(column.value_lengths().fill_null(0))
            at = np.append(0, np.cumsum(lengths))
            raw, ends = decoder(np.asarray(column.flatten()), at)
            found = [raw[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, data]
            )

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256: ids are hashed as
    little-endian unsigned 32-bit integers.  Null counts as empty; repeated rows
    give repeated results.  One pass in which ids never leave the worker.
    """
    shared, key = _shared(df, path)
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
         T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(key, shared)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                ids, at = encoder(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data, ends = decoder(ids, at)
                words = memoryview(ids.astype("<u4").tobytes())
                decoded = memoryview(data.tobytes())
                cut, end = at.tolist(), ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(words[4 * x : 4 * y]).hexdigest() for x, y in zip(cut, cut[1:])]),
                        pa.array([hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(end, end[1:])]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, schema)


def _shared(df: DataFrame, path: str | None):
    """The vocabulary, bounded by its file, once for each executor."""
    ranks = load_ranks(path)
    key = hashlib.sha256(b"\0".join(ranks.tokens)).hexdigest()
    return df.sparkSession.sparkContext.broadcast(ranks), key
