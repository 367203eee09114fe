"""Byte-pair training over words that stay on the cluster, many merges a round.

A round takes the best pairs, some hundreds, and cuts every word wherever two
neighbours are no such pair.  What is left are fragments, the same few in all
words, so the sum of their counts is a small table.  Merging one pair at a time on
that table gives exactly the merges of the whole corpus until the best pair
comes after the best one that was left out: every place of a chosen pair is in
a fragment, and a new pair across a cut occurs no more often than the pair that
was cut, and its new symbol puts it behind that pair where counts are equal.  Then
all words replace their fragments by what the merges left of them, and the next
round begins.  A merge that spells a token known before ends a round early,
because its pairs may be outside the fragments as well.

Words are packed in blobs of arrays; a round is two passes over them with numpy,
and two small aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.operators.bpe_local import learn_merges
from shotweave.storage import materialise

#: Pairs of the first round, and of any.
FIRST_PAIRS = 256
MOST_PAIRS = 1 << 14
#: Bytes of fragments that the driver merges in a round; it takes up to about 100 times that.
FRAGMENT_BYTES = 1 << 20
#: Symbols in a blob.
BLOB_SYMBOLS = 1 << 20

_STATE = "symbols binary, lengths binary, n binary, pairs array<bigint>, sums array<bigint>"


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(weights[order], begins) if len(keys) else weights


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows of a matrix, and the number of its distinct row for each row."""
    mixed = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, place, number = np.unique(mixed, return_index=True, return_inverse=True)
    if not np.array_equal(rows, rows[place][number]):  # two rows share a hash
        _, place, number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return place, number.ravel()


class Words:
    """Words of at least two symbols, side by side, and how often each occurs."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.symbols, self.lengths, self.counts = symbols, lengths, counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each neighbouring pair as one number, and which word it is in; none across words."""
        inside = np.ones(len(self.symbols), bool)
        inside[np.cumsum(self.lengths) - 1] = False
        at = np.flatnonzero(inside)
        return self.symbols[at].astype(np.int64) << 32 | self.symbols[at + 1], at

    def row(self) -> dict:
        keys, at = self.pairs()
        found, sums = _sums(keys, np.repeat(self.counts, self.lengths)[at])
        return {
            "symbols": self.symbols.astype(np.int32).tobytes(), "lengths": self.lengths.tobytes(), "n": self.counts.tobytes(),
            "pairs": found, "sums": sums,
        }

    def segments(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the stretches between cuts; a symbol alone is one as well."""
        keys, at = self.pairs()
        place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        begins = np.ones(len(self.symbols), bool)
        begins[at[frequent[place] == keys] + 1] = False
        starts = np.flatnonzero(begins)
        return starts, np.diff(np.append(starts, len(self.symbols)))

    def fragments(self, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from two: which segments, their distinct symbols, and the number of each."""
        order = np.argsort(lengths, kind="stable")
        order = order[np.searchsorted(lengths[order], 2) :]
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(some):
                rows = self.symbols[starts[some][:, None] + np.arange(lengths[some[0]])]
                place, number = _distinct(rows)
                yield some, rows[place], number

    def replaced(self, frequent: np.ndarray, results: dict[bytes, bytes]) -> Words:
        """The words after the merges of a round; those of one symbol are done."""
        starts, lengths = self.segments(frequent)
        source, begins, sizes = [self.symbols], starts.copy(), lengths.copy()
        at = len(self.symbols)
        for some, rows, number in self.fragments(starts, lengths):
            left = [np.frombuffer(results[row.tobytes()], np.int32) for row in rows]
            size = np.fromiter(map(len, left), np.int64, len(left))
            begins[some], sizes[some] = (at + np.cumsum(size) - size)[number], size[number]
            at += int(size.sum())
            source += left
        symbols = np.concatenate(source)[_ragged(begins, sizes)]
        word_starts = np.cumsum(self.lengths) - self.lengths
        new = np.add.reduceat(sizes, np.searchsorted(starts, word_starts)) if len(word_starts) else sizes
        long = new > 1
        return Words(symbols[np.repeat(long, new)], new[long], self.counts[long])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("symbols", pa.binary()), ("lengths", pa.binary()), ("n", pa.binary()), ("pairs", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds], names=[c for c, _ in kinds])


def _blobs(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of each row, one row at a time: a batch may be 64 MB."""
    parts = [batch.column(name) for name in ("symbols", "lengths", "n")]
    for i in range(batch.num_rows):
        yield Words(*(np.frombuffer(part[i].as_buffer(), t) for part, t in zip(parts, (np.int32, np.int64, np.int64))))


def _packed(counts: DataFrame, id_of_byte: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").cast(pa.large_binary())
            lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1])
            n = np.asarray(batch.column("n"))
            some = np.flatnonzero(lengths > 1)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(lengths[some]) // BLOB_SYMBOLS)) + 1):
                raw = np.frombuffer(b"".join(words.take(pa.array(part)).to_pylist()), np.uint8)
                if len(part):
                    yield _batch([Words(id_of_byte[raw], lengths[part], n[part].astype(np.int64)).row()])

    return counts.select(F.encode("word", "UTF-8").alias("word"), "n").mapInArrow(run, _STATE)


def _fragments(state: DataFrame, frequent: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _blobs(batch):
                starts, lengths = words.segments(frequent)
                weight = words.counts[np.searchsorted(np.cumsum(words.lengths), starts, "right")]
                for some, rows, number in words.fragments(starts, lengths):
                    sums = np.bincount(number, minlength=len(rows)) * 0
                    np.add.at(sums, number, weight[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(sums, pa.int64())], names=["fragment", "n"]
                    )

    found = state.select("symbols", "lengths", "n").mapInArrow(run, "fragment binary, n bigint")
    return found.groupBy("fragment").agg(F.sum("n").alias("n"))


def _merged(state: DataFrame, frequent: np.ndarray, results: dict[bytes, bytes]) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(results)  # bounded by FRAGMENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _blobs(batch):
                words = words.replaced(frequent, shared.value)
                if len(words.counts):
                    yield _batch([words.row()])

    return state.select("symbols", "lengths", "n").mapInArrow(run, _STATE)


def learn_in_rounds(
    counts: DataFrame, id_of_byte: np.ndarray, tokens: list[str], vocab_size: int, min_frequency: int
) -> list[tuple[str, str]]:
    """Merges of (word, n); ``tokens`` grows by what is learnt."""
    merges: list[tuple[str, str]] = []
    state = materialise(_packed(counts, id_of_byte), "words")
    most = FIRST_PAIRS
    while len(tokens) < vocab_size:
        summed = state.select(F.explode(F.arrays_zip("pairs", "sums")).alias("p")).groupBy("p.pairs").agg(F.sum("p.sums").alias("n"))
        top = summed.where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "pairs").limit(MOST_PAIRS + 1).collect()
        if not top:
            break
        while True:
            frequent = np.array(sorted(r["pairs"] for r in top[:most]), np.int64)
            # The best pair that is left out; None where there is none.
            beyond = (top[most]["n"], top[most]["pairs"]) if most < len(top) else None
            table = materialise(_fragments(state, frequent), "fragments")
            size = table.agg(F.sum(F.octet_length("fragment"))).first()[0]
            if size <= FRAGMENT_BYTES or len(frequent) == 1:
                break
            most = len(frequent) // 2
        found = table.toArrow().combine_chunks()
        fragments = found["fragment"].to_pylist()
        lengths = np.fromiter((len(f) // 4 for f in fragments), np.int64, len(fragments))
        learnt, left, sizes = learn_merges(
            np.frombuffer(b"".join(fragments), np.int32), np.cumsum(lengths) - lengths, np.asarray(found["n"]),
            tokens, vocab_size, min_frequency, beyond,
        )
        merges += learnt
        if len(tokens) >= vocab_size:
            break
        cut = np.split(left.astype(np.int32), np.cumsum(sizes)[:-1])
        results = {f: part.tobytes() for f, part in zip(fragments, cut, strict=True)}
        state = materialise(_merged(state, frequent, results), "words")
        if size * 4 < FRAGMENT_BYTES:
            most = min(2 * most, MOST_PAIRS)
    return merges
