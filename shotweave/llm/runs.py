"""Periodic runs of words, by branching tandem repeats on an enhanced suffix array.

The suffixes of every document are sorted by prefix doubling, and the ranks of
all rounds are kept: two substrings of 2^k words are equal where their ranks of
round k are, which gives common extensions in both directions.  Every LCP interval
of depth d (the places of one repeated string of d words) asks, for the suffixes i
of all its children but the largest, whether i + d or i - d is in the interval as
well; that is one look at the inverse suffix array.  If the word after breaks the
period, the square that begins there is the last of its run, and rotating it to
the left as far as words agree gives the whole run.  Intervals are pairs of
bounds in arrays; there are no tree nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shotweave.llm.arrays import blocks, byte_values, ragged, span_hashes, text_buffer

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Suffixes of children looked at together.
LOOKS = 1 << 21
#: Rounds of pointer jumping before the few bounds left are searched one level at a time.
JUMPS = 16


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words ``[^\\x20\\x09-\\x0D]+`` begin and end, and the first word of each text (n + 1)."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal exactly where the bytes are."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = span_hashes(byte_values()[raw], starts, ends)
    _, index, number = np.unique(hashes, return_index=True, return_inverse=True)
    twin, lengths = index[number], ends - starts
    same = np.array_equal(lengths, lengths[twin]) and np.array_equal(
        raw[ragged(starts, lengths)], raw[ragged(starts[twin], lengths)]
    )
    if same:
        return number
    # Two words share a 64-bit hash: number them by their bytes.
    data, known = raw.tobytes(), {}
    return np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)


def sorted_by(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by two small keys; in one machine word where they fit."""
    n = len(high)
    at, below = max(n - 1, 1).bit_length(), int(low.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + below + at > 62:
        return np.lexsort((low, high))
    packed = ((high << below | low) << at) | np.arange(n)
    packed.sort()
    return packed & ((1 << at) - 1)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the place where the group of each entry begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


@dataclass
class SuffixArray:
    """Suffixes of many sequences in order, none compared across a border.

    ``levels[k]`` has the rank of every position by its first 2^k words, as far as
    its sequence goes, and -1 behind the last; the last level is the inverse array.
    """

    order: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, numbers: np.ndarray, firsts: np.ndarray) -> SuffixArray:
        n, lengths = len(numbers), np.diff(firsts)
        end = np.repeat(firsts[1:], lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = sorted_by(owner, numbers)
        rank = np.full(n + 1, -1, np.int32)
        rank[order] = group_starts(owner[order], numbers[order])
        levels, step = [rank], 1
        size = np.bincount(rank[:n], minlength=n)
        open_ = np.flatnonzero(size[rank[:n]] > 1)
        while len(open_):
            group = rank[open_].astype(np.int64)
            after = open_ + step
            second = np.where(after < end[open_], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
            by = sorted_by(group, second)
            open_, group, second = open_[by], group[by], second[by]
            refined = group_starts(group, second)
            rank = rank.copy()
            rank[open_] = group + refined - group_starts(group)
            levels.append(rank)
            size = np.bincount(refined, minlength=len(open_))
            open_ = open_[size[refined] > 1]
            step *= 2
        order = np.empty(n, np.int64)
        order[rank[:n]] = np.arange(n)
        return cls(order, levels)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from positions a and b (different ones) on."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            length += (self.levels[k][a + length] == self.levels[k][b + length]).astype(np.int64) << k
        return length

    def common_suffix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before positions a < b."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            x, y = a - length - (1 << k), b - length - (1 << k)
            length += ((x >= 0) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])).astype(np.int64) << k
        return length

    def depths(self) -> np.ndarray:
        """The LCP of neighbours: entry p is between p - 1 and p; 0 at both ends."""
        depth = np.zeros(len(self.order) + 1, np.int64)
        a, b = self.order[:-1], self.order[1:]
        close = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        depth[close + 1] = self.common_prefix(a[close], b[close])
        return depth


def _nearest_smaller(depth: np.ndarray, points: np.ndarray, way: int) -> np.ndarray:
    """The nearest entry before (-1) or after (1) each point that is smaller than its own."""
    near = np.arange(len(depth)) + way
    left = points
    for _ in range(JUMPS):
        left = left[depth[near[left]] >= depth[left]]
        if not len(left):
            return near[points]
        near[left] = near[near[left]]
    # Long ramps: descend over minima of 2^k entries.
    left = left[depth[near[left]] >= depth[left]]
    minima, size = [depth], 1
    while 2 * size <= len(depth):
        minima.append(np.minimum(minima[-1][:-size], minima[-1][size:]))
        size *= 2
    at, value = left + (way > 0), depth[left]
    for k in range(len(minima) - 1, -1, -1):
        begin = at if way > 0 else at - (1 << k)
        inside = (begin >= 0) & (begin < len(minima[k]))
        skip = inside & (minima[k][np.where(inside, begin, 0)] >= value)
        at = at + way * (skip.astype(np.int64) << k)
    near[left] = at if way > 0 else at - 1
    return near[points]


def _small_children(depth: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For every suffix in a child that is not the largest of its LCP interval:
    its place in the suffix array, and the interval's bounds and depth, in chunks."""
    points = np.flatnonzero(depth > 0)
    if not len(points):
        return
    low, high = _nearest_smaller(depth, points, -1), _nearest_smaller(depth, points, 1)
    # An interval is known by its lower bound and depth; its borders come in order.
    by = sorted_by(low, depth[points])
    points, low, high = points[by], low[by], high[by]
    of = depth[points]
    begin = group_starts(low, of)
    first = begin == np.arange(len(points))
    heads = np.flatnonzero(first)
    after = np.append(points[1:], 0)
    after = np.where(np.append(~first[1:], False), after, high)
    starts = np.concatenate([low[heads], points])
    sizes = np.concatenate([points[heads] - low[heads], after - points])
    interval = np.concatenate([heads, begin])
    largest = np.zeros(len(points), np.int64)
    largest[heads] = np.maximum(sizes[: len(heads)], np.maximum.reduceat(sizes[len(heads) :], heads))
    # One child of the largest size is left out, whichever comes first here.
    full = np.flatnonzero(sizes == largest[interval])
    _, once = np.unique(interval[full], return_index=True)
    keep = np.ones(len(sizes), bool)
    keep[full[once]] = False
    starts, sizes, interval = starts[keep], sizes[keep], interval[keep]
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + LOOKS, "right")))
        at, of_interval = ragged(starts[a:b], sizes[a:b]), np.repeat(interval[a:b], sizes[a:b])
        yield at, low[of_interval], high[of_interval], of[of_interval]
        a = b


def find_runs(numbers: np.ndarray, firsts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs of at least ``least`` words and ``times`` periods.

    ``numbers`` are the words of many texts side by side, ``firsts`` where each
    text begins, and the end.  Runs come by start, then period.
    """
    nothing = np.zeros(0, np.int64)
    if not len(numbers):
        return nothing, nothing, nothing
    array = SuffixArray.of(numbers, firsts)
    rank, words = array.levels[-1], array.levels[0]
    n, begins, periods = len(numbers), [nothing], [nothing]
    for at, low, high, depth in _small_children(array.depths()):
        place = array.order[at]
        for begin in (place, place - depth):
            other = np.where(begin == place, place + depth, begin)
            inside = (other >= 0) & (other <= n)
            found = rank[np.where(inside, other, n)]
            tandem = np.flatnonzero(inside & (found >= low) & (found < high))
            i, d = begin[tandem], depth[tandem]
            broken = words[i + d] != words[i + 2 * d]
            begins.append(i[broken])
            periods.append(d[broken])
    i, d = np.concatenate(begins), np.concatenate(periods)
    start, end = i - array.common_suffix(i, i + d), i + 2 * d
    long = (end - start >= least) & (end - start >= times * d)
    start, end, d = start[long], end[long], d[long]
    # The same stretch with a multiple of its period is no run of its own.
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    own = group_starts(start, end) == np.arange(len(start))
    start, end, d = start[own], end[own], d[own]
    by = np.lexsort((d, start))
    return start[by], end[by], d[by]


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """Words of n texts, joined by one space; ``text`` tells whose each word is."""
    spaced = np.zeros(len(text), np.int64)
    spaced[:-1] = text[1:] == text[:-1]
    lengths = ends - starts + spaced
    data = np.append(raw, np.uint8(32))[ragged(starts, lengths)]
    running = np.cumsum(lengths)
    data[(running - 1)[spaced > 0]] = 32
    at = np.append(0, running)[np.searchsorted(text, np.arange(n + 1))]
    return pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(data)]
    ).cast(pa.string())


def collapse_runs(
    df: DataFrame, text: str, least: int = 24, times: int = 3, runs: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """Add the periodic runs of a text's words, and the text with each run cut to one period.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest
    period q, at least ``least`` words and ``times`` * q long, that cannot be made
    longer.  ``runs`` is an array of (start, length, period) by start, then period;
    ``collapsed`` has all words that are in no run behind its first q words, joined
    by single spaces.  Null and blank texts have no runs and collapse to ''.  Equal
    rows give equal results, an empty table an empty one.  Other columns pass
    unchanged; one with the name of a new column is replaced.

    Needs no shuffle.  Texts are taken together up to 2 MB; a longer one is taken
    alone, in some 150 bytes of memory a word.
    """
    if least < 1 or times < 2:
        raise ValueError("a run has at least one word and two periods")
    df = df.drop(*[c for c in (runs, collapsed) if c != text])
    schema = T.StructType([
        *[f for f in df.schema.fields if f.name not in (runs, collapsed)],
        T.StructField(runs, T.DataType.fromDDL(RUN_TYPE)), T.StructField(collapsed, T.StringType()),
    ])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def block(part: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        starts, ends, firsts = word_spans(raw, offsets)
        start, end, period = find_runs(word_numbers(raw, starts, ends), firsts, least, times)
        owner = np.searchsorted(firsts, start, "right") - 1
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
        of_word = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        found = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(firsts))), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(start - firsts[owner]), pa.array(end - start), pa.array(period)], fields=list(kind.value_type)
            ),
        )
        short = _joined(raw, starts[kept], ends[kept], of_word[kept], len(firsts) - 1)
        names = [name for name in part.schema.names if name not in (runs, collapsed)]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in names], found, short], names=[*names, runs, collapsed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            for a, b in blocks(offsets):
                yield block(batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    return df.mapInArrow(run, schema)
