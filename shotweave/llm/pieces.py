"""The split of texts that comes before byte-level merges, and a piece cache.

``piece_starts`` finds, for a whole block of texts at once, where the matches of
the public pattern begin::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A piece occurs very often, so a block encodes its distinct pieces only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from shotweave.llm.arrays import mix, ragged, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

#: Distinct pieces a worker remembers; beyond that it starts again.
REMEMBERED = 300_000


@lru_cache(maxsize=None)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for begin in range(0, 0x110000, 0x800):
        if begin == 0xD800:  # surrogates
            continue
        text = "".join(map(chr, range(begin, begin + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for match in regex.finditer(pattern, text):
                table[begin + match.start() : begin + match.end()] = kind
    return table


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8 texts, and the offsets counted in them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending positions at which the pieces of all texts start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last space of a run that a text goes on after is a piece of its own, or,
    # if it is a blank, the beginning of what follows.
    run_end = np.zeros(n, bool)
    run_end[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= run_end
    follows = np.flatnonzero(run_end & (points == 32)) + 1
    start[follows] = False
    # An apostrophe that begins a piece may be a short ending.
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < text_end)
        long = (
            ((one == ord("r")) & (two == ord("e")))
            | ((one == ord("v")) & (two == ord("e")))
            | ((one == ord("l")) & (two == ord("l")))
        ) & (quote + 2 < text_end)
        start[quote[short | long] + 1] = False
        for ends in (quote[short] + 2, quote[long] + 3):
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids of whole texts; ``encode`` gets distinct pieces only.

    ``encode`` takes a list of byte strings and returns the ids of all of them in
    one array and the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = raw.tobytes()
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, counts = self.encode(pieces)
        begins = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.starts = np.concatenate([self.starts, begins])[order]
        self.counts = np.concatenate([self.counts, counts])[order]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and n + 1 offsets into them."""
        points, at = code_points(raw, offsets)
        starts = piece_starts(points, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(mix(points), starts, ends)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            new = index[~known]
            if len(points) == len(raw):
                a, b = starts[new], ends[new]
            else:
                byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                a, b = byte_at[starts[new]], byte_at[ends[new]]
            self._learn(raw, keys[~known], a, b)
            place = np.searchsorted(self.keys, keys)
        entry = place[inverse]
        counts = self.counts[entry]
        ids = self.ids[ragged(self.starts[entry], counts)]
        running = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=running[1:])
        return ids, running[np.searchsorted(starts, at)]
