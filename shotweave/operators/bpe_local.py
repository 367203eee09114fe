"""Byte-pair training over a table of bounded size, one merge at a time."""

from __future__ import annotations

import heapq

import numpy as np


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Distinct keys, the sum of weights and the places of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(weights[order], begins)
    return ordered[begins].tolist(), sums.tolist(), np.split(order, begins[1:])


def learn_merges(
    symbols: np.ndarray, begins: np.ndarray, counts: np.ndarray, tokens: list[str], vocab_size: int, min_frequency: int,
    beyond: tuple[int, int] | None = None,
) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """Merges of words given as ids side by side; ``tokens`` grows by what is learnt.

    Words are a linked line of symbols.  A merge looks at the places of its pair
    only and corrects the counts of the pairs beside them.  Ends when the
    vocabulary is full, when no pair reaches ``min_frequency`` or comes before
    ``beyond`` (count and pair), or after a merge that spells a token known before.  Returns the merges, what is left of the
    words and how many symbols each has left.
    """
    size = len(symbols)
    lengths = np.diff(np.append(begins, size))
    sym = symbols.astype(np.int64)
    weight = np.repeat(counts.astype(np.int64), lengths)
    after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    full = lengths > 0
    after[(begins + lengths - 1)[full]] = -1
    before[begins[full]] = -1
    known = {token: i for i, token in enumerate(tokens)}
    merges: list[tuple[str, str]] = []

    def pairs(at: np.ndarray) -> np.ndarray:
        return sym[at] << 32 | sym[after[at]]

    count: dict[int, int] = {}
    where: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def add(at: np.ndarray) -> None:
        if not len(at):
            return
        for key, n, places in zip(*_sums(pairs(at), weight[at])):
            count[key] = count.get(key, 0) + n
            where.setdefault(key, []).append(at[places])
            heapq.heappush(heap, (-count[key], key))

    add(np.flatnonzero(after >= 0).astype(np.int32))
    while heap and len(tokens) < vocab_size:
        stale, key = heapq.heappop(heap)
        n = count.get(key, 0)
        if n != -stale:
            # A larger count has an entry of its own.
            if 0 < n < -stale:
                heapq.heappush(heap, (-n, key))
            continue
        if n < min_frequency or (beyond and (-n, key) >= (-beyond[0], beyond[1])):
            break
        left, right = key >> 32, key & 0xFFFFFFFF
        at = np.unique(np.concatenate(where.pop(key)))
        at = at[(sym[at] == left) & (after[at] >= 0)]
        at = at[sym[after[at]] == right]
        if left == right:
            # In a run of one symbol every second pair is merged, from the left.
            number = np.arange(len(at))
            begin = np.concatenate([[True], after[at[:-1]] != at[1:]])
            at = at[(number - np.maximum.accumulate(np.where(begin, number, 0))) % 2 == 0]
        gone = after[at]
        touched = np.unique(np.concatenate([before[at], at, gone]))
        touched = touched[touched >= 0]
        touched = touched[after[touched] >= 0]
        for other, lost, _ in zip(*_sums(pairs(touched), weight[touched])):
            count[other] -= lost
        token = tokens[left] + tokens[right]
        is_new = token not in known
        if is_new:
            known[token] = len(tokens)
            tokens.append(token)
        merges.append((tokens[left], tokens[right]))
        follows = after[gone]
        sym[at], sym[gone], after[at] = known[token], -1, follows
        before[follows[follows >= 0]] = at[follows >= 0]
        after[gone] = -1
        touched = np.unique(np.concatenate([before[at], at]))
        touched = touched[touched >= 0]
        touched = touched[after[touched] >= 0]
        add(touched)
        if not is_new:
            break
    alive = sym >= 0
    left_over = np.diff(np.append(0, np.cumsum(alive))[np.append(begins, size)])
    return merges, sym[alive], left_over
