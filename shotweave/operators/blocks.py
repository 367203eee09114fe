"""Comparison of fingerprints with a block of others, by matrix products.

Counts of common bits are whole numbers, so three of them share the digits of
one float where none can pass eight bits, else two, and one product gives them
all.  Rows of more bits are compared a half or a quarter of the columns at a
time, so that eight bits are enough.  Read as bytes, a product is compared with
the least count that a query asks for; only what reaches it is looked at more
closely.

A cheaper product decides most pairs: columns are added up two or four at a
time on the side of the queries and joined by OR on the side of the block.  The
counts are then at least the true ones, so what stays below the least count is
out.  What does not is counted bit by bit.  How many columns go together is
tried out on a few queries: it changes the speed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Similarities of whole blocks held at once.
CELLS = 4_000_000
#: Queries and floats of a block that one product takes.
QUERIES, FLOATS = 1024, 2048
#: Fingerprints held by one float32, and the bits of it that each one's count gets.
#: A float32 holds whole numbers below 2**24 exactly, whatever the order of summing.
FORMS = ((3, 8), (2, 12))
#: Numbers of columns that go together, and of parts that columns are taken in.
FOLDS, PARTS = (4, 2), (1, 2, 4)
#: Queries that try a fold out, and the share of pairs that may be left by it.
TRIED, LEFT = 64, 0.03
#: Rows that a first floor is taken from, and pairs counted bit by bit at once.
SAMPLE, COUNTED = 1536, 2**14
#: Bit counts that share one least count differ by this factor at most.
NEAR = 1.05


class Block:
    """Fingerprints that many queries are compared with; :func:`best` wants them in order of bits."""

    def __init__(self, fps: np.ndarray, bits: np.ndarray, rows: np.ndarray):
        self.fps, self.bits, self.rows = fps, bits, rows
        self.words = np.ascontiguousarray(fps).view(np.uint64)
        self._forms: dict[tuple[int, int], np.ndarray] = {}
        self._folds: dict[int, np.ndarray] = {}

    def beside(self, start: int, stop: int) -> slice:
        """A range of rows and those that share a float with its ends."""
        most = max(per for per, _ in FORMS)
        return slice(max(0, start - most), stop + most)

    def most(self, start: int, stop: int) -> int:
        return int(self.bits[self.beside(start, stop)].max())

    def columns(self, fold: int) -> np.ndarray:
        """Columns that go together, one row per place: common ones with rare ones."""
        if fold not in self._folds:
            seen = np.unpackbits(self.fps[:: max(1, len(self.fps) // 2048)], axis=1).sum(axis=0)
            order = np.argsort(seen, kind="stable").reshape(fold, -1)
            order[1::2] = order[1::2, ::-1]
            self._folds[fold] = order
        return self._folds[fold]

    def _form(self, per: int, width: int, fold: int) -> np.ndarray:
        """Rows 3 g, 3 g + 1 and 3 g + 2 (or 2 g and 2 g + 1) as one row of floats."""
        if (per, fold) not in self._forms:
            groups = -(-len(self.fps) // per)
            form = np.zeros((groups, 8 * self.fps.shape[1] // fold), dtype=np.float32)
            for part in range(per):
                held = self.fps[part::per]
                for start in range(0, len(held), 1024):
                    dense = np.unpackbits(held[start : start + 1024], axis=1)
                    if fold > 1:
                        dense = np.bitwise_or.reduce([dense[:, c] for c in self.columns(fold)])
                    form[start : start + len(dense)] += dense * np.float32(2 ** (width * part))
            self._forms[per, fold] = form
        return self._forms[per, fold]

    def products(
        self, dense: np.ndarray, per: int, width: int, start: int, fold: int = 1, parts: int = 1
    ) -> np.ndarray:
        """Counts with the rows from ``start`` (a multiple of ``per``) on, ``FLOATS * per`` of them.

        Row ``per * g + i`` from there is in column ``lanes * g + i``: there are 4
        lanes where ``per`` is 3, else 2.
        """
        form = self._form(per, width, fold)[start // per : start // per + FLOATS]
        if parts > 1:
            total = np.zeros((len(dense), 4 * len(form)), dtype=np.uint16)
            for part in range(parts):
                columns = slice(part * form.shape[1] // parts, (part + 1) * form.shape[1] // parts)
                total += (dense[:, columns] @ form[:, columns].T).astype(np.int32).view(np.uint8)
            return total
        found = (dense @ form.T).astype(np.int32)
        if per == 3:
            return found.view(np.uint8)
        counts = np.empty((*found.shape, 2), dtype=np.uint16)
        np.bitwise_and(found, 2**width - 1, out=counts[:, :, 0], casting="unsafe")
        np.right_shift(found, width, out=counts[:, :, 1], casting="unsafe")
        return counts.reshape(len(found), -1)

    def shared(self, fps: np.ndarray, most: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Common bits of every query with the rows of a range; no query has more than ``most``."""
        stop = len(self.fps) if stop is None else stop
        per, width = form_for(most, self.most(start, stop))
        dense = np.unpackbits(fps, axis=1).astype(np.float32)
        counts = np.empty((len(fps), stop - start), dtype=np.float32)
        step = per * FLOATS
        for first in range(start // per * per, stop, step):
            rows = np.arange(max(first, start), min(first + step, stop))
            counts[:, rows - start] = self.products(dense, per, width, first)[:, _lane(rows - first, per)]
        return counts


def form_for(*most: int) -> tuple[int, int]:
    return next(form for form in FORMS if min(most) < 2 ** form[1])


def _in_parts(words: np.ndarray, parts: int) -> int:
    """Most bits of a row in one of so many parts of the columns."""
    return int(np.bitwise_count(words).reshape(len(words), parts, -1).sum(axis=2).max())


def _lane(row: np.ndarray | int, per: int):
    """Column of a row in the counts of :meth:`Block.products`."""
    return row // per * (4 if per == 3 else 2) + row % per


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


class Queries:
    """Queries in order of bits, with what their k-th neighbour reaches at least."""

    def __init__(self, fps: np.ndarray, bits: np.ndarray, rows: np.ndarray, floor: np.ndarray):
        self.fps, self.bits, self.rows, self.floor = fps, bits, rows, floor

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, places) -> Queries:
        return Queries(self.fps[places], self.bits[places], self.rows[places], self.floor[places])

    def least(self, bits: int) -> np.ndarray:
        """The least number of common bits with rows of at least so many.

        s / (a + b - s) >= f where s >= f / (1 + f) * (a + b), widened a little
        against rounding.
        """
        share = self.floor / (1 + self.floor)
        return np.maximum(np.ceil(share * (self.bits + bits) - 1e-6), 1)


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _first(queries: Queries, block: Block, k: int, hits: Hits) -> pa.RecordBatch:
    """The best k of each query among (query, row of the block, common bits)."""
    at, row, common = hits[0], hits[1], hits[2].astype(np.float64)
    value = common / (queries.bits[at] + block.bits[row] - common)
    order = np.lexsort((block.rows[row], -value, at))
    at, row, value = at[order], row[order], value[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return pa.RecordBatch.from_arrays(
        [pa.array(queries.rows[at[keep]]), pa.array(block.rows[row[keep]]), pa.array(value[keep])],
        names=["query", "candidate", "similarity"],
    )


def _similarities(queries: Queries, block: Block, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    shared = block.shared(queries.fps, int(queries.bits.max()), start, stop)
    sims = np.add(queries.bits[:, None], block.bits[None, start:stop], dtype=np.float32)
    sims -= shared
    np.divide(shared, sims, out=sims)
    return shared, sims


def _below(values: np.ndarray) -> np.ndarray:
    """One step down, lest a value was rounded up; rounding keeps the order."""
    return np.nextafter(values.astype(np.float32), np.float32(-1))


def _whole(queries: Queries, block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """All similarities with the block, for queries that little is known of."""
    step = max(1, CELLS // len(block.rows))
    for start in range(0, len(queries), step):
        part = queries.part(slice(start, start + step))
        shared, sims = _similarities(part, block, 0, len(block.rows))
        limit = _below(part.floor)[:, None]
        hits = sims >= limit
        if len(block.rows) > k and np.count_nonzero(hits) > 4 * k * len(part):
            kth = np.partition(sims, len(block.rows) - k, axis=1)[:, len(block.rows) - k]
            hits = sims >= np.maximum(limit, kth[:, None])
        at, row = np.nonzero(hits)
        yield _first(part, block, k, (at, row, shared[at, row]))


def _floors(queries: Queries, block: Block, k: int) -> np.ndarray:
    """What the k-th best of some rows with about as many bits reaches."""
    middle = int(np.searchsorted(block.bits, np.median(queries.bits)))
    start = max(0, min(middle - SAMPLE // 2, len(block.rows) - SAMPLE))
    _, sims = _similarities(queries, block, start, start + SAMPLE)
    kth = np.partition(sims, SAMPLE - k, axis=1)[:, SAMPLE - k]
    return np.maximum(_below(kth).astype(np.float64), 0.0)


def _near(bits: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bits are about the same."""
    while start < stop:
        end = min(int(np.searchsorted(bits, bits[start] * NEAR, side="right")), stop)
        yield start, end
        start = end


def _reached(
    queries: Queries, dense: np.ndarray, block: Block, start: int, stop: int,
    form: tuple[int, int], fold: int = 1, parts: int = 1,
) -> Hits | None:
    """(query, row, count) of what reaches the least count of its query; None if that is too much."""
    per, width = form
    counts = block.products(dense, per, width, start // per * per, fold, parts)
    first = start // per * per
    reach = np.zeros(counts.shape, dtype=bool)
    for low, high in _near(block.bits, start, stop):
        least = np.minimum(queries.least(block.bits[low]), np.iinfo(counts.dtype).max).astype(counts.dtype)
        place = slice(_lane(low - first, per), _lane(high - 1 - first, per) + 1)
        np.greater_equal(counts[:, place], least[:, None], out=reach[:, place])
    if np.count_nonzero(reach) > CELLS // 4:
        return None
    found = np.flatnonzero(reach)
    at, lane = np.divmod(found, counts.shape[1])
    lanes = 4 if per == 3 else 2
    return at, first + lane // lanes * per + lane % lanes, counts.ravel()[found]


def _counted(queries: Queries, block: Block, hits: Hits) -> Hits:
    """The same with true counts, without what does not reach the least count by them."""
    words = np.ascontiguousarray(queries.fps).view(np.uint64)
    common = np.empty(len(hits[0]), dtype=np.int64)
    for start in range(0, len(common), COUNTED):
        at, row = (side[start : start + COUNTED] for side in hits[:2])
        both = np.bitwise_count(words[at] & block.words[row])
        common[start : start + COUNTED] = both.sum(axis=1, dtype=np.int64)
    share = queries.floor / (1 + queries.floor)
    keep = common >= share[hits[0]] * (queries.bits[hits[0]] + block.bits[hits[1]]) - 1e-6
    return hits[0][keep], hits[1][keep], common[keep]


def _folded(queries: Queries, block: Block, fold: int) -> np.ndarray:
    dense = np.unpackbits(queries.fps, axis=1)
    if fold > 1:
        dense = sum(dense[:, places] for places in block.columns(fold))
    return dense.astype(np.float32)


def _fold(queries: Queries, block: Block, start: int, stop: int) -> int:
    """How many columns can go together for these queries."""
    tried = queries.part(slice(None, None, max(1, len(queries) // TRIED)))
    # A slice from the middle of the range stands for it.
    step = FORMS[0][0] * FLOATS
    low = start + max(0, (stop - start - step) // 2)
    high = min(low + step - FORMS[0][0], stop)
    chosen = 1
    for fold in reversed(FOLDS):
        # No count can be above all bits of the query, or fold times those of the row.
        if min(int(queries.bits.max()), fold * block.most(start, stop)) >= 2 ** FORMS[0][1]:
            break
        found = _reached(tried, _folded(tried, block, fold), block, low, high, FORMS[0], fold)
        if found is None or len(found[0]) > LEFT * len(tried) * (high - low):
            break
        chosen = fold
    return chosen


def _parts(queries: Queries, block: Block, start: int, stop: int) -> int:
    """Parts of the columns in which no count passes eight bits; 0 if that takes too many."""
    few, many = 2 ** FORMS[0][1], int(min(queries.bits.max(), block.most(start, stop)))
    if many < few:
        return 1
    sides = [np.ascontiguousarray(queries.fps).view(np.uint64), block.words[block.beside(start, stop)]]
    return next((n for n in PARTS[1:] if min(_in_parts(side, n) for side in sides) < few), 0)


def _range(queries: Queries, block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of the block that reach the floor of their query, which is above 0."""
    # min(a, b) / max(a, b) >= floor
    fewest = np.ceil((queries.bits * queries.floor).min() - 1e-6)
    most = np.floor((queries.bits / queries.floor).max() + 1e-6)
    start = int(np.searchsorted(block.bits, fewest, side="left"))
    stop = int(np.searchsorted(block.bits, most, side="right"))
    if start == stop:
        return
    fold = _fold(queries, block, start, stop)
    parts = 1 if fold > 1 else _parts(queries, block, start, stop)
    form = FORMS[0] if parts else FORMS[1]
    dense = _folded(queries, block, fold)
    step = form[0] * FLOATS
    found, held = [], 0
    for first in range(start // form[0] * form[0], stop, step):
        hits = _reached(queries, dense, block, max(first, start), min(first + step, stop), form, fold, parts)
        if hits is not None and fold > 1:
            hits = _counted(queries, block, hits)
        held += CELLS if hits is None else len(hits[0])
        if held >= CELLS:
            yield from _whole(queries, block, k)
            return
        found.append(hits)
    yield _first(queries, block, k, tuple(np.concatenate(side) for side in zip(*found)))


def best(queries: Queries, block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of the block for every query, at least those that reach its floor."""
    queries = queries.part(np.argsort(queries.bits, kind="stable"))
    # Queries of few bits first: they are compared three rows at a time.
    cuts = [0, int(np.searchsorted(queries.bits, 2 ** FORMS[0][1])), len(queries)]
    for low, high in zip(cuts, cuts[1:]):
        for start in range(low, high, QUERIES):
            part = queries.part(slice(start, min(start + QUERIES, high)))
            unknown = part.floor <= 0
            if unknown.any() and len(block.rows) >= 4 * SAMPLE and k <= SAMPLE // 4:
                part.floor = np.maximum(part.floor, _floors(part, block, k))
                unknown = part.floor <= 0
            if unknown.any():
                yield from _whole(part.part(unknown), block, k)
            if not unknown.all():
                yield from _range(part.part(~unknown), block, k)
