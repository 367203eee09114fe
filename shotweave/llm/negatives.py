"""Hard negatives by exact integer scores from subset-sum tables.

Components are small integers, so a candidate is a few bit planes: byte g of
plane j has bit j of eight components.  For a few anchors at a time, and for each
group of eight dimensions, a table has the sum of the anchors' components over
each of the 256 subsets.  A plane then costs one table row per byte, and the
planes are put together by shifts: the Four Russians' way to multiply.

Candidates lie in cells and anchors in blocks, both of bounded size.  Every block
meets every cell in a task of its own and leaves a few best rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.arrays import columns, from_columns, ragged
from shotweave.storage import materialise

#: Candidates in a cell, and anchors in a block, at most.
CELL = 1 << 16
LEAST_CELL = 1 << 12
BLOCK = 1 << 13
#: Anchors that share tables, and candidates scored at once.
TABLED = 64
CHUNK = 1024
#: Components beyond this are refused; scores must fit 64 bits as well.
LARGEST = 1 << 31


# --- one task's work -------------------------------------------------------------


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Floors of scaled components; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    scaled = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    wide = -(-int(lengths.max(initial=0)) // 8) * 8
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), ragged(np.zeros(len(lengths), np.int64), lengths)] = scaled
    return out


def pack_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes in two's complement: planes by groups of eight by rows; the last plane is the sign."""
    n, wide = values.shape
    span = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    planes = np.empty((span.bit_length() + 1, wide // 8, n), np.uint8)
    for j in range(len(planes)):
        bits = ((values >> j) & 1).astype(np.uint8).reshape(n, wide // 8, 8)
        planes[j] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return planes


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Groups by 256 subsets by anchors, in the smallest type that holds a whole plane's sum."""
    k, wide = anchors.shape
    most = wide * int(np.abs(anchors).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    tables = np.zeros((wide // 8, 256, k), kind)
    grouped = anchors.T.reshape(wide // 8, 8, k)
    for t in range(8):
        tables[:, 1 << t : 2 << t] = tables[:, : 1 << t] + grouped[:, t : t + 1].astype(kind)
    return tables


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products, anchors by candidates."""
    groups = min(anchors.shape[1] // 8, planes.shape[1])
    tables, n, k = subset_sums(anchors[:, : 8 * groups]), planes.shape[2], len(anchors)
    most = (8 * groups * int(np.abs(anchors).max(initial=0))) << (len(planes) - 1)
    if most >= 1 << 63:
        raise ValueError("scores are beyond 64 bits")
    out = np.zeros((k, n), np.int32 if most < 1 << 31 else np.int64)
    if not groups:
        return out
    row = np.empty((min(n, CHUNK), k), tables.dtype)
    for a in range(0, n, CHUNK):
        part = planes[:, :, a : a + CHUNK]
        size = part.shape[2]
        total = np.zeros((size, k), out.dtype)
        for j in range(len(part) - 1, -1, -1):
            plane = tables[0].take(part[j, 0], axis=0)
            for g in range(1, groups):
                plane += tables[g].take(part[j, g], axis=0, out=row[:size], mode="clip")
            total <<= 1
            total += plane
            if j == len(part) - 1:
                np.negative(total, out=total)
        out[:, a : a + size] = total.T
    return out


class Cell:
    """Candidates by label, then id, and their bit planes."""

    @staticmethod
    def blob(ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> bytes:
        by = np.lexsort((ids, labels))
        planes = pack_planes(values[by])
        return columns(ids[by], labels[by], np.array(planes.shape), planes.ravel())

    def __init__(self, blob: bytes) -> None:
        self.ids, self.labels, shape, planes = from_columns(blob)
        self.planes = planes.reshape(shape)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


class Anchors:
    """Anchors by label, their components and, later, their positives."""

    @staticmethod
    def blob(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, *more: np.ndarray) -> bytes:
        by = np.lexsort((ids, labels))
        return columns(ids[by], labels[by], np.array(values.shape), values[by].ravel(), *more)

    def __init__(self, blob: bytes) -> None:
        self.ids, self.labels, shape, values, *self.more = from_columns(blob)
        self.values = values.reshape(shape)

    def with_positives(self, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray) -> bytes:
        by = np.argsort(anchor, kind="stable")
        return columns(
            self.ids, self.labels, np.array(self.values.shape), self.values.ravel(), anchor[by], positive[by], score[by]
        )

    def shared_label(self) -> Iterator[tuple[int, slice]]:
        """Stretches of anchors that have a label in common and get tables together."""
        begin = 0
        while begin < len(self.ids):
            end = int(np.searchsorted(self.labels, self.labels[begin], "right"))
            for a in range(begin, end, TABLED):
                yield int(self.labels[begin]), slice(a, min(a + TABLED, end))
            begin = end


def merge_anchors(blobs: list[bytes]) -> bytes:
    """One block of several; shorter vectors end in zeros."""
    parts = [Anchors(blob) for blob in blobs]
    wide = max(part.values.shape[1] for part in parts)
    values = np.concatenate([np.pad(part.values, ((0, 0), (0, wide - part.values.shape[1]))) for part in parts])
    return Anchors.blob(np.concatenate([p.ids for p in parts]), np.concatenate([p.labels for p in parts]), values)


def _best(ids: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, equal ones by id; ``ids`` ascend."""
    if len(found) > 4 * most:
        least = np.partition(found, len(found) - most)[len(found) - most]
        over = np.flatnonzero(found > least)
        ties = np.flatnonzero(found == least)[: most - len(over)]
        places = np.concatenate([over, ties])
    else:
        places = np.arange(len(found))
    return places[np.lexsort((ids[places], -found[places]))][:most]


def best_positives(anchors: Anchors, cell: Cell, most: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, score): the best other rows of the same label in a cell."""
    out = [(np.zeros(0, np.int64),) * 3]
    for label, some in anchors.shared_label():
        rows = cell.of_label(label)
        ids = cell.ids[rows]
        if not len(ids):
            continue
        found = scores(anchors.values[some], cell.planes[:, :, rows])
        for anchor, score in zip(anchors.ids[some], found, strict=True):
            places = _best(ids, score, most + 1)
            places = places[ids[places] != anchor][:most]
            out.append((np.full(len(places), anchor), ids[places], score[places].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_negatives(anchors: Anchors, cell: Cell, most: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, positive score, negative, negative score): for each positive
    the best rows of other labels whose score lies in its window."""
    anchor_of, positive, positive_score = anchors.more
    out = [(np.zeros(0, np.int64),) * 5]
    least, top = -((-low * positive_score) // 100), (high * positive_score) // 100
    for label, some in anchors.shared_label():
        same = cell.of_label(label)
        found = scores(anchors.values[some], cell.planes)
        for anchor, score in zip(anchors.ids[some], found, strict=True):
            mine = range(*np.searchsorted(anchor_of, [anchor, anchor + 1]).tolist())
            if not mine:
                continue
            inside = (score >= least[mine[0] : mine[-1] + 1].min()) & (score <= top[mine[0] : mine[-1] + 1].max())
            inside[same] = False
            near = np.flatnonzero(inside)
            near = near[np.lexsort((cell.ids[near], -score[near]))]
            falling = -score[near].astype(np.int64)
            for k in mine:
                a, b = np.searchsorted(falling, -top[k]), np.searchsorted(falling, -least[k], "right")
                places = near[a : min(b, a + most)]
                one = np.ones(len(places), np.int64)
                out.append((anchor * one, positive[k] * one, positive_score[k] * one, cell.ids[places], score[places].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- Spark ---------------------------------------------------------------------

_NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _table(arrays: tuple[np.ndarray, ...], schema: str) -> pa.Table:
    names = [field.split(" ")[0] for field in schema.split(", ")]
    return pa.table([pa.array(x, pa.int64()) for x in arrays], names=names)


def _cells(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows (id, label, vector, is_anchor) as cells; each has the anchors among its rows as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def cell(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (np.asarray(table[c]) for c in ("id", "label"))
            values, anchor = _matrix(table["vector"], scale), np.asarray(table["is_anchor"])
            chosen = Anchors.blob(ids[anchor], labels[anchor], values[anchor].astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([int(anchor.sum())]), pa.array([Cell.blob(ids, labels, values)], pa.binary()),
                 pa.array([chosen], pa.binary())],
                names=["cell", "n_anchors", "candidates", "anchors"],
            )

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                held.append(batch.slice(a, size))
                if sum(x.num_rows for x in held) >= size:
                    table = pa.Table.from_batches(held)
                    yield cell(table.slice(0, size))
                    number += 1
                    held = table.slice(size).to_batches()
        if sum(x.num_rows for x in held):
            yield cell(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "cell bigint, n_anchors bigint, candidates binary, anchors binary")


def hard_negatives(
    df: DataFrame, vec_id: str, label: str, vector: str, anchors: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its best positives, the best negatives in its window.

    Scores are exact inner products of floor(scale * x).  Rows with a null label or
    vector, or with a null or non-finite component, take no part, nor does a null
    id.  Rows with one id count as one, the smallest by label, then vector.
    ``anchors`` tells from the columns of ``df`` which rows are anchors.  Higher scores
    come first, equal ones by id.  An anchor's positives are its best other rows of
    the same label; a negative has another label and
    low * positive_score <= 100 * score <= high * positive_score.  Vectors of
    different lengths are compared as far as both go; an empty one scores 0.  A
    component beyond 2^31, or scores that may exceed 64 bits, are an error.  Empty
    tables, and anchors without positives or negatives, give no rows.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.  Blocks of at most 8,192 anchors (and one cell's more) meet cells
    of at most 65,536 rows, once for positives and once for negatives; only a few
    rows per anchor leave a task.  Nothing is broadcast.
    """
    spark = df.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    numbers = df.select(
        df[vec_id].cast("bigint").alias("id"), df[label].cast("bigint").alias("label"),
        df[vector].cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = numbers.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("row")).select("id", "row.*")
    n = df.count()
    share = min(max(n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), LEAST_CELL), CELL)
    # Small partitions are taken together, so that a cell is full whatever their number.
    cells = materialise(_cells(one.coalesce(max(1, -(-n // share))), scale, share), "cells")
    # One row per cell, so one task can hold them all.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    numbered = materialise(
        cells.select(
            "cell", "n_anchors", (F.row_number().over(Window.orderBy("cell")) - 1).alias("number"),
            F.floor(F.coalesce(F.sum("n_anchors").over(before), F.lit(0)) / BLOCK).cast("int").alias("block"),
        ),
        "numbers",
    )
    size = numbered.where("n_anchors > 0").agg(F.max("block")).first()[0]
    if size is None:
        return spark.createDataFrame([], out)
    n_blocks, n_cells = size + 1, numbered.count()

    def merged(part: pa.Table) -> pa.Table:
        return pa.table({"block": part["block"][:1], "anchors": pa.array([merge_anchors(part["anchors"].to_pylist())], pa.binary())})

    blocks = materialise(
        cells.select("cell", "anchors").join(numbered.where("n_anchors > 0"), "cell").select("block", "anchors")
        .groupBy("block").applyInArrow(merged, "block int, anchors binary"),
        "anchors",
    )
    candidates = cells.select("cell", "candidates").join(numbered, "cell").select(
        "number", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "candidates"
    )

    def met(anchor_blocks: DataFrame, work, schema: str) -> DataFrame:
        """Every block beside every cell, each pair in one call."""

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _table((np.zeros(0, np.int64),) * (schema.count(",") + 1), schema)
            return work(left["block"][0].as_py(), Anchors(left["anchors"][0].as_py()), Cell(right["candidates"][0].as_py()))

        everywhere = anchor_blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("number"), "block", "anchors")
        return everywhere.groupBy("number", "block").cogroup(candidates.groupBy("number", "block")).applyInArrow(pair, schema)

    found = "block bigint, anchor_id bigint, positive_id bigint, positive_score bigint"

    def find_positives(block: int, some: Anchors, cell: Cell) -> pa.Table:
        best = best_positives(some, cell, positives)
        return _table((np.full(len(best[0]), block), *best), found)

    order = Window.partitionBy("block", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = met(blocks, find_positives, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    chosen = materialise(chosen.drop("rank"), "positives")

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        triples = [np.asarray(right[c]).astype(np.int64) for c in ("anchor_id", "positive_id", "positive_score")]
        both = [Anchors(blob).with_positives(*triples) for blob in left["anchors"].to_pylist()]
        return pa.table({"block": left["block"], "anchors": pa.array(both, pa.binary())})

    keyed = chosen.withColumn("block", F.col("block").cast("int"))
    wanted = materialise(
        blocks.groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(attach, "block int, anchors binary"), "wanted"
    )

    def find_negatives(block: int, some: Anchors, cell: Cell) -> pa.Table:
        return _table(best_negatives(some, cell, negatives, low, high), _NEGATIVES)

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    mined = met(wanted, find_negatives, _NEGATIVES).withColumn("rank", F.row_number().over(order))
    return mined.where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
