"""Exact k nearest neighbours by Tanimoto similarity.

The search runs over distinct fingerprints only: all rows with the same
fingerprint are equally similar to everything, so a group of copies, however
large, is searched once, and only its first k rows can ever be neighbours.

Fingerprints are laid out by their number of bits, because two sets of a and b
bits have at most min(a, b) / max(a, b) in common.  A first pass compares every
query with one block of similar size and so finds a similarity that its k-th
neighbour has at least.  The second pass visits only the blocks whose bound
reaches it.  Both passes are one shuffle on the block number; each task holds
one block and streams the queries past it (:mod:`shotweave.operators.blocks`).

A table of many tasks is searched in the same few jobs: every task has blocks of
its own, numbered through over all tasks, and its queries visit only those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.functions.fingerprints import N_BITS, fingerprint, packed_fingerprint, packed_size
from shotweave.operators.blocks import CELLS, Block as _Block, Queries, best, unpack
from shotweave.operators.joins import attach_by_key, attach_counted
from shotweave.operators.prefix import global_prefix_sum
from shotweave.operators.split import task_key
from shotweave.storage import materialise

#: Index rows per block, and queries per copy of a block.
BLOCK_ROWS = 32768
MIN_BLOCK_ROWS = 512
QUERIES_PER_COPY = 65_536
#: Query-by-block similarities worked out by one task.
CELLS_PER_TASK = 2**31

NEIGHBOURS_TYPE = "array<struct<row_id:bigint,similarity:double>>"


def with_fingerprint(df: DataFrame, text: str, name: str = "fp", **options) -> DataFrame:
    """Add the bit positions of a text; NULL where it has none."""
    return df.withColumn(name, fingerprint(F.col(text), **options))


def build_index(df: DataFrame, text: str, keep_all: bool = False, **options) -> DataFrame:
    """Rows that have a fingerprint, written once with it as BINARY ``packed``.

    ``keep_all`` also keeps the rows without one; searches pass over them.
    """
    # Filtered only after writing: before it, the optimizer would move the
    # fingerprint into the filter and compute it twice.
    packed = df.withColumn("packed", packed_fingerprint(F.col(text), **options))
    written = materialise(packed, "index")
    return written if keep_all else written.where(F.col("packed").isNotNull())


@dataclass(frozen=True)
class _Layout:
    """Blocks of the index in order of bit count.

    ``first[n]`` and ``last[n]`` are the blocks that hold n-bit fingerprints;
    a bit count with many fingerprints has several.
    """

    first: list[int]
    last: list[int]
    blocks: int


def _lay_out(histogram: dict[int, int], block_rows: int) -> _Layout:
    """Cut the bit counts 0..N_BITS into blocks of about ``block_rows`` rows."""
    first, last, block, filled = [], [], 0, 0
    for n in range(N_BITS + 1):
        rows = histogram.get(n, 0)
        if filled and filled + rows > block_rows:
            block, filled = block + 1, 0
        first.append(block)
        extra = max(0, -(-rows // block_rows) - 1)
        block += extra
        last.append(block)
        filled = block_rows if extra else filled + rows
    return _Layout(first, last, block + 1)


def _distinct(df: DataFrame, row_id: str, *task: str) -> DataFrame:
    """One row per fingerprint (of a task) with its number of rows and its first row."""
    counted = df.groupBy("packed", *task).agg(
        F.count("*").alias("size"), F.min(row_id).alias("first_row")
    )
    return materialise(counted.withColumn("bits", packed_size(F.col("packed"))), "distinct")


def _best_in_block(k: int):
    """Compare streamed queries with the block that precedes them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, fps, bits, rows = None, [], [], []
        block = None
        for batch in batches:
            places = batch.column("place").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(places) | np.diff(asks.astype(np.int64))) + 1
            for piece_start, piece_end in zip([0, *cuts], [*cuts, len(places)]):
                if piece_start == piece_end:
                    continue
                piece = batch.slice(piece_start, piece_end - piece_start)
                if places[piece_start] != place:
                    place, block = places[piece_start], None
                    fps, bits, rows = [], [], []
                held = unpack(piece.column("packed"))
                own_bits = piece.column("bits").to_numpy().astype(np.int64)
                own_rows = piece.column("first_row").to_numpy()
                if not asks[piece_start]:
                    fps.append(held)
                    bits.append(own_bits)
                    rows.append(own_rows)
                    block = None
                elif fps:
                    if block is None:
                        offered = [np.concatenate(x) for x in (fps, bits, rows)]
                        order = np.argsort(offered[1], kind="stable")
                        block = _Block(*(x[order] for x in offered))
                    yield from best(Queries(held, own_bits, own_rows, piece.column("floor").to_numpy()), block, k)

    return compare


_FOUND = T.StructType(
    [
        T.StructField("query", T.LongType()),
        T.StructField("candidate", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def _visit(queries: DataFrame, index: DataFrame, places: int, cells: int, k: int) -> DataFrame:
    """Best k of each visited block for every query.

    ``queries`` carry ``block`` and ``floor``; ``index`` carries ``block``; both
    carry the ``copies`` of their blocks and the ``shift`` that numbers all copies
    of all blocks without gaps, ``places`` in all.  ``cells`` is the number of
    comparisons, which decides the number of tasks.  Places are dealt out in
    turn: by hash, several large ones would meet in one task.
    """
    columns = ["packed", "bits", "first_row"]
    own = F.col("block") * F.col("copies") + F.col("shift")
    asking = queries.select(
        (own + F.pmod(F.xxhash64("first_row"), F.col("copies"))).alias("place"),
        F.lit(True).alias("is_query"), "floor", *columns,
    )
    every_copy = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")
    offered = index.select(own.alias("own"), every_copy, *columns).select(
        (F.col("own") + F.col("copy")).cast("bigint").alias("place"),
        F.lit(False).alias("is_query"), F.lit(0.0).alias("floor"), *columns,
    )
    session = queries.sparkSession
    wide = int(session.conf.get("spark.sql.shuffle.partitions"))
    wide = max(wide, 4 * session.sparkContext.defaultParallelism)
    tasks = min(places, max(wide, cells // CELLS_PER_TASK))
    return (
        offered.unionByName(asking)
        .repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("place", "is_query", "first_row")
        .mapInArrow(_best_in_block(k), _FOUND)
    )


def _first_k(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "candidate")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _literal(numbers: list[int]) -> Column:
    """A long constant array; one string costs less than one call per element."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def _block_size(rows: int, cores: int, k: int, block_rows: int) -> int:
    return max(k, min(block_rows, max(MIN_BLOCK_ROWS, rows // (2 * cores) + 1)))


def _search(queries: DataFrame, index: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query, candidate, similarity): first k distinct fingerprints per query."""
    # At most one row per possible bit count.
    histogram = {r["bits"]: r["n"] for r in index.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    cores = queries.sparkSession.sparkContext.defaultParallelism
    layout = _lay_out(histogram, _block_size(sum(histogram.values()), cores, k, block_rows))
    asked = queries.count()
    cells = asked * sum(histogram.values())
    # Few blocks are copied until they are work for all cores.
    worth = min(4 * cores // layout.blocks, cells // layout.blocks // CELLS)
    copies = max(1, -(-asked // QUERIES_PER_COPY), worth)
    known = {
        "first": _literal(layout.first), "last": _literal(layout.last), "copies": F.lit(copies), "shift": F.lit(0),
    }

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumns(known)

    return _passes(queries, index, k, placed, layout.blocks, layout.blocks * copies, cells, layout.blocks == 1)


_LAYOUT = "task string, first array<bigint>, last array<bigint>, blocks bigint"


def _search_by_task(queries: DataFrame, index: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The same within each ``task``.

    A task's layout is one row of at most two numbers per possible bit count; it
    is worked out where the task's bit counts meet, and joined to its rows.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    size = _block_size(index.count(), cores, k, block_rows)

    def lay_out(counts: pa.Table) -> pa.Table:
        layout = _lay_out(dict(zip(counts["bits"].to_pylist(), counts["n"].to_pylist())), size)
        return pa.table(
            {
                "task": counts["task"].slice(0, 1), "first": pa.array([layout.first], pa.list_(pa.int64())),
                "last": pa.array([layout.last], pa.list_(pa.int64())), "blocks": pa.array([layout.blocks], pa.int64()),
            }
        )

    counts = index.groupBy("task", "bits").agg(F.count("*").alias("n"))
    asked = queries.groupBy("task").agg(
        F.ceil(F.count("*") / QUERIES_PER_COPY).alias("copies"), F.count("*").alias("asked")
    )
    laid = counts.groupBy("task").applyInArrow(lay_out, _LAYOUT).join(asked, "task")
    own = global_prefix_sum(
        laid.withColumn("places", F.col("blocks") * F.col("copies")), [F.col("task")],
        {"blocks": "before", "places": "places_before"},
    )
    layouts = materialise(
        own.select(
            "task", "blocks", "copies", "asked", "places",
            (F.col("places_before") - F.col("before") * F.col("copies")).alias("shift"),
            *[F.transform(side, lambda block: block + F.col("before")).alias(side) for side in ("first", "last")],
        ),
        "layouts",
    )
    total = layouts.agg(
        F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("places"), F.lit(0)),
        F.coalesce(F.max("blocks"), F.lit(0)), F.coalesce(F.sum(F.col("asked") * F.col("blocks")), F.lit(0)),
    ).first()
    layouts = layouts.drop("blocks", "asked", "places")

    def placed(rows: DataFrame) -> DataFrame:
        return attach_counted(rows, layouts, "task", row_bytes=16 * (N_BITS + 1))

    return _passes(queries, index, k, placed, max(total[0], 1), max(total[1], 1), total[3] * size, total[2] <= 1)


def _passes(
    queries: DataFrame, index: DataFrame, k: int, placed: Callable[[DataFrame], DataFrame],
    blocks: int, places: int, cells: int, home_only: bool,
) -> DataFrame:
    """Both passes; ``placed`` adds the ``first`` and ``last`` block of every bit count."""

    def spread(rows: DataFrame, name: str) -> DataFrame:
        low, high = F.get("first", F.col("bits")), F.get("last", F.col("bits"))
        block = low + F.pmod(F.xxhash64("first_row"), high - low + 1)
        return placed(rows).withColumn(name, block.cast("bigint")).drop("first", "last")

    offered, home = spread(index, "block"), spread(queries, "home")
    seeds = materialise(
        _visit(
            home.withColumns({"block": F.col("home"), "floor": F.lit(0.0)}), offered, places, cells // blocks, k
        ),
        "seeds",
    )
    if home_only:
        return seeds
    floors = seeds.groupBy("query").agg(
        F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(0.0)).alias("floor")
    )
    known = home.drop("copies", "shift").join(floors, F.col("first_row") == F.col("query"), "left").withColumn(
        "floor", F.coalesce("floor", F.lit(0.0))
    )
    # min(a, b) / max(a, b) >= floor, widened a little against rounding.
    fewest = F.greatest(F.ceil(F.col("bits") * F.col("floor") - 1e-6), F.lit(0)).cast("int")
    most = F.when(
        F.col("floor") > 0,
        F.least(F.floor(F.col("bits") / F.col("floor") + 1e-6), F.lit(N_BITS)),
    ).otherwise(F.lit(N_BITS)).cast("int")
    reach = F.sequence(F.get("first", fewest), F.get("last", most))
    others = placed(known).withColumn("block", F.explode(reach)).where(F.col("block") != F.col("home"))
    rest = _visit(others, offered, places, cells, k)
    return _first_k(seeds.unionByName(rest), k)


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    query_id: str = "row_id",
    index_id: str = "row_id",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    task: str | None = None,
) -> DataFrame:
    """(query_id, neighbours): the k most similar index rows of every query row.

    Both sides come from :func:`build_index`.  Most similar first, equal ones
    in order of ``index_id``; rows that share nothing count as similarity 0
    and fill the list up.  With ``exclude_self`` a row is not its own
    neighbour, but its copies are.

    ``task`` names a column of both sides: every query finds neighbours of its
    own task only, as if each task were searched alone, and rows without a task
    are one.  Ids must then be unique over all tasks.  A query whose task has no
    index rows gives no row, as with an empty index.
    """
    wanted = k + 1 if exclude_self else k
    has_fp = F.col("packed").isNotNull()
    # A packed fingerprint has a fixed length, so with its task it is one key.
    of_task = [] if task is None else [task_key(task).alias("task")]
    asked = queries.where(has_fp).select(F.col(query_id).alias("row_id"), "packed", *of_task)
    offered = index.where(has_fp).select(F.col(index_id).alias("row_id"), "packed", *of_task)
    by = [] if task is None else ["task"]
    distinct_queries = _distinct(asked, "row_id", *by)
    same = queries is index and query_id == index_id
    distinct_index = distinct_queries if same else _distinct(offered, "row_id", *by)
    search = _search if task is None else _search_by_task
    near = search(distinct_queries, distinct_index, wanted, block_rows)

    # The first rows of every fingerprint; each task keeps only that many.
    by_row = Window.partitionBy("packed", *by).orderBy("row_id")
    members = materialise(
        offered.withColumn("n", F.row_number().over(by_row))
        .where(F.col("n") <= wanted)
        .groupBy("packed", *by)
        .agg(F.min("row_id").alias("candidate"), F.sort_array(F.collect_list("row_id")).alias("rows"))
        .drop("packed", *by),
        "members",
    )
    # At most k lists of k rows per query: nearest first, then in row order.
    far_first = F.transform("rows", lambda r: F.struct((-F.col("similarity")).alias("far"), r.alias("row_id")))
    listed = (
        attach_counted(near, members, "candidate")
        .groupBy("query")
        .agg(F.sort_array(F.flatten(F.collect_list(far_first))).alias("all"))
        .select(
            F.col("query").alias("first_row"),
            F.transform(
                F.slice("all", 1, wanted),
                lambda x: F.struct(x["row_id"].alias("row_id"), (-x["far"]).alias("similarity")),
            ).alias("neighbours"),
        )
    )
    own = F.concat("packed", F.encode("task", "utf-8")) if by else F.col("packed")
    per_fp = distinct_queries.withColumn("own", own).select("own", "size", "first_row").join(listed, "first_row")
    answered = attach_by_key(
        asked.withColumn("own", own), materialise(per_fp.drop("first_row"), "neighbours"), "own", "size"
    )
    neighbours = F.col("neighbours")
    if exclude_self:
        neighbours = F.slice(
            F.filter(neighbours, lambda x: x["row_id"] != F.col("row_id")), 1, k
        )
    return answered.select(
        F.col("row_id").alias(query_id), neighbours.cast(NEIGHBOURS_TYPE).alias("neighbours")
    )


def neighbour_rows(neighbours: DataFrame, query_id: str = "row_id") -> DataFrame:
    """(query_id, rank, neighbour_id, similarity), one row per neighbour."""
    return neighbours.select(
        F.col(query_id).alias("query_id"), F.posexplode("neighbours").alias("place", "n")
    ).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("n.row_id").alias("neighbour_id"),
        F.col("n.similarity").alias("similarity"),
    )


def candidate_pool(queries: DataFrame, index: DataFrame, size: int = 50, **options) -> DataFrame:
    """The pool the selection strategies choose from."""
    return knn(queries, index, size, **options)
