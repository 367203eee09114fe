"""Logical records of quoted CSV text, from files that are split anywhere.

A line break inside quotes belongs to its field, so whether a line begins a
record depends on all text before it.  A line is a function on one bit, "are we
inside quotes": it keeps the bit, sets it, clears it or flips it.  These functions
compose, so every file split is first reduced to one function, a prefix over the
splits (one row each) tells the bit at the start of each, and then all splits
join their lines to records at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.storage import fits_broadcast, materialise

# Where the reader of a line stands.
_FIELD_START, _QUOTED, _CLOSING, _PLAIN = 0, 1, 2, 3


def _exit_state(line: Column, entry: int) -> Column:
    """Whether a line that is entered at a record's start (0) or in quotes (1) ends in quotes.

    A quote opens a field only at its start; a doubled one inside is text; after
    the closing one, and in fields without quotes, further quotes are text.
    """
    parts = F.split(line, '"', -1)

    def before_quote(state: Column, part: Column) -> Column:
        ends = F.when(part == "", F.lit(None)).when(part.endswith(","), F.lit(_FIELD_START)).otherwise(F.lit(_PLAIN))
        return F.when(state == _QUOTED, F.lit(_QUOTED)).otherwise(F.coalesce(ends, state))

    def quote(state: Column) -> Column:
        return (
            F.when(state == _FIELD_START, F.lit(_QUOTED)).when(state == _QUOTED, F.lit(_CLOSING))
            .when(state == _CLOSING, F.lit(_QUOTED)).otherwise(F.lit(_PLAIN))
        )

    quotes = F.slice(parts, 1, F.size(parts) - 1)
    last = F.aggregate(quotes, F.lit(entry), lambda state, part: quote(before_quote(state, part)))
    inside = F.when(last == _QUOTED, F.lit(True)).otherwise(F.lit(False))
    return F.when(line.contains('"'), inside).otherwise(F.lit(bool(entry)))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they lie in and what they do to the quote bit."""
    raw = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "^﻿", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return raw.select(
        "line", "file", "start",
        _exit_state(F.col("line"), 0).alias("after_start"), _exit_state(F.col("line"), 1).alias("after_quoted"),
    )


def _states(entry: bool, after_start: np.ndarray, after_quoted: np.ndarray) -> np.ndarray:
    """The bit before each of n lines, and after the last: n + 1 values."""
    n = len(after_start)
    number = np.arange(n)
    fixed = after_start == after_quoted
    last_fixed = np.maximum.accumulate(np.where(fixed, number, -1))
    flips = np.cumsum(after_start & ~after_quoted)
    base = np.where(last_fixed >= 0, after_start[np.maximum(last_fixed, 0)], entry)
    since = flips - np.where(last_fixed >= 0, flips[np.maximum(last_fixed, 0)], 0)
    return np.concatenate([[entry], base ^ (since % 2 == 1)]).astype(bool)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that lie in one split."""
    if not batch.num_rows:
        return
    file, start = batch.column("file").dictionary_encode(), np.asarray(batch.column("start"))
    code = np.asarray(file.indices)
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield file.dictionary[int(code[a])].as_py(), int(start[a]), batch.slice(a, b - a)


def _blank(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, r"\A[ \t\r]*\z").cast(pa.uint8())).astype(bool)


def _bits(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).cast(pa.uint8())).astype(bool)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its exit state for both entry states, and its lines outside quotes."""
    now, held = None, None
    for batch in batches:
        for file, start, part in _stretches(batch):
            if now != (file, start):
                if now is not None:
                    yield _summary(now, held)
                now, held = (file, start), [False, True, 0, 0]
            blank = _blank(part.column("line"))
            for entry in (0, 1):
                states = _states(held[entry], _bits(part, "after_start"), _bits(part, "after_quoted"))
                held[entry] = bool(states[-1])
                held[2 + entry] += int((~states[:-1] & ~blank).sum())
    if now is not None:
        yield _summary(now, held)


_SUMMARY = "file string, start bigint, exit0 boolean, exit1 boolean, rows0 bigint, rows1 bigint"


def _summary(split: tuple[str, int], held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [dict(zip(("file", "start", "exit0", "exit1", "rows0", "rows1"), (*split, *held), strict=True))],
        schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("exit0", pa.bool_()), ("exit1", pa.bool_()),
                          ("rows0", pa.int64()), ("rows1", pa.int64())]),
    )


_JOINED = "file_index bigint, row bigint, open boolean, part bigint, text string"


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split with their number in the file and among all rows.

    Lines before the first record of a split belong to the one an earlier split
    left open; ``open`` marks text that is a part of a record only.  The last
    record of a batch waits for the next batch, as a list of lines, so that a long
    field is joined once.
    """
    now, inside, begun = None, False, False
    number, shift, in_file = 0, 0, 0
    waiting: list[pa.Array] = []

    def rows(texts: pa.Array, first: int, is_part: bool) -> pa.RecordBatch:
        n = len(texts)
        at = np.arange(first, first + n)
        return pa.RecordBatch.from_arrays(
            [pa.array(at + in_file), pa.array(at + shift), pa.array([is_part] * n, pa.bool_()),
             pa.array([now[1]] * n, pa.int64()), texts.cast(pa.string())],
            names=["file_index", "row", "open", "part", "text"],
        )

    def close(goes_on: bool) -> Iterator[pa.RecordBatch]:
        """The waiting lines end here, or go on in the next split."""
        nonlocal number, waiting
        lines = pa.concat_arrays(waiting) if waiting else pa.array([], pa.string())
        waiting = []
        if len(lines):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")
            if not begun:
                yield rows(text, -1, True)
            elif not _blank(text)[0]:
                yield rows(text, number, goes_on)
                number += 1

    for batch in batches:
        for file, start, part in _stretches(batch):
            if now != (file, start):
                yield from close(inside)
                now, begun, number = (file, start), False, 0
                inside = bool(part.column("entry")[0].as_py())
                shift, in_file = part.column("shift")[0].as_py(), part.column("in_file")[0].as_py()
            states = _states(inside, _bits(part, "after_start"), _bits(part, "after_quoted"))
            inside = bool(states[-1])
            begins = np.flatnonzero(~states[:-1])
            lines = part.column("line")
            if not len(begins):
                waiting.append(lines)
                continue
            waiting.append(lines.slice(0, begins[0]))
            yield from close(False)
            begun = True
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), lines), "\n")
            whole = whole.filter(pa.array(~_blank(whole)))
            if len(whole):
                yield rows(whole, number, False)
                number += len(whole)
            waiting.append(lines.slice(begins[-1]))
    yield from close(inside)


def _placed(splits: DataFrame) -> DataFrame:
    """What each split starts with: the quote bit, and how many records come before.

    One row per split, so the running sums fit in one task.  Every file begins
    outside quotes; its first record is the header and no row.
    """
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("exit0") & ~F.col("exit1")).cast("int")
    fixed = F.when(F.col("exit0") == F.col("exit1"), F.struct("exit0", "flips"))
    flips_before = F.coalesce(F.sum(flip).over(earlier), F.lit(0))
    last = F.last(fixed, ignorenulls=True).over(earlier)
    odd = (flips_before - F.coalesce(last["flips"], F.lit(0))) % 2 == 1
    opened = splits.withColumn("flips", flips_before + flip).withColumn(
        "entry", F.coalesce(last["exit0"], F.lit(False)) != odd
    )
    counted = opened.withColumn("n", F.when(F.col("entry"), F.col("rows1")).otherwise(F.col("rows0")))
    counted = counted.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counted = counted.withColumn("header", ((F.col("in_file") == 0) & (F.col("n") > 0)).cast("int"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.coalesce(F.sum(F.col("n") - F.col("header")).over(before), F.lit(0))
    return counted.select("file", "start", "entry", "in_file", (rows_before - F.col("header")).alias("shift"))


def logical_records(spark: SparkSession, path: str) -> DataFrame:
    """(row, text): the records of CSV files after their headers, numbered from 0.

    Files count in the order of their paths.  A record is one or more lines; blank
    lines between records are none.  Files are read twice and in as many tasks as
    they have splits; only records that lie across splits are shuffled.
    """
    lines = text_lines(spark, path)
    splits = materialise(_placed(lines.mapInArrow(_summaries, _SUMMARY)), "splits")
    if fits_broadcast(splits):
        placed = lines.join(F.broadcast(splits), ["file", "start"])
    else:
        numbered = lines.withColumn("seen", F.monotonically_increasing_id())
        placed = numbered.join(splits, ["file", "start"]).sortWithinPartitions("file", "start", "seen")
    found = placed.mapInArrow(_join_lines, _JOINED).where(F.col("file_index") > 0)
    found = materialise(found.drop("file_index"), "csv-records")
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    across = found.where("open").groupBy("row").agg(F.array_join(parts["text"], "\n").alias("text"))
    return found.where("NOT open").select("row", "text").unionByName(across)
