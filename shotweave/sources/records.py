"""Instruction records, results and metrics as JSON."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.storage import fits_broadcast, materialise, replace_folders

RECORD_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("instruction", "input", "output", "original_text")
    ]
)


#: Other names under which files keep a field.
ALIASES = {"original_text": ("original_smiles",)}


def _read_texts(spark: SparkSession, pattern: str) -> DataFrame | None:
    try:
        return spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _elements(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(position, element, fault) of a JSON list; position -1 is the whole file."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        yield -1, None, "malformed"
        return
    if not isinstance(found, list):
        yield -1, None, "not a list"
        return
    for position, element in enumerate(found):
        if isinstance(element, dict):
            yield position, json.dumps(element, ensure_ascii=False), None
        else:
            yield position, None, "not an object"


def _parsed(element: Column, schema: T.StructType) -> list[Column]:
    """The fields of the schema, each under its own name or another it goes by."""
    known = [*schema.fieldNames(), *[a for f in schema.fieldNames() for a in ALIASES.get(f, ())]]
    wide = T.StructType(
        [*schema.fields, *[T.StructField(a, schema[f].dataType) for f in schema.fieldNames() for a in ALIASES.get(f, ())]]
    )
    record = F.from_json(element, wide)
    fields = [F.coalesce(record[f], *[record[a] for a in ALIASES.get(f, ())]).alias(f) for f in schema.fieldNames()]
    # Values as JSON text, so that nothing of a field with another type is lost.
    others = F.map_filter(F.from_json(element, "map<string,string>"), lambda k, _: ~k.isin(known))
    return [*fields, F.when(F.size(others) > 0, others).alias("other")]


def read_records(
    spark: SparkSession, patterns: list[str], schema: T.StructType = RECORD_SCHEMA,
    on_bad: str = "skip",
) -> tuple[DataFrame, DataFrame]:
    """Elements of JSON list files, and what was skipped.

    Records have the fields of ``schema``, ``other`` (a map of all further
    fields, or NULL) and ``row_id``, which numbers them: files in the order of
    pattern and path, elements in the order of the list.  A file matched by two
    patterns is read twice.

    A file counts as a list exactly where Python's ``json.load`` reads one, so
    bare NaN is read and text after the list is not.  With ``on_bad='skip'`` a
    pattern without files warns; a file that is no list, and an element that is
    no object, go to the second frame (path, position, reason), and all other
    elements stay.  With ``fail`` each of these is an error.  A JSON list
    cannot be split, so a file is one task's work: keep large data as JSON
    Lines and use :func:`read_record_lines`.
    """
    if on_bad not in ("skip", "fail"):
        raise ValueError(f"on_bad must be 'skip' or 'fail', not {on_bad!r}")
    parts = []
    for number, pattern in enumerate(patterns):
        texts = _read_texts(spark, pattern)
        if texts is None:
            if on_bad == "fail":
                raise FileNotFoundError(pattern)
            warnings.warn(f"no files found for {pattern!r}: skipped", stacklevel=2)
            continue
        parts.append(texts.select("value", F.col("_metadata.file_path").alias("path"), F.lit(number).alias("pattern")))
    if not parts:
        wanted = T.StructType(
            [*schema.fields, T.StructField("other", T.MapType(T.StringType(), T.StringType())), T.StructField("row_id", T.LongType())]
        )
        return (
            spark.createDataFrame([], wanted),
            spark.createDataFrame([], "path string, position int, reason string"),
        )
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch is as it came from the JVM; only one file of it is held as Python objects.
        for batch in batches:
            for value, path, pattern in zip(*(batch.column(c) for c in ("value", "path", "pattern"))):
                for found in _chunks(_elements(value.as_py())):
                    position, element, reason = zip(*found)
                    bad = next((r for r in reason if r is not None), None)
                    if on_bad == "fail" and bad is not None:
                        raise ValueError(f"not a JSON list of objects: {path.as_py()}: {bad}")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(position, pa.int32()), pa.array(element, pa.string()), pa.array(reason, pa.string()),
                            pa.array([path.as_py()] * len(found), pa.string()), pa.array([pattern.as_py()] * len(found), pa.int32()),
                        ],
                        names=["position", "element", "reason", "path", "pattern"],
                    )

    # Written once: both frames and the numbers come from one reading.
    elements = materialise(
        files.mapInArrow(read, "position int, element string, reason string, path string, pattern int"), "elements"
    )
    sizes = elements.groupBy("pattern", "path").agg(F.count("element").alias("records"), F.max("position").alias("last"))
    # One row per file, so one task can hold them all.
    earlier = Window.orderBy("pattern", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "pattern", "path", F.coalesce(F.sum(F.col("last") + 1).over(earlier), F.lit(0)).alias("start")
    )
    starts = materialise(starts, "starts")
    starts = F.broadcast(starts) if fits_broadcast(starts) else starts
    good = elements.where(F.col("element").isNotNull()).join(starts, ["pattern", "path"])
    records = good.select(*_parsed(F.col("element"), schema), (F.col("start") + F.col("position")).alias("row_id"))
    bad = elements.where(F.col("element").isNull()).select("path", "position", "reason")
    return records, bad


def _chunks(rows: Iterator[tuple], size: int = 500) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        yield chunk


def read_record_lines(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = RECORD_SCHEMA
) -> DataFrame:
    """JSON Lines, one record per line: splittable, for data of any size.

    Records come as from :func:`read_records`.  A line's own ``row_id`` is kept;
    lines without one are numbered, in any order, above 2^40.  Empty lines are
    left out.
    """
    lines = spark.read.text(paths).where(F.trim("value") != "")
    own = F.from_json("value", "row_id bigint")["row_id"]
    fallback = F.lit(1 << 40) + F.monotonically_increasing_id()
    fields = _parsed(F.col("value"), schema)
    other = F.map_filter(fields[-1], lambda k, _: k != "row_id")
    return lines.select(
        *fields[:-1], F.when(F.size(other) > 0, other).alias("other"), F.coalesce(own, fallback).alias("row_id")
    )


def write_records(df: DataFrame, path: str, by: tuple[str, ...] = ("task", "split")) -> None:
    """JSON Lines, one directory per task and split; an empty split has none.

    Writing a task again replaces its directories, also those of splits that it
    no longer has, and no others.
    """
    replace_folders(df, path, list(by))


def write_record_lists(df: DataFrame, path: str, order: str, columns: list[Column], size: int = 500) -> None:
    """JSON lists of at most ``size`` records, one file each, files and records in ascending ``order``.

    One range shuffle moves the rows as they are; the fields (``columns``) are
    worked out behind it, so that a text shown in two fields is moved once.  A
    file has one record a line; the last of a partition may have fewer.
    """

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, number = [], 0
        for batch in batches:
            for record in batch.column(0):
                if lines and number % size == 0:
                    lines[-1] += "]"
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                    lines = []
                lines.append(("," if number % size else "[") + record.as_py())
                number += 1
        if lines:
            lines[-1] += "]"
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    ordered = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    lines = ordered.select(F.to_json(F.struct(*columns)).alias("value")).mapInArrow(bracketed, "value string")
    lines.write.option("maxRecordsPerFile", size).text(path)


def write_results(df: DataFrame, path: str) -> None:
    """All scored rows, one directory per task and strategy; a task written again is replaced."""
    replace_folders(df, path, [c for c in ("task", "strategy") if c in df.columns])


def write_metrics(df: DataFrame, path: str) -> None:
    """The long metrics table, one directory per task and strategy."""
    write_results(df, path.rstrip("/") + "_metrics")
