"""Task tables (CSV) and text corpora (Parquet)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.operators.cleaning import drop_missing
from shotweave.sources.quoted import logical_records, text_lines
from shotweave.storage import fits_broadcast, materialise

# Words read as a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns


def read_task(
    spark: SparkSession, path: str, key: str, label: str, row_id: str = "row_id",
    multiline: bool = True,
) -> DataFrame:
    """A task table with missing words as NULL and the row's ordinal.

    All columns are read as text.  The ordinal counts rows in the order of
    file name and position.  A quoted field may have line breaks, and a file is
    still read in as many tasks as it has splits.  ``multiline=False`` says that
    no field has one: the files are read with less work, and a line that
    leaves a quote open is an error.  A line ends with a line feed, with or
    without a carriage return.
    """
    columns = _csv_header(spark, path)
    for wanted in (key, label):
        if wanted not in columns:
            raise ValueError(f"column {wanted!r} not found; available: {columns}")
    records = logical_records(spark, path) if multiline else _one_line_records(spark, path)
    text = F.regexp_replace("text", r"\r\z", "")
    fields = F.from_csv(text, _ddl(columns), {**_CSV, "multiLine": "true"})
    missing = F.lit(MISSING_WORDS)
    parsed = records.select(F.col("row"), fields.alias("f"))
    return parsed.select(
        *[F.when(~F.array_contains(missing, F.col("f")[c]), F.col("f")[c]).alias(c) for c in columns],
        F.col("row").alias(row_id),
    )


def _ddl(columns: list[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` STRING" for c in columns)


def _one_line_records(spark: SparkSession, path: str) -> DataFrame:
    """(row, text) of files in which every record is one line."""
    lines = text_lines(spark, path).where(~F.col("line").rlike(r"\A[ \t\r]*\z"))
    broken = F.concat(F.lit("a quote is left open; read with multiline=True: "), F.substring("line", 1, 200))
    checked = lines.select(
        F.when(F.col("after_start"), F.raise_error(broken)).otherwise(F.col("line")).alias("text"),
        "file", "start", F.monotonically_increasing_id().alias("seen"),
    )
    # One row per file split, so one task can hold them all.
    splits = checked.groupBy("file", "start").agg(F.min("seen").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("header", (F.row_number().over(Window.partitionBy("file").orderBy("start")) == 1).cast("int"))
    rows_before = F.coalesce(F.sum(F.col("n") - F.col("header")).over(before), F.lit(0))
    placed = materialise(
        splits.select("file", "start", "first", "header", (rows_before - F.col("header")).alias("shift")), "splits"
    )
    placed = F.broadcast(placed) if fits_broadcast(placed) else placed
    numbered = checked.join(placed, ["file", "start"])
    at = F.col("seen") - F.col("first")
    return numbered.where((F.col("header") == 0) | (at > 0)).select((at + F.col("shift")).alias("row"), "text")


def read_corpus(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The named column of a Parquet file or directory, without missing rows."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ValueError(f"{path}: neither a Parquet file nor a directory of them") from error
    if column not in table.columns:
        raise ValueError(f"column {column!r} not found; available: {table.columns}")
    return drop_missing(table.select(column), column)


def spread(scan: DataFrame) -> DataFrame:
    """A table just read, dealt out where its files make fewer tasks than there are cores.

    A large table has more splits than that and is never shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
