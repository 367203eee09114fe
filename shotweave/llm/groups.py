"""Groups of documents of bounded size, and sums that meet in a tree."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.storage import materialise

#: UTF-8 bytes of text in one group of documents.
GROUP_BYTES = 8 << 20
BLOBS = "bucket int, blob binary"


def group_count(df: DataFrame, text: str, least: int = 1) -> int:
    """How many groups keep a group's text near ``GROUP_BYTES``.

    Small tables are dealt out over all partitions, but not into groups of less than
    ``least`` bytes: every group may send a blob to every other.
    """
    total = int(df.agg(F.sum(F.octet_length(df[text]))).first()[0] or 0)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-total // GROUP_BYTES), min(2 * partitions, -(-total // least)), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def blob_rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())],
        names=["bucket", "blob"],
    )


def tree_merge(parts: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int = 64) -> bytes | None:
    """One blob made of the blobs of all (bucket, blob) rows, ``fan`` at a time.

    A blob must not grow when it is merged.  Returns None for no rows.
    """
    parts = materialise(parts, "parts")

    def node(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([blob_rows([(table["bucket"][0].as_py(), merge(table["blob"].to_pylist()))])])

    most = parts.agg(F.max("bucket")).first()[0]
    if most is None:
        return None
    while most >= fan:
        most //= fan
        parts = materialise(
            parts.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("int"))
            .groupBy("bucket").applyInArrow(node, BLOBS),
            "parts",
        )
    return merge([row["blob"] for row in parts.collect()])
