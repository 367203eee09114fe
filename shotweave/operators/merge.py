"""Merge record sets into one shuffled set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import portable_hash


def merge_shuffle(frames: list[DataFrame], key: str = "row_id", seed: int = 42) -> DataFrame:
    """All rows of all sets, duplicates included, in a repeatable random order.

    Columns a set lacks are NULL.  ``position_hash`` is the sort key; the sort
    is a range shuffle, so writing the result keeps the order across files.
    """
    tagged = [
        frame.withColumn(
            "position_hash", portable_hash(seed, number, F.col(key))
        ).withColumn("source_no", F.lit(number))
        for number, frame in enumerate(frames)
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return merged.orderBy("position_hash", "source_no", key)
