"""Joins of rows to a per-key result when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave import storage
from shotweave.storage import fits_broadcast, materialise

#: Keys above 1 / HOT_SHARE of all rows are hot, so there are fewer than that.
HOT_SHARE = 1000
#: Places a hot key gets in a shuffle if the hot keys are too large to broadcast.
SALTS = 64


def _rows_fit(keyed: DataFrame, row_bytes: int) -> bool:
    return not row_bytes or keyed.count() * row_bytes <= storage.BROADCAST_BELOW


def _small(keyed: DataFrame, row_bytes: int) -> bool:
    return fits_broadcast(keyed) and _rows_fit(keyed, row_bytes)


def attach_by_key(
    rows: DataFrame, keyed: DataFrame, key: str, size: str, row_bytes: int = 0
) -> DataFrame:
    """Inner join of rows to one row per key, safe for hot keys.

    ``keyed`` is a written table, so its size is known; ``size`` names the
    number of rows of a key, and ``row_bytes`` says how large a row is in memory
    where files say too little (long arrays that compress well).  A table small
    enough is broadcast whole.  Of a larger one the hot keys are, if they are
    small enough: they number less than ``HOT_SHARE`` whatever the data, and
    their rows stay where they are.  Larger hot keys are copied to ``SALTS``
    places each, among which their rows are dealt out.  All other rows meet
    their key in an ordinary join, in which no key holds more than a thousandth
    of the rows.
    """
    if _small(keyed, row_bytes):
        return rows.join(F.broadcast(keyed.drop(size)), key)
    total = keyed.agg(F.sum(size)).scalar()
    hot_key = F.col(size) * HOT_SHARE > total
    hot = materialise(keyed.where(hot_key).drop(size), "hot")
    return _in_place_or_shuffled(rows, hot, keyed.where(~hot_key).drop(size), key, row_bytes)


def _in_place_or_shuffled(rows: DataFrame, hot: DataFrame, cold: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """The join with the rows of hot keys, which are written, and with those of all others."""
    named = F.broadcast(hot.select(key))
    # Judged by its own files, whatever was found of the whole table.
    if storage.estimated_bytes(hot) <= storage.BROADCAST_BELOW and _rows_fit(hot, row_bytes):
        in_place = rows.join(F.broadcast(hot), key)
    else:
        hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
        dealt = rows.join(named, key, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
        copied = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        in_place = dealt.join(copied, [key, "__salt"]).drop("__salt")
    shuffled = rows.join(named, key, "left_anti").join(cold, key)
    return in_place.unionByName(shuffled)


def attach_counted(rows: DataFrame, keyed: DataFrame, key: str, row_bytes: int = 0) -> DataFrame:
    """The same where nobody has counted the rows of a key yet.

    Neighbour lists need it: a few rows can be neighbours of very many
    queries.  The rows are written and counted only if ``keyed`` is too large
    to broadcast.
    """
    if _small(keyed, row_bytes):
        return rows.join(F.broadcast(keyed), key)
    written = materialise(rows, "rows")
    sizes = materialise(written.groupBy(key).agg(F.count("*").alias("__size")), "sizes")
    total = sizes.agg(F.sum("__size")).scalar()
    # Only hot rows of ``keyed`` are written again.
    named = F.broadcast(sizes.where(F.col("__size") * HOT_SHARE > total).select(key))
    hot = materialise(keyed.join(named, key), "hot")
    return _in_place_or_shuffled(written, hot, keyed.join(named, key, "left_anti"), key, row_bytes)
