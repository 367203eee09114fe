"""Intermediate results in the shared scratch folder.

Steps that read a result twice, or that must not be recomputed differently,
write it as Parquet below the folder the session names in
``spark.checkpoint.dir``.  A lost executor then costs no recomputation, and the
files carry the sizes the optimizer needs to choose joins.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@lru_cache(maxsize=None)
def _own_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="run-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, or of its context.

    Only a session in one process (``local[...]``) gets a folder of its own
    where none is set; on a cluster that would lose files, so it is an error.
    """
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/shotweave-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns how many.

    Results that still read them cannot be computed afterwards, so call it when
    they are written or collected.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
    return len(paths)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def replace_folders(df: DataFrame, path: str, by: list[str]) -> None:
    """Write JSON Lines, one folder per value of ``by``; what was there for the first column's values goes.

    Everything is written beside the target first; then each folder of the first
    level takes the place of the one of the same name.  Folders of other values
    stay, so one task can be written again without touching the rest.
    """
    if not by:
        df.write.mode("overwrite").json(path)
        return
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.partitionBy(*by).json(staged)
        for found in files.listStatus(place(staged)):
            if found.isDirectory():
                target = place(path, found.getPath().getName())
                files.delete(target, True)
                if not files.rename(found.getPath(), target):
                    raise OSError(f"could not move {found.getPath()} to {target}")
    finally:
        files.delete(place(staged), True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a written table the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Written tables up to this size may be broadcast.
BROADCAST_BELOW = 16 * 2**20


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a written table is small enough to send to every executor."""
    return estimated_bytes(df) <= BROADCAST_BELOW
