"""Shards of equal size from global prefix sums."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.operators.prefix import global_prefix_sum
from shotweave.storage import materialise

#: Groups above this part of a shard are placed one by one: fewer than ``SHARE`` times the shards.
SHARE = 256


def _place(groups: list[tuple[str, int]], shards: int) -> tuple[dict[str, int], list[int]]:
    """Shard of each group, largest first into the emptiest shard, and the loads."""
    loads, shard_of = [0] * shards, {}
    emptiest = [(0, s) for s in range(shards)]
    for digest, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, shard = emptiest[0]
        heapq.heapreplace(emptiest, (load + size, shard))
        shard_of[digest], loads[shard] = shard, load + size
    return shard_of, loads


def _bounds(loads: list[int], rest: int) -> list[int]:
    """Where the part of each shard ends on a line of ``rest`` bytes, which fills all to one level.

    Shards above that level get nothing.
    """
    lowest = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    room, n = rest, 0
    for shard in lowest:
        if n and loads[shard] * n >= room:
            break
        room, n = room + loads[shard], n + 1
    filled, ends, held, k = set(lowest[:n]), [], 0, 0
    for shard, load in enumerate(loads):
        if shard in filled:
            k, held = k + 1, held + load
            ends.append(max(ends[-1] if ends else 0, k * room // n - held))
        else:
            ends.append(ends[-1] if ends else 0)
    return ends


def balanced_shards(df: DataFrame, doc_id: str, text: str, shards: int = 8) -> DataFrame:
    """Assign every row to a shard so that the bytes of the shards are near equal.

    Columns doc_id, size, text_crc32, law, shard, slot, grown_shard.  A row's
    size is the UTF-8 bytes of its text, null has none, plus one.  Equal texts
    are a group and share a shard.  Groups between a ``SHARE``-th of a shard and
    a whole shard are placed first, the largest into the emptiest shard.  All
    other rows are laid out on one line: groups larger than a shard first, which
    cannot stay whole under this law and are cut like any other rows, then small
    groups by size, copies side by side, then by id.  Running sums over the line
    come from sums per partition and one total per partition; the line is cut at
    the room that each shard has left up to a common level, and a group belongs
    where its middle is.  So shards differ by about a ``SHARE``-th or one
    document, unless whole groups alone put a shard above the level.

    Only ids, sizes and digests are shuffled.  Groups are summed before the
    shuffle; ties of repeated rows fall in any order but get different slots.
    An empty table gives no rows; other columns are not looked at.
    """
    content = F.coalesce(df[text], F.lit(""))
    rows = materialise(
        df.select(
            df[doc_id].alias("doc_id"),
            (F.octet_length(content) + 1).cast("bigint").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.md5(content).alias("digest"),
        ),
        "sizes",
    )
    one = F.lit(1).cast("bigint")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_bytes"), F.min("doc_id").alias("first"))
    line = materialise(
        global_prefix_sum(
            groups, [F.desc("group_bytes"), F.asc("first"), F.asc("digest")], {"group_bytes": "group_start"}
        ).drop("first"),
        "line",
    )
    total = line.agg(F.sum("group_bytes")).first()[0] or 0
    whole = F.col("group_bytes") * shards <= total
    large = line.where(whole & (F.col("group_bytes") * shards * SHARE > total)).select("digest", "group_bytes")
    shard_of, loads = _place([tuple(r) for r in large.collect()], shards)
    large_bytes = sum(loads)
    ends = F.array(*[F.lit(2 * end) for end in _bounds(loads, total - large_bytes)[:-1]] or [F.lit(2 * total + 1)])
    given = df.sparkSession.createDataFrame(list(shard_of.items()), "digest string, given int")
    placed = rows.join(line.join(F.broadcast(given), "digest", "left"), "digest").withColumn("one", one)
    summed = global_prefix_sum(
        placed, [F.asc("group_start"), F.asc("doc_id")], {"size": "start", "one": "ordinal"}
    )
    # Large groups lie between those that are cut and the small ones.
    middle = F.when(whole, 2 * (F.col("group_start") - large_bytes) + F.col("group_bytes")).otherwise(
        2 * F.col("start") + F.col("size")
    )
    shard = F.coalesce("given", F.size(F.filter(ends, lambda end: end <= middle))).cast("int")
    # Rows of a shard that follow each other: a large group, or its part of the line before or after those.
    piece = F.when(F.col("given").isNotNull(), F.col("group_start")).otherwise(F.when(whole, -1).otherwise(-2))
    sharded = materialise(
        summed.select("doc_id", "size", "text_crc32", shard.alias("shard"), piece.alias("piece"), "ordinal"),
        "sharded",
    )
    # One row per piece, fewer than SHARE + 2 times the shards.
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = sharded.groupBy("shard", "piece").agg(F.min("ordinal").alias("begin"), F.count("*").alias("n")).select(
        "shard", "piece", (F.col("begin") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("begin")
    )
    return sharded.join(F.broadcast(begins), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ordinal") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
