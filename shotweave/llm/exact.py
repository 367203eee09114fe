"""Exact deduplication: content hashes group, byte comparison decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.llm.filters import without
from shotweave.storage import materialise


def exact_groups(
    df: DataFrame,
    doc_id: str,
    text: str,
    keep: str = "min",
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the whole text; null counts as empty.
    ``keep`` names the id that stays, "min" or "max".  Only ids and digests are
    aggregated, before the shuffle as well, so a group with a third of all rows
    is one row per task.  Then every text of a group with more than one row is
    compared with the text that stays, byte by byte; where one differs, that
    hash is grouped again by the text itself.

    Repeated rows with the id that stays are all kept; a null id stays only if
    its group has no other.  An empty table gives an empty result; other columns
    of ``df`` are not looked at, whatever their names.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    hashed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    digests = materialise(
        hashed.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")), "digests"
    )
    groups = materialise(
        digests.groupBy("digest")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )
    members = materialise(hashed.join(groups.drop("group_size").hint("merge"), "digest"), "members")
    stays = (
        members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.min("text").alias("keep_text"))
    )
    collided = materialise(
        members.join(materialise(stays, "stays").hint("merge"), "digest")
        .where(F.col("text") != F.col("keep_text"))
        .select("digest"),
        "collided",
    )
    joined = digests.join(groups, "digest", "left")
    if not collided.isEmpty():
        joined = _regrouped(digests, groups, members, collided, best)
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        "text_sha256",
    ).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def _regrouped(digests, groups, members, collided, best) -> DataFrame:
    """Groups by text where a hash stands for several texts."""
    again = members.join(collided, "digest", "left_semi")
    by_text = materialise(
        again.groupBy("digest", "text")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "by-text",
    )
    plain = digests.join(collided, "digest", "left_anti").join(groups, "digest", "left")
    mixed = digests.join(collided, "digest", "left_semi").join(by_text, ["digest", "text_sha256"])
    return plain.unionByName(mixed)


def drop_exact_copies(df: DataFrame, doc_id: str, text: str, keep: str = "min") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; ids must be unique."""
    return without(df, doc_id, exact_groups(df, doc_id, text, keep).where("NOT kept"))
