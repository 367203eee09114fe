"""Class statistics and oversampling of a rare class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions.hashing import portable_hash
from shotweave.functions.text import rotations
from shotweave.operators.joins import attach_by_key
from shotweave.operators.prefix import global_ordinal
from shotweave.operators.split import task_key
from shotweave.storage import fits_broadcast, materialise

# Fixed values.
IMBALANCE_RATIO = 5
VARIANTS = 10


def class_counts(df: DataFrame, label: str, order: str = "row_id") -> DataFrame:
    """Rows and first row of every class."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first_row"))


def class_stats(df: DataFrame, label: str, order: str = "row_id") -> DataFrame:
    """One row: number of classes, the largest and the smallest class, their ratio.

    Ties go to the class that appears first.
    """
    counts = class_counts(df, label, order)
    early = F.struct(F.col("n"), -F.col("first_row"))
    rare = F.struct(F.col("n"), F.col("first_row"))
    return counts.agg(
        F.count("*").alias("classes"),
        F.max_by(label, early).alias("majority"),
        F.max("n").alias("majority_rows"),
        F.min_by(label, rare).alias("minority"),
        F.min("n").alias("minority_rows"),
    ).withColumn("ratio", F.col("majority_rows") / F.col("minority_rows"))


def oversample_minority(
    df: DataFrame,
    label: str,
    text: str,
    order: str = "row_id",
    ratio: int = IMBALANCE_RATIO,
    variants: Callable[[Column], Column] = rotations,
    seed: int = 42,
) -> DataFrame:
    """Add reworded copies of the rarest class, marked ``is_augmented``.

    Nothing is added unless the largest class is more than ``ratio`` times the
    rarest.  Then the class grows to a ``ratio``-th of the largest one.  The
    missing rows are shared out evenly over the rows that have a variant; the
    remainder goes to those first in hash order.  A row with more copies than
    variants repeats them in turn.  Copies get ids above all existing ones.
    """
    plain = df.withColumn("is_augmented", F.lit(False))
    stats = materialise(class_stats(df, label, order), "classes").where(
        (F.col("classes") >= 2) & (F.col("majority_rows") > ratio * F.col("minority_rows"))
    )
    found = stats.first()
    if found is None:
        return plain
    missing = found["majority_rows"] // ratio - found["minority_rows"]
    rare = df.where(F.col(label) == F.lit(found["minority"]))
    # Only ids are ranked; texts are fetched for the rows that get copies.
    ids = rare.where(F.size(variants(F.col(text))) > 0).select(
        order, portable_hash(seed, F.col(order)).alias("__hash")
    )
    ranked = materialise(
        global_ordinal(ids, [F.col("__hash"), F.col(order)], "__rank"), "minority"
    )
    sources = ranked.count()
    if missing <= 0 or not sources:
        return plain
    last_id = df.agg(F.max(order)).first()[0]
    used = materialise(
        ranked.where(F.col("__rank") < missing).join(rare, order).withColumn("__variants", variants(F.col(text))), "sources"
    )
    # Copy number n is of the source n modulo their number, so no row grows an array.
    numbers = df.sparkSession.range(missing).select(
        F.col("id").alias("__number"), (F.col("id") % sources).alias("__rank"), F.expr(f"id div {sources}").alias("__copy")
    )
    # Sources have the same number of copies, give or take one: few are small
    # enough to send everywhere, many make no hot key.
    copies = numbers.join(F.broadcast(used) if fits_broadcast(used) else used, "__rank")
    chosen = F.pmod(F.col("__hash") + F.col("__copy"), F.size("__variants")).cast("int")
    reworded = copies.withColumns(
        {
            text: F.get("__variants", chosen),
            order: F.lit(last_id) + 1 + F.col("__number"),
            "is_augmented": F.lit(True),
        }
    )
    return plain.unionByName(reworded.select(plain.columns))


#: Copies of one row that are made in one step.
STEP = 1000


def oversample_by_task(
    df: DataFrame,
    task: str,
    label: str,
    text: str,
    order: str = "row_id",
    ratio: int = IMBALANCE_RATIO,
    variants: Callable[[Column], Column] = rotations,
    seed: int = 42,
) -> DataFrame:
    """:func:`oversample_minority` for a table of many tasks, each as if it were alone.

    Copies get ids above those of their own task.  Rows without a task form one.
    """
    plain = df.withColumn("is_augmented", F.lit(False))
    keyed = df.withColumn("__task", task_key(task))
    counts = keyed.groupBy("__task", label).agg(F.count("*").alias("n"), F.min(order).alias("first_row"), F.max(order).alias("last"))
    rare = F.struct(F.col("n"), F.col("first_row"))
    stats = counts.groupBy("__task").agg(
        F.count("*").alias("classes"), F.max("n").alias("most"), F.min("n").alias("__size"), F.max("last").alias("__last"),
        F.min_by(label, rare).alias("__minority"),
    )
    missing = F.expr(f"most div {int(ratio)}") - F.col("__size")
    grown = materialise(
        stats.where((F.col("classes") >= 2) & (F.col("most") > ratio * F.col("__size")))
        .withColumn("__missing", missing).where("__missing > 0").drop("classes", "most"),
        "grown",
    )
    # ``__size`` counts the rows of the rare class, the only ones that are met.
    sources = attach_by_key(keyed, grown.withColumn("__rows", F.col("__size")), "__task", "__rows").where(
        F.col(label) == F.col("__minority")
    ).withColumn("__variants", variants(F.col(text))).where(F.size("__variants") > 0)
    sources = materialise(sources.withColumn("__hash", portable_hash(seed, F.col(order))), "sources")
    ids = sources.select("__task", order, "__hash")
    ranked = materialise(global_ordinal(ids, [F.col("__task"), F.col("__hash"), F.col(order)], "__rank"), "ranked")
    totals = ranked.groupBy("__task").agg(F.min("__rank").alias("__first"), F.count("*").alias("__sources"))
    totals = materialise(totals.withColumn("__rows", F.col("__sources")), "totals")
    placed = attach_by_key(ranked, totals, "__task", "__rows").withColumn("__rank", F.col("__rank") - F.col("__first"))
    placed = sources.join(placed.drop("__hash"), ["__task", order])
    quota = F.expr("__missing div __sources") + (F.col("__rank") < F.col("__missing") % F.col("__sources")).cast("bigint")
    wanted = placed.withColumn("__quota", quota).where("__quota > 0")
    # In steps, so that no row grows a long array and its copies are dealt out.
    steps = wanted.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__quota - 1) div {STEP}"))))
    steps = steps.repartition("__task", "__rank", "__step")
    last = F.least((F.col("__step") + 1) * STEP, F.col("__quota")) - 1
    copies = steps.withColumn("__copy", F.explode(F.sequence(F.col("__step") * STEP, last)))
    chosen = F.pmod(F.col("__hash") + F.col("__copy"), F.size("__variants")).cast("int")
    reworded = copies.withColumns(
        {
            text: F.get("__variants", chosen),
            order: F.col("__last") + 1 + F.col("__rank") + F.col("__copy") * F.col("__sources"),
            "is_augmented": F.lit(True),
        }
    )
    return plain.unionByName(reworded.select(plain.columns))
