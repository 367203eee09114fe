"""Choice of few-shot examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.hashing import draw, portable_hash
from shotweave.functions.prompts import SHOTS_TYPE, no_shots
from shotweave.operators.joins import attach_counted
from shotweave.operators.prefix import global_ordinal
from shotweave.operators.similarity import neighbour_rows
from shotweave.storage import materialise

# Fixed values.
POOL_SIZE = 50
STRATEGIES = ("similarity", "diversity", "random")
POLICIES = ("use_what_is_there", "drop_query", "keep_instruction", "zero_shot")


def pool_rows(pool: DataFrame, index: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
    """(query_id, rank, neighbour_id, similarity, label) of a candidate pool."""
    labels = index.select(F.col(row_id).alias("neighbour_id"), F.col(label).alias("label"))
    return attach_counted(neighbour_rows(pool), labels, "neighbour_id")


def select_shots(pool: DataFrame, strategy: str, k: int, seed: int = 42) -> DataFrame:
    """(query_id, rank, neighbour_id): examples chosen from a pool.

    ``similarity`` takes the first ``k``.  ``diversity`` takes half (rounded
    up) at random from the yes labels and half from the no labels, in random
    order.  ``random`` takes ``k`` at random, or none from a pool smaller
    than ``k``.  A pool is bounded, so one query's pool fits in any task.
    """
    if strategy == "similarity":
        return pool.where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id")
    chance = portable_hash(seed, "pick", F.col("query_id"), F.col("neighbour_id"))
    if strategy == "diversity":
        answer = F.lower("label")
        classed = pool.withColumn("answer", answer).where(F.col("answer").isin("yes", "no"))
        drawn = Window.partitionBy("query_id", "answer").orderBy(chance, "neighbour_id")
        quota = F.when(F.col("answer") == "yes", F.lit((k + 1) // 2)).otherwise(F.lit(k // 2))
        chosen = classed.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= quota)
    elif strategy == "random":
        drawn = Window.partitionBy("query_id").orderBy(chance, "neighbour_id")
        whole = Window.partitionBy("query_id")
        chosen = (
            pool.withColumns({"n": F.row_number().over(drawn), "size": F.count("*").over(whole)})
            .where((F.col("n") <= k) & (F.col("size") >= k))
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}: use one of {STRATEGIES}")
    shuffled = portable_hash(seed, "order", F.col("query_id"), F.col("neighbour_id"))
    order = Window.partitionBy("query_id").orderBy(shuffled, "neighbour_id")
    return chosen.select(
        "query_id", F.row_number().over(order).alias("rank"), "neighbour_id"
    )


def _distinct_positions(n: Column, k: int, seed: int, query: Column) -> Column:
    """``k`` different positions below ``n``, uniformly drawn.

    Step i draws from one more position than step i - 1; a position already
    taken is replaced by the newly added one.
    """

    def step(taken: Column, i: Column) -> Column:
        upper = n - (k - 1) + i
        position = draw(upper, seed, "position", i, query)
        fresh = F.when(F.array_contains(taken, position), upper - 1).otherwise(position)
        return F.concat(taken, F.array(fresh))

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), none, step) if k > 0 else none


def random_shots(
    queries: DataFrame, index: DataFrame, k: int, query_id: str = "row_id",
    index_id: str = "row_id", seed: int = 42,
) -> DataFrame:
    """(query_id, rank, neighbour_id): ``k`` examples from the whole index.

    Index rows are numbered, every query draws ``k`` different numbers, and the
    two meet in an equi-join.  No query gets any if the index is smaller.
    """
    numbered = materialise(
        global_ordinal(
            index.select(F.col(index_id).alias("neighbour_id")), [F.col("neighbour_id")], "position"
        ),
        "numbered",
    )
    n = numbered.agg(F.count("*")).scalar()
    drawn = (
        queries.select(F.col(query_id).alias("query_id"))
        .withColumn("n", n)
        .where(F.col("n") >= k)
        .select(
            "query_id",
            F.explode(
                _distinct_positions(F.col("n"), k, seed, F.col("query_id"))
            ).alias("position"),
        )
        .join(numbered, "position")
    )
    shuffled = portable_hash(seed, "order", F.col("query_id"), F.col("neighbour_id"))
    order = Window.partitionBy("query_id").orderBy(shuffled, "neighbour_id")
    return drawn.select("query_id", F.row_number().over(order).alias("rank"), "neighbour_id")


def shots_array(chosen: DataFrame, index: DataFrame, text: Column | str, label: Column | str,
                row_id: str = "row_id", tokens: Column | None = None) -> DataFrame:
    """(query_id, shots): ordered examples with the text form asked for.

    ``text`` is a column of the index: the original, a stored masked text, or
    an expression over the index row and ``query_id`` that masks it afresh.
    ``tokens`` is worked out beside the examples, so that the index need not
    carry them through a shuffle.
    """
    text = F.col(text) if isinstance(text, str) else text
    label = F.col(label) if isinstance(label, str) else label
    examples = attach_counted(chosen, index.withColumnRenamed(row_id, "neighbour_id"), "neighbour_id")
    if tokens is not None:
        examples = examples.withColumn("tokens", tokens)
    one = F.struct("rank", text.alias("text"), label.alias("label")).alias("one")
    # A query's examples come from different places: collecting them before the
    # shuffle as well would sort all texts there and merge none.
    together = examples.select("query_id", one).repartition("query_id")
    return together.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list("one")),
            lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label")),
        ).cast(SHOTS_TYPE).alias("shots")
    )


def apply_shortfall(df: DataFrame, k: int, policy: str, shots: str = "shots") -> DataFrame:
    """What happens to a query with fewer than ``k`` examples.

    ``use_what_is_there`` shows them; ``drop_query`` removes the row;
    ``keep_instruction`` marks it with ``keep_stored`` so that its stored
    instruction stays; ``zero_shot`` empties the list.
    """
    found = F.coalesce(F.col(shots), no_shots())
    short = F.size(found) < k
    if policy == "use_what_is_there":
        return df.withColumn(shots, found)
    if policy == "drop_query":
        return df.withColumn(shots, found).where(F.size(shots) >= k)
    if policy == "keep_instruction":
        return df.withColumns({"keep_stored": short, shots: F.when(short, no_shots()).otherwise(found)})
    if policy == "zero_shot":
        return df.withColumn(shots, F.when(short, no_shots()).otherwise(found))
    raise ValueError(f"unknown policy {policy!r}: use one of {POLICIES}")
