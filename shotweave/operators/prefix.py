"""Running sums and ordinals over a whole table, without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.storage import materialise

_PART = "__part"


def global_prefix_sum(
    df: DataFrame, order: list[Column], weights: dict[str, str]
) -> DataFrame:
    """Exclusive running sums of BIGINT columns in a total order.

    ``weights`` maps a column to the name of its running sum.  One range
    shuffle puts the rows in order; each partition adds up its own rows and
    the result is written.  The totals per partition, one row each, give the
    offsets.  ``order`` must be unique, otherwise ties fall anywhere.
    """
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_PART, F.spark_partition_id())
    )
    schema = T.StructType(
        ordered.schema.fields
        + [T.StructField(name, T.LongType()) for name in weights.values()]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = dict.fromkeys(weights, 0)
        for batch in batches:
            arrays = batch.columns
            for column in weights:
                values = batch.column(batch.schema.get_field_index(column))
                running = pc.add(pc.cumulative_sum(values), carried[column])
                arrays.append(pc.subtract(running, values))
                if batch.num_rows:
                    carried[column] = running[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                arrays, names=batch.schema.names + list(weights.values())
            )

    local = materialise(ordered.mapInArrow(add_up, schema), "prefix")
    totals = local.groupBy(_PART).agg(
        *[F.sum(column).alias(f"{name}__total") for column, name in weights.items()]
    )
    # One row per partition of the range shuffle, so one task can hold them all.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PART,
        *[
            F.coalesce(F.sum(f"{name}__total").over(before), F.lit(0)).alias(f"{name}__offset")
            for name in weights.values()
        ],
    )
    joined = local.join(F.broadcast(offsets), _PART)
    return joined.select(
        *df.columns,
        *[
            (F.col(name) + F.col(f"{name}__offset")).alias(name)
            for name in weights.values()
        ],
    )


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Dense 0-based position of every row in a total order."""
    one = "__one"
    counted = global_prefix_sum(
        df.withColumn(one, F.lit(1).cast("bigint")), order, {one: name}
    )
    return counted.drop(one)
