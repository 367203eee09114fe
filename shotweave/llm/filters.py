"""Taking rejected documents out of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.storage import materialise


def without(df: DataFrame, doc_id: str, gone: DataFrame, gone_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not in ``gone``; null counts as an id.

    The ids are written and merge-joined, which costs the same at every size.
    """
    ids = materialise(gone.select(F.col(gone_id).alias("gone")).distinct(), "gone")
    ids = ids.hint("merge")
    return df.join(ids, df[doc_id].eqNullSafe(ids["gone"]), "left_anti")
