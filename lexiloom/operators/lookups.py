"""Joins with small tables whose size is proven or checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut_lineage

MAX_ROWS = 2_000_000


def small_side(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """An aggregated table, computed once, and marked for broadcast if it is small.

    The reliable checkpoint lets the size check and the join share one
    computation; a table above ``max_rows`` is joined by shuffle.
    """
    done = cut_lineage(df)
    return F.broadcast(done) if done.limit(max_rows + 1).count() <= max_rows else done
