"""Putting one-row results side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one row.

    The frames are stacked (absent columns NULL) and folded by ``max``, which skips
    NULLs: a union and one tiny aggregate, no join.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
