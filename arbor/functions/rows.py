"""Frames of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames, whose names differ. A union and one aggregate, no join."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])
