"""Helpers for folds of Spark's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: the end of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, then)
