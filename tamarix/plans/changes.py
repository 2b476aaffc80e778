"""Changes to a table as new DataFrames: what UPDATE, DELETE and upsert leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _condition(condition) -> Column:
    return F.coalesce(condition if isinstance(condition, Column) else F.expr(condition) if condition else F.lit(True), F.lit(False))


def updated(df: DataFrame, condition, assignments: dict[str, str | Column]) -> DataFrame:
    """All rows; those where the condition is true with the assignments, which see the old values."""
    hit = _condition(condition)
    new = {c: F.when(hit, (v if isinstance(v, Column) else F.expr(v)).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in assignments.items()}
    return df.withColumns(new)


def remaining(df: DataFrame, condition) -> DataFrame:
    """The rows where the condition is false or unknown."""
    return df.where(~_condition(condition))


def affected(df: DataFrame, condition) -> DataFrame:
    return df.where(_condition(condition))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows without those whose keys are in new, and all new rows; null keys never match."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
