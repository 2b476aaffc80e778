"""Joins that SQL has no word for: as-of and range joins by bounded buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str, width: float | None = None) -> DataFrame:
    """left with the right side's `value` at the last `on` not after its own, for equal `by`.

    One union, sorted by key and time, and a running last value: no row meets more than one
    other, so time does not grow with the product of a key's rows. With width (in seconds, or in the unit
    of `on`), a key's rows are sorted in pieces of that width, each of which begins with the last value
    of the pieces before it; so a key with very many rows is no single task's work."""
    from pyspark.sql import Window

    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.where(F.col(value).isNotNull()).select(F.col(by), F.col(on), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    if width is None:
        order = Window.partitionBy(by).orderBy(F.col(on), "__side").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn(value, F.last("__v", ignorenulls=True).over(order))
        return found.where("__side = 1").select(*left.columns, value)
    instant = F.col(on).cast("timestamp").cast("double") if "timestamp" in left.schema[on].dataType.simpleString() else F.col(on).cast("double")
    both = both.withColumn("__piece", F.floor(instant / width))
    # One row a piece: its last value, and from those the last one before each piece.
    pieces = both.groupBy(by, "__piece").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(on))).alias("__last"))
    earlier = Window.partitionBy(by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    begin = pieces.select(by, "__piece", F.last("__last", ignorenulls=True).over(earlier).alias("__begin"))
    order = Window.partitionBy(by, "__piece").orderBy(F.col(on), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.last("__v", ignorenulls=True).over(order)).join(begin, [by, "__piece"])
    return found.where("__side = 1").select(*left.columns, F.coalesce("__own", "__begin").alias(value))


def range_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= point < high, by an equality join on buckets of `width`."""
    a = left.withColumn("__bucket", F.floor(point / width))
    b = right.withColumn("__bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return a.join(b, "__bucket").where((point >= low) & (point < high)).drop("__bucket")


def keep_first(df: DataFrame, key, *order) -> DataFrame:
    """One row for each key, the first in the given order."""
    from pyspark.sql import Window

    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
