"""Vector expressions on ARRAY<FLOAT> columns, accumulated in DOUBLE inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector(values) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def dot(a: Column, b: Column) -> Column:
    """The inner product; null where either side is null, an error where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unlike length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalize(a: Column) -> Column:
    """a at unit length; unchanged where its norm is zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def top_k(df: DataFrame, score: Column, k: int, *ties: str, name: str = "score") -> DataFrame:
    """The k rows of the highest score, ties by the columns named; planned as TakeOrderedAndProject."""
    return df.withColumn(name, score).orderBy(F.desc(name), *ties).limit(k)


def mean_pool(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, i, mean): the mean of each dimension over a group's vectors, pre-aggregated before the shuffle."""
    return df.select(group, F.posexplode(column).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def best_per_group(df: DataFrame, group: str, score: str, k: int, *ties: str, worst: bool = False) -> DataFrame:
    """The k best rows of each group (or the k worst), by a ranked window that Spark prunes before the shuffle."""
    order = F.asc(score) if worst else F.desc(score)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, *ties))).where(F.col("rank") <= k)
