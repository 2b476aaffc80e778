"""Queries against a Postgres server, or any other that has a JDBC driver on Spark's class path."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sqlite import camel_case


def options(url: str, query: str, params=(), partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **more: str) -> dict[str, str]:
    """The options of a read. Parameters become literals in the server's own spelling; with a partition column, the query is read in that many ranges between the bounds."""
    statement = _bound(query, params)
    found = {"url": url, **more}
    if partition_column:
        if not bounds:
            raise ValueError("a partition column needs bounds")
        return found | {"dbtable": f"({statement}) AS q", "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return found | {"query": statement}


def _bound(query: str, params) -> str:
    """The query with $1.. as literals of standard SQL."""
    out, i = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$(\d+)", query, re.S):
        out.append(query[i : m.start()])
        if m[1]:
            if not 1 <= int(m[1]) <= len(params):
                raise ValueError(f"no value for ${m[1]}")
            out.append(_literal(params[int(m[1]) - 1]))
        else:
            out.append(m[0])
        i = m.end()
    return "".join(out) + query[i:]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, bytes):
        return f"'\\x{value.hex()}'"
    return "'" + str(value).replace("'", "''") + "'"


def read(spark: SparkSession, url: str, query: str, params=(), camel: bool = False, **more) -> DataFrame:
    """The query's result; filters on it and the columns chosen of it are pushed to the server by Spark. With camel, names in camel case."""
    df = spark.read.format("jdbc").options(**options(url, query, params, **more)).load()
    return df.toDF(*map(camel_case, df.columns)) if camel else df
