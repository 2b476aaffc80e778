"""Queries against SQLite files as a Spark data source, read-only.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").options(path=..., query=..., params='[1]', camelCase="true").load()

Every executor must see the file. With partitionColumn, lowerBound, upperBound and numPartitions
the query is read in ranges of that integer column; the outer ranges are open and nulls go to the first.
"""

from __future__ import annotations

import json
import re
import sqlite3
from contextlib import closing

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType(), str: T.StringType()}


def camel_case(name: str) -> str:
    first, *rest = re.split(r"[_\s]+", name.strip("_ ")) or [name]
    return first[:1].lower() + first[1:] + "".join(w[:1].upper() + w[1:] for w in rest)


def _connect(path: str):
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


class Range(InputPartition):
    def __init__(self, condition: str):
        self.condition = condition


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        """Types are those of the first 1,000 rows' values (integers and reals mixed: double; other mixtures, or nulls only: string); a schema given by the reader comes before them."""
        with _connect(self.options["path"]) as c:
            rows = c.execute(self.options["query"], json.loads(self.options.get("params", "[]")))
            names, seen = [d[0] for d in rows.description], [set() for _ in rows.description]
            for row in rows.fetchmany(1000):
                for kinds, value in zip(seen, row):
                    kinds |= {type(value)} - {type(None)}
        if self.options.get("camelcase", self.options.get("camelCase", "false")) == "true":
            names = [camel_case(n) for n in names]
        kinds = [T.DoubleType() if k == {int, float} else _TYPES[next(iter(k))] if len(k) == 1 else T.StringType() for k in seen]
        return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options = {k.lower(): v for k, v in options.items()}
        self.schema = schema

    def partitions(self) -> list[Range]:
        if "partitioncolumn" not in self.options:
            return [Range("1")]
        column, n = '"' + self.options["partitioncolumn"].replace('"', '""') + '"', int(self.options["numpartitions"])
        low, high = int(self.options["lowerbound"]), int(self.options["upperbound"])
        cuts = sorted({low + (high - low) * k // n for k in range(1, n)})
        if not cuts:
            return [Range("1")]
        inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
        return [Range(c) for c in (f"({column} < {cuts[0]} OR {column} IS NULL)", *inner, f"{column} >= {cuts[-1]}")]

    def read(self, partition: Range):
        casts = [{"string": str, "double": float}.get(f.dataType.simpleString(), lambda x: x) for f in self.schema]
        with _connect(self.options["path"]) as c:
            for row in c.execute(f"SELECT * FROM ({self.options['query']}) WHERE {partition.condition}", json.loads(self.options.get("params", "[]"))):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts))
