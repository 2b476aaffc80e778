"""Named data sources: rows given as JSON, SQL templates, and Python functions, run by name with parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarix import errors


class Registry:
    """Sources by name. execute(statement, positional, named) of a store's session, or anything like it, runs the SQL templates."""

    def __init__(self, spark: SparkSession, execute: Callable | None = None):
        self.spark, self.execute, self.sources = spark, execute, {}

    def json(self, name: str, text: str, schema: str | None = None) -> None:
        """A JSON array of objects."""
        rows = json.loads(text)
        if not isinstance(rows, list):
            raise errors.InvalidText("not a JSON array")
        self.sources[name] = lambda props: self.spark.createDataFrame(rows, schema) if rows or schema else self.spark.createDataFrame([], "data string")

    def sql(self, name: str, template: str) -> None:
        """A statement with {{ parameters }}, which are bound and never spliced."""
        self.sources[name] = lambda props: self.execute(template, (), props)

    def function(self, name: str, f: Callable) -> None:
        """f(props) gives a DataFrame, a pandas frame or a list of dictionaries."""

        def run(props):
            made = f(props)
            return made if isinstance(made, DataFrame) else self.spark.createDataFrame(made)

        self.sources[name] = run

    def mapped(self, name: str, source: str, f: Callable, schema: str) -> None:
        """f over each pandas frame of a batch of another source's rows, in Spark's workers."""

        def run(props):
            return self.run(source, props).mapInPandas(lambda frames: (f(frame) for frame in frames), schema)

        self.sources[name] = run

    def run(self, name: str, props: dict | None = None) -> DataFrame:
        if name not in self.sources:
            raise errors.UndefinedTable(name)
        return self.sources[name](props or {})


def to_split(df: DataFrame) -> str:
    """A result as JSON of columns, index and data, for clients; it must fit the driver, as a report does."""
    return df.toPandas().to_json(orient="split", date_format="iso")
