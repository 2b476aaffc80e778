"""Arrow-batched columns: the one place where this subpackage hands rows to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(text: str) -> list[T.StructField]:
    return T._parse_datatype_string(text).fields


def small(batches, most: int = 8 << 20):
    """The batches cut into slices of about so many bytes; a larger row is a slice of its own."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def append(df: DataFrame, read: list[str], made: str, start: Callable, most: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with columns made by Python. start() is called once a task and gives a function from
    the lists of values of the columns read to the lists of values of the columns made (a DDL
    string). Columns of df that are named like a made one are replaced; with keep, only those
    columns of df are carried on. With most, f gets slices of about so many bytes, which bounds
    what it holds at a time."""
    import pyarrow as pa

    fields = schema(made)
    names = [f.name for f in fields]
    lower = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in lower]
    # A column that is read and carried on is sent to Python once.
    extra = [c for c in read if c not in kept]
    inputs = [f"__in{i}" for i in range(len(extra))]
    shown = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(a) for c, a in zip(extra, inputs)))
    places = [kept.index(c) if c in kept else len(kept) + extra.index(c) for c in read]
    out = T.StructType([*shown.schema.fields[: len(kept)], *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_types = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in small(batches, most) if most else batches:
            if batch.num_rows:
                values = f(*(batch.column(i).to_pylist() for i in places))
                made_now = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, arrow_types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *made_now], names=[*kept, *names])

    return shown.mapInArrow(run, out)
