"""Event streams: the input barrier of a dataflow node, change sets, and windowed counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def barrier(events: DataFrame, fields: list[str]) -> DataFrame:
    """(run, one column a field) for the runs whose fields all have a value: each field takes the first non-null one by seq. From events (run, field, value, seq)."""
    first = [F.min_by("value", F.when((F.col("field") == f) & F.col("value").isNotNull(), F.col("seq"))).alias(f) for f in fields]
    complete = [F.count_if((F.col("field") == f) & F.col("value").isNotNull()) > 0 for f in fields]
    found = events.where(F.col("field").isin(fields)).groupBy("run").agg(*first, F.array(*complete).alias("__all"))
    return found.where(F.forall("__all", lambda x: x)).drop("__all")


def barrier_stream(events: DataFrame, fields: list[str], value: str = "double") -> DataFrame:
    """The same over a stream (run, field, value, seq long): a run fires once, when its last field arrives. Within a batch the order is that of seq; fired runs keep a mark, so later events are dropped."""
    columns = ", ".join(f"`{f}` {value}" for f in fields)

    def step(key, frames, state):
        have, fired = ({}, False) if not state.exists else (dict(zip(fields, state.get[:-1])), state.get[-1])
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable") if not fired else pd.DataFrame()
        for row in rows.itertuples():
            if row.field in fields and have.get(row.field) is None and not pd.isna(row.value):
                have[row.field] = row.value
        full = not fired and all(have.get(f) is not None for f in fields)
        state.update((*(have.get(f) for f in fields), fired or full))
        if full:
            yield pd.DataFrame([[key[0], *(have[f] for f in fields)]], columns=["run", *fields])

    kind = events.schema["run"].dataType.simpleString()
    return events.groupBy("run").applyInPandasWithState(step, f"run {kind}, {columns}", f"{columns}, __fired boolean", "append", "NoTimeout")


def latest_state(changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last change of each key; repeated deliveries fold into one."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, "__last.*")


def deduplicated(changes: DataFrame, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """One row for each (reference_id, seq_id), in batch or stream; with a watermark, state is dropped behind it."""
    if watermark:
        return changes.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["reference_id", "seq_id"])
    return changes.dropDuplicates(["reference_id", "seq_id"])


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; zone-less times are read as UTC, since watermarks need instants."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, width, slide or width)).agg(F.count("*").alias("n"))


def fan_out(stream: DataFrame, *sinks):
    """A writer that hands each micro-batch, computed once, to every sink(batch, number)."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)
