"""Events between publishers and subscribers over a folder of files, and graphs of dataflow nodes.

An event is (channel, seq, source, path, data): data is JSON. A publisher appends files to the channel's folder, which
every executor can see; each subscriber reads them as a stream of its own, with its own checkpoint, so all
of them get every event, and one that fails goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarix import errors

EVENT = "channel string, seq long, source string, path string, data string"


class Exchange:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, channel: str, events: DataFrame) -> None:
        """Append a batch of events (seq, source, path, data). seq orders the events of a channel; its publisher counts it."""
        made = events.select(F.lit(channel).alias("channel"), F.col("seq").cast("long"), "source", "path", "data")
        made.write.mode("append").parquet(f"{self.root}/{channel}")

    def history(self, channel: str) -> DataFrame:
        """All events so far, in order."""
        return self.spark.read.schema(EVENT).parquet(f"{self.root}/{channel}").orderBy("seq")

    def subscribe(self, channel: str, source: str | None = None, path: str | None = None) -> DataFrame:
        """A stream of the channel's events, of those of one source or below one path only if it is named."""
        path_ = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{channel}")
        path_.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path_)
        return self.spark.readStream.schema(EVENT).parquet(f"{self.root}/{channel}").where(matches(source, path))


def matches(source: str | None = None, path: str | None = None) -> Column:
    """The filter of a subscription."""
    kept = F.lit(True)
    if source is not None:
        kept &= F.col("source") == F.lit(source)
    if path is not None:
        kept &= F.coalesce(F.col("path").startswith(F.lit(path)), F.lit(False))
    return kept


def replayed(streams: DataFrame) -> DataFrame:
    """The events of several recorded streams (stream_no, seq, ...) as one, each stream whole before the next: (position from 1, ...).

    Positions come from the streams' counts and the place within a stream, so no task holds more than one stream's events."""
    from pyspark.sql import Window

    counts = streams.groupBy("stream_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stream_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("stream_no", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("stream_no").orderBy("seq"))
    return streams.withColumn("position", place).join(offsets, "stream_no").withColumn("position", F.col("position") + F.col("__before")).drop("__before")


def compiled(nodes: DataFrame, edges: DataFrame, known: list[str]) -> DataFrame:
    """The inputs of a graph's nodes: (node, type, field, from_node, from_key), one for each edge.

    nodes: id, type; edges: from_node, from_key, to_node, to_key, edge_no. A node without edges takes no part. Of two edges from
    one key to one node, the later holds. A type that is not known, or an edge to a node that is not there, is an error."""
    used = edges.select(F.col("from_node").alias("id")).union(edges.select("to_node")).distinct()
    missing = used.join(nodes, "id", "left_anti").limit(1).collect()
    if missing:
        raise errors.UndefinedTable(f"no node {missing[0].id}")
    strange = nodes.join(used, "id", "left_semi").where(~F.col("type").isin(known)).limit(1).collect()
    if strange:
        raise errors.SyntaxError_(f"unknown type {strange[0].type} of node {strange[0].id}")
    last = edges.groupBy("from_node", "from_key", "to_node").agg(F.max_by("to_key", "edge_no").alias("field"))
    return last.join(nodes.select(F.col("id").alias("to_node"), "type"), "to_node").select(F.col("to_node").alias("node"), "type", "field", "from_node", "from_key")


def routed(events: DataFrame, graph: DataFrame) -> DataFrame:
    """Events (run, from_node, from_key, value, seq), batch or stream, as inputs of the nodes that wait for them: (run as run and node, field, value, seq), what dataflow.barrier takes."""
    found = events.join(F.broadcast(graph.select("node", "field", "from_node", "from_key")), ["from_node", "from_key"])
    return found.select(F.struct("run", "node").alias("run"), "field", "value", "seq")


def joined(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, lateness: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Two streams joined on a key where the right event comes within an interval after the left one; both sides' state is dropped behind the watermarks. Right columns are named right_*."""
    a = left.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    b = right.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    near = (F.col(f"right_{ts}") >= F.col(ts)) & (F.col(f"right_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & near, how)


def to_end(df: DataFrame, sink, finished) -> None:
    """Hand the rows to sink(row) one after the other as they come, and call finished() once the last is taken; not if the query or the sink fails."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        sink(row)
    finished()
