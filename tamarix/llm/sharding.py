"""Operator 1: shards by a two-pass external shuffle, in DataFrame operations alone.

The first pass scatters records into buckets by seeded hashes: a jump consistent hash of the
record's id names its shard, a second hash one of the shard's buckets. There are as many
buckets as the measured size and number of the records ask for, so that one fits a task's memory. The
second pass gathers one bucket at a time, puts it in a fixed order and gives it a Fisher-Yates
shuffle: a fold over its places that swaps each with a place before it, drawn by a hash of the seed,
the bucket and the place. A bucket's place in its shard follows from the counts of the buckets
before it, so slots have no gaps.

Ids and the number of shards alone decide the shard (law `key`). With one more shard, a jump
hash moves records only into the new one. The seed, the records and their number decide the slots: neither the number of
partitions nor a retry after a lost executor changes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import let

#: Bytes and records of a bucket, about.
BUCKET_BYTES, BUCKET_ROWS, SEED = 16 << 20, 512, 42
#: Bytes that a record counts beside its text.
OVERHEAD = 16


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def jumps(key: Column, shards: int, seed: int = SEED) -> Column:
    """A struct (now, grown): the shard of the key among `shards`, and among one more.

    A key's jumps are a rising row of shards that does not depend on how many there are; the
    last one below the number of shards is the key's. So one more shard can only take keys in.
    Each jump rises by one at least, so after as many jumps as shards every key has passed the last.
    """
    steps = F.sequence(F.lit(1), F.lit(shards + 1))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"))

    def step(state, i):
        chance = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), i), 11).cast("double") + 1) / float(1 << 53)
        at = F.least(F.floor((state["at"] + 1) / chance), F.lit(1 << 40)).cast("long")
        moved = let(at, lambda a: F.struct(a.alias("at"), F.when(a < shards, a).otherwise(state["now"]).alias("now"), F.when(a < shards + 1, a).otherwise(state["grown"]).alias("grown")))
        return F.when(state["at"] > shards, state).otherwise(moved)

    return F.aggregate(steps, begin, step)


def fisher_yates(rows: Column, *keys: Column) -> Column:
    """The array in an order drawn by hashes of the keys: from the last place to the second, each is swapped with one of the places up to it."""

    def step(order, i):
        def swap(j):
            parts = (F.slice(order, F.lit(1), j), F.array(order[i]), F.slice(order, j + 2, i - j - 1), F.array(order[j]), F.slice(order, i + 2, F.size(order)))
            return F.when(j == i, order).otherwise(F.flatten(F.array(*parts)))

        return let(F.pmod(F.xxhash64(*keys, i), i + 1).cast("int"), swap)

    places = F.transform(rows, lambda _, i: i)
    order = F.aggregate(F.reverse(F.slice(places, F.lit(2), F.size(rows))), places, step)
    return F.transform(order, lambda i: rows[i])


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of docs, with shard, grown_shard (int) and slot (long, from 0, without gaps in a shard).

    Null ids make one key. Null texts are kept. Records with equal id and text share a bucket;
    such repeated rows should fit a task's memory together. Columns of docs named like the three
    are replaced. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "grown_shard", "slot")]
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    long_ones = [f.name for f in docs.schema.fields if f.dataType.simpleString() in ("string", "binary") and f.name in kept]
    measured = docs.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in long_ones), F.lit(OVERHEAD)).cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    buckets = max(4, -(-(measured.bytes or 0) // (shards * bucket_bytes)), -(-measured.rows // (shards * bucket_rows)))
    scatter = F.xxhash64(key, F.lit(seed + 1), F.crc32(F.coalesce(body.cast("binary"), F.lit(b""))))
    where = docs.select(jumps(key, shards, seed).alias("j"), scatter.alias("h"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("record"))
    where = where.select(F.col("j.now").cast("int").alias("shard"), F.col("j.grown").cast("int").alias("grown_shard"), F.pmod("h", F.lit(buckets)).alias("bucket"), "h", "record")
    counts = where.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    gathered = where.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "grown_shard", "record"))).alias("rows"))
    shuffled = gathered.join(places.hint("merge"), ["shard", "bucket"]).select("shard", "before", fisher_yates(F.col("rows"), F.col("shard"), F.col("bucket"), F.lit(seed + 2)).alias("rows"))
    placed = shuffled.select("shard", "before", F.posexplode("rows").alias("at", "row"))
    return placed.select(*(F.col(f"row.record.`{c}`").alias(c) for c in kept), "shard", F.col("row.grown_shard").alias("grown_shard"), (F.col("before") + F.col("at")).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """The shards as folders of Parquet files, each file in slot order."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
