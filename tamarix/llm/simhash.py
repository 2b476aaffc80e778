"""Operator 3: SimHash near-duplicates by deletion variants of fingerprint segments.

A fingerprint of 64 bits is cut into 2 segments, so of two fingerprints that differ in 3 bits
at most, one segment differs in 1 bit at most. Each segment is indexed under its 32 variants
with one bit masked; such two fingerprints share a variant. Equal variants meet by a shuffle on
the variant, and every meeting is verified on all 64 bits. A variant that more fingerprints
share than a task should compare is cut again: within it the other segment is indexed the same
way by halves, and those by quarters, after which at most 2 ** 11 fingerprints can share all
masked parts. So each comparison group is bounded, and none is cut off.

Exact copies fold into one fingerprint before that. A group passes on a spanning forest of its
links, not every pair, which leaves the components as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable

from . import arrow
from .components import components

BITS = 3
GROUP = 1 << 11
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, width: int) -> list[int]:
    """The XXH64 (seed 42) of each run of `width` words; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return [xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of one text, of its uint64 hashes, as a signed long: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)[0])


def fingerprint_all(texts: list[str | None], width: int) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half the hashes."""
    votes = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def tally():
        if held:
            bits = np.unpackbits(np.array(held, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            begin = np.cumsum([0, *(n for _, n in owners[:-1])])
            votes[[i for i, _ in owners]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, width) if text else []
        sizes[i] = len(hashes)
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k : k + (1 << 16)]
            if len(held) + len(part) > 1 << 16:
                tally()
            held.extend(part)
            owners.append((i, len(part)))
            if k + (1 << 16) < len(hashes):
                tally()
    tally()
    return np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """docs, or only its columns named in keep, with a long column of fingerprint bits; texts that are null or without words get 0."""
    return arrow.append(docs, [text], f"`{out}` long", lambda: lambda texts: [fingerprint_all(texts, width)], most=4 << 20, keep=keep)


def variants(key, value, start: int, width: int):
    """An array of (key, part): the `width` bits of value from `start` on, each with one bit masked; key tells apart what stands above."""
    part = F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))
    return [F.struct(F.xxhash64(key, F.lit(start), F.lit(i), part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))).alias("key"), F.lit(start).alias("start")) for i in range(width)]


def _forest(bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints that differ in `most` bits at most."""
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most
    left = np.ones(len(bits), bool)
    out = []
    for i in range(len(bits)):
        if left[i]:
            left[i] = False
            queue = [i]
            while queue:
                at = queue.pop()
                new = np.flatnonzero(near[at] & left)
                left[new] = False
                out.extend((at, j) for j in new.tolist())
                queue.extend(new.tolist())
    return out


def _meet(group_cap: int, most: int):
    """A function over batches sorted by (key, fp): links (a, b), and members of too large groups as (a, b = fp, key)."""
    import pyarrow as pa

    def emit(key, fp, rep, start):
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = np.concatenate(([0], change))
        size = np.diff(np.concatenate((begin, [len(key)])))
        bits = fp.view(np.uint64)
        pairs = begin[size == 2]
        pairs = pairs[np.bitwise_count(bits[pairs] ^ bits[pairs + 1]) <= most]
        a, b = [rep[pairs]], [rep[pairs + 1]]
        for s, n in zip(begin[(size > 2) & (size <= group_cap)].tolist(), size[(size > 2) & (size <= group_cap)].tolist()):
            edges = np.array(_forest(bits[s : s + n], most), np.int64).reshape(-1, 2) + s
            a.append(rep[edges[:, 0]])
            b.append(rep[edges[:, 1]])
        large = np.repeat(size > group_cap, size)
        links = sum(map(len, a))
        hot = np.concatenate((np.zeros(links, bool), np.ones(int(large.sum()), bool)))
        empty = np.zeros(links, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((*a, rep[large]))), pa.array(np.concatenate((*b, fp[large]))), pa.array(np.concatenate((empty, key[large]))), pa.array(np.concatenate((empty, start[large]))), pa.array(hot)], names=["a", "b", "key", "start", "hot"])

    def large(held):
        """The rows of a group that is too large to be held, to be cut again."""
        key, fp, rep, start = held
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(fp), pa.array(key), pa.array(start), pa.array(np.ones(len(key), bool))], names=["a", "b", "key", "start", "hot"])

    def run(batches):
        held, passing = None, None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if passing is not None:
                n = int(np.searchsorted(now[0], passing, side="right"))
                if n:
                    yield large([x[:n] for x in now])
                    now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                passing = None
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = np.searchsorted(held[0], held[0][-1], side="left") if len(held[0]) else 0
            if cut:
                yield emit(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            if len(held[0]) > group_cap:
                yield large(held)
                held, passing = None, held[0][0]
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def links(distinct: DataFrame, most: int = BITS, group_cap: int = GROUP) -> DataFrame:
    """Links (a, b) between the reps of distinct (fp, rep) whose fingerprints differ in `most` (3 at most) bits; they keep the components whole."""
    if not 0 <= most <= BITS:
        raise ValueError("two segments find at most 3 differing bits")
    top = F.lit(0).cast("long")
    index = distinct.select("fp", "rep", F.explode(F.array(*variants(top, F.col("fp"), 0, 32), *variants(top, F.col("fp"), 32, 32))).alias("v"))
    out = None
    for level, width in enumerate((32, 16, 8)):
        rows = index.select("v.key", "fp", "rep", F.col("v.start").cast("long").alias("start"))
        parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key", "fp")
        cap = group_cap if level < 2 else 1 << 62
        met = durable(sorted_rows.mapInArrow(_meet(cap, most), "a long, b long, key long, start long, hot boolean"))
        found = met.where("not hot").select("a", "b").distinct()
        out = found if out is None else out.union(found)
        hot = met.where("hot").select(F.col("b").alias("fp"), F.col("a").alias("rep"), "key", "start")
        if level == 2 or hot.isEmpty():
            break
        # What is left of the fingerprint: at first the other segment, then the other half of that one.
        half, other = width // 2, F.when(F.col("start") % (2 * width) == 0, F.col("start") + width).otherwise(F.col("start") - width)
        choices = [F.when(other == o, F.array(*variants(F.col("key"), F.col("fp"), o, half), *variants(F.col("key"), F.col("fp"), o + half, half))) for o in range(0, 64, width)]
        index = hot.select("fp", "rep", F.explode(F.coalesce(*choices)).alias("v"))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = BITS, group_cap: int = GROUP) -> DataFrame:
    """doc_id, fp (bits as a long) and component_id of each row: the least doc_id reachable over
    fingerprints that differ in `most` bits at most. Rows with equal ids each keep their row. Rows
    without an id link like others, but name no component: one of such rows alone has none. Other
    columns are not carried on; an empty table gives an empty table."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = durable(fingerprints(rows, "text", width, "fp", keep=["doc_id"]))
    # The fingerprints themselves are the nodes, so those that only rows without an id have join others too.
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), most, group_cap))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
