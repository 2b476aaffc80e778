"""Operator 8: near-duplicate vectors by spherical-cap filters.

A filter is a cap around a direction of a random product code: the space is turned at random
and cut into two halves of dimensions, each half has BOOK random directions, and every two of
them make a filter. A vector's filters are found by list decoding: the second half's scores are
sorted, and for each direction of the first half those that reach the threshold are a prefix.
A vector is put under all filters whose score exceeds the threshold, and under its LEAST best
ones in any case. Vectors meet by a shuffle on the filter and are verified in double precision.

A pair is counted only under the least filter that it shares, so counts are exact over the
pairs found and no pair is ever emitted: a filter passes on sums of links and a spanning forest.
Filters with many vectors are cut into chunks, and every two chunks are compared in a task of
their own. Equal vectors fold into one class beforehand and are not expanded.

At LEAST = 16 and an expected 20 filters a vector, 99.8 % of random pairs at a cosine of just
0.95 in 64 dimensions share a filter (measured); closer pairs do more often.
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable

from .components import components

BOOK, EXPECTED, LEAST, GROUP = 256, 20, 16, 1 << 11


@functools.cache
def code(dim: int, book: int, seed: int = 8):
    """The turn, the two books and the threshold for vectors of so many dimensions."""
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), 2):
        b = rng.normal(size=(book, len(part)))
        books.append(b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) / np.sqrt(2))
    return turn, books, NormalDist().inv_cdf(1 - EXPECTED / book**2) / np.sqrt(dim)


def decode(unit: np.ndarray, book: int = BOOK, least: int = LEAST) -> list[np.ndarray]:
    """The sorted filters of each unit vector."""
    turn, books, threshold = code(unit.shape[1], book)
    turned = unit @ turn
    half = books[0].shape[1]
    first, second = turned[:, :half] @ books[0].T, turned[:, half:] @ books[1].T
    order = np.argsort(-second, axis=1)
    out = []
    for a, b, o in zip(first, second, order):
        falling = b[o]
        want = np.searchsorted(-falling, a - threshold, side="right")
        at = np.flatnonzero(want)
        found = np.concatenate([i * book + o[: want[i]] for i in at.tolist()]) if len(at) else np.zeros(0, np.int64)
        if len(found) < least:
            # The best ones lie among the best `least` directions of each half.
            top = np.argsort(-a)[:least]
            score = (a[top][:, None] + falling[None, :least]).ravel()
            pick = np.argsort(-score, kind="stable")[:least]
            found = np.union1d(found, (top[:, None] * book + o[None, :least]).ravel()[pick])
        out.append(np.sort(found))
    return out


def _spread(book: int, least: int):
    """A function from batches of (rep, n, v) to a row for each filter of each vector."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            rep, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for k in range(0, len(rows), 512):
                    at = rows[k : k + 512]
                    v = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                    v = v / np.abs(v).max(axis=1, keepdims=True)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    filters = decode(v, book, least)
                    copies = np.array([len(f) for f in filters])
                    pick = pa.array(np.repeat(np.arange(len(at)), copies))
                    vectors = pa.array([x.tobytes() for x in v], pa.binary()).take(pick)
                    lists = pa.array([f.astype(np.int32).tobytes() for f in filters], pa.binary()).take(pick)
                    yield pa.RecordBatch.from_arrays([pa.array((dim << 32) + np.concatenate(filters)), pa.array(np.repeat(rep[at], copies)), pa.array(np.repeat(n[at], copies)), vectors, lists], names=["key", "rep", "n", "v", "filters"])

    return run


def compare(key: int, rep, n, v, filters, cosine: float, side=None):
    """(sums of links by row, forest edges) of the pairs first met under this filter. side: rows of unlike sides are compared, of like ones not."""
    v = np.stack([np.frombuffer(x, np.float64) for x in v])
    own = int(key) & 0xFFFFFFFF
    sums = np.zeros(len(v), np.int64)
    edges: list[tuple[int, int]] = []
    near = v @ v.T >= cosine
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    at = np.flatnonzero(near.any(axis=1))
    if len(at):
        near = near[np.ix_(at, at)]
        lists = [np.frombuffer(filters[i], np.int32) for i in at.tolist()]
        who = np.repeat(np.arange(len(at)), [len(x) for x in lists])
        what = np.concatenate(lists)
        who, what = who[what < own], what[what < own]
        order = np.argsort(what, kind="stable")
        for members in np.split(who[order], np.flatnonzero(np.diff(what[order])) + 1):
            if len(members) > 1:
                near[np.ix_(members, members)] = False
        sums[at] = near @ n[at]
        left = np.ones(len(at), bool)
        for i in range(len(at)):
            if left[i]:
                left[i] = False
                queue = [i]
                while queue:
                    x = queue.pop()
                    new = np.flatnonzero(near[x] & left)
                    left[new] = False
                    edges.extend((at[x], at[j]) for j in new.tolist())
                    queue.extend(new.tolist())
    return sums, edges


_OUT = "kind int, key long, a long, b long, n long, v binary, filters binary"


def _meet(cosine: float, cap: int, sided: bool):
    """A function over batches sorted by key (and pair of chunks): kind 0 sums of links, kind 1 edges, kind 2 rows of too large filters."""
    import pyarrow as pa

    def whole(columns):
        kinds, keys, a, b, n = [], [], [], [], []
        key, rep, weight, v, filters, pair, side = columns
        name = list(zip(key, pair))
        begin = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1]), len(name)]
        for s, e in zip(begin, begin[1:]):
            if e - s > 1:
                sides = np.array(side[s:e]) if sided and len(set(side[s:e])) > 1 else None
                reps = rep[s:e]
                sums, edges = compare(key[s], reps, np.array(weight[s:e]), v[s:e], filters[s:e], cosine, sides)
                hit = np.flatnonzero(sums)
                kinds += [0] * len(hit) + [1] * len(edges)
                a += [reps[i] for i in hit] + [reps[i] for i, _ in edges]
                b += [None] * len(hit) + [reps[j] for _, j in edges]
                n += [*sums[hit].tolist(), *[0] * len(edges)]
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(none, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary())], names=names)

    def large(columns):
        key, rep, weight, v, filters, *_ = columns
        return pa.RecordBatch.from_arrays([pa.array([2] * len(key), pa.int32()), pa.array(key, pa.int64()), pa.array(rep, pa.int64()), pa.array([None] * len(key), pa.int64()), pa.array(weight, pa.int64()), pa.array(v, pa.binary()), pa.array(filters, pa.binary())], names=names)

    names = ["kind", "key", "a", "b", "n", "v", "filters"]

    def run(batches):
        held: list[list] = [[] for _ in range(7)]
        spilling = None
        for batch in batches:
            for to, column in zip(held, batch.columns):
                to.extend(column.to_pylist())
            last = (held[0][-1], held[5][-1])
            cut = len(held[0])
            while cut and (held[0][cut - 1], held[5][cut - 1]) == last:
                cut -= 1
            head, held = [x[:cut] for x in held], [x[cut:] for x in held]
            if spilling is not None:
                end = next((i for i, k in enumerate(head[0]) if k != spilling), len(head[0]))
                if end:
                    yield large([x[:end] for x in head])
                head = [x[end:] for x in head]
                if held[0][0] != spilling:
                    spilling = None
            if head[0]:
                yield whole(head)
            if not sided and len(held[0]) > cap:
                spilling = held[0][0]
                yield large(held)
                held = [[] for _ in range(7)]
        if held[0]:
            yield large(held) if spilling == held[0][0] else whole(held)

    return run


def links(classes: DataFrame, cosine: float, cap: int = GROUP) -> DataFrame:
    """From classes (rep, n, v): rows of kind 0 with sums n of links of a, and of kind 1 with edges a, b."""
    parts = max(4, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = classes.mapInArrow(_spread(BOOK, LEAST), "key long, rep long, n long, v binary, filters binary")
    rows = rows.withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    met = durable(rows.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(_meet(cosine, cap, False), _OUT))
    hot = met.where("kind = 2").select("key", F.col("a").alias("rep"), "n", "v", "filters")
    out = met.where("kind < 2")
    if hot.isEmpty():
        return out
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / (cap // 2)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep", "v"), F.col("chunks")).cast("int")
    cut = hot.join(sizes, "key").withColumn("side", chunk)
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.least("side", j).cast("long") * F.col("chunks") + F.greatest("side", j)))
    spread = cut.withColumn("pair", F.explode(pair)).select("key", "rep", "n", "v", "filters", "pair", "side")
    again = spread.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "rep").mapInArrow(_meet(cosine, cap, True), _OUT)
    return out.unionByName(durable(again))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", cap: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row. Vectors that are null, zero, empty or hold null or
    non-finite components, and rows without an id, link with nothing; vectors of unlike lengths do not link.
    Repeated rows, and rows with one id and several vectors, each keep their row and count one by one; other columns are not
    carried on; an empty table gives an empty table."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(good)
    # Classes of equal vectors have numbers of their own, since an id may occur with several vectors.
    classes = durable(valid.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))).withColumn("rep", F.monotonically_increasing_id())
    met = links(classes.select("rep", "n", "v"), cosine, cap)
    sums = met.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    found = components(met.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(sums, "rep", "left").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = durable(named.select("v", "least", "component", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("v", "n_links", "component_id")
    linked = valid.join(named, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
