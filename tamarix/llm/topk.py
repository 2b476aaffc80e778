"""Operator 7: exact top-k search by columnar branch-and-bound.

Candidates are dealt into cells of a bounded number of vectors. A task holds one cell at a time,
in blocks in vertical layout (one contiguous row per dimension), longest vectors first, and query
blocks of a bounded size stream past it. For a block of queries and a block of candidates, scores
are accumulated a few dimensions at a time; after each step a candidate is given up where its
score so far plus the most that the remaining dimensions can add (the product of both remaining
norms) stays below the k-th best score that the query already has. Candidates that no query of
the block still wants are compacted away, and blocks whose longest vector is too short for all
queries are passed over whole.

Of each query a cell passes on its k best only. So a task holds one cell and one query block,
however many of either there are; work grows with queries times candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a query block (about) and vectors of a cell (about, at most), of a candidate block; dimensions a step.
QUERY_BLOCK, CELL, BLOCK, STEP = 64, 1 << 17, 4096, 8
#: Scores beyond a long's range count as its end.
LIMIT = 2**63 - 1


def integers(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, as longs. Vectors that are null, or hold null or non-finite components, are left out, and so are null ids. Products beyond a long's range count as its end."""
    good = F.col(f"`{vector}`").isNotNull() & ~F.exists(F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(good & F.col(f"`{vec_id}`").isNotNull())
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -LIMIT), np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], scores)), np.concatenate((self.id[q], ids))
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]


class Block:
    """Candidates of one dimension (dimensions by rows), with the norms of what follows each dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, np.ascontiguousarray(data)
        self.largest = float(np.abs(data.astype(float)).max(initial=0))
        self.rest = _rests(data)


def _rests(data: np.ndarray) -> np.ndarray:
    """Row d: the norms of the components from d on, taken a little too long rather than too short."""
    return np.sqrt(np.cumsum((data.astype(float) ** 2)[::-1], axis=0)[::-1]) * (1 + 1e-9)


def search_block(best: Best, qids: np.ndarray, queries: np.ndarray, block: Block, rest_q: np.ndarray | None = None) -> None:
    """Put a block of candidates to a block of queries (dimensions by rows)."""
    data, ids = block.data, block.ids
    dim = len(data)
    rest_q, rest_d = _rests(queries) if rest_q is None else rest_q, block.rest
    if dim and (rest_q[0] * rest_d[0].max(initial=0) + 1 < best.floor().astype(float)).all():
        return
    # Exact in doubles where every sum stays below 2 ** 53; in Python's integers otherwise.
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * block.largest * max(dim, 1)
    kind = np.float64 if largest < 2**53 else object
    q, d = queries.astype(kind), data.astype(kind)
    score = np.zeros((q.shape[1], d.shape[1]), kind)
    alive = np.arange(d.shape[1])
    for at in range(0, dim, STEP):
        if at and len(alive):
            bound = score.astype(float) + rest_q[at][:, None] * rest_d[at][alive][None, :]
            want = bound * (1 + 1e-9 * np.sign(bound)) + 1 >= best.floor()[:, None].astype(float)
            some = want.any(axis=0)
            if not some.all():
                alive, score = alive[some], score[:, some]
        score += q[at : at + STEP].T @ d[at : at + STEP][:, alive]
    floor = best.floor()
    for i in range(q.shape[1]):
        row = score[i] if kind is np.float64 else np.array([min(max(int(s), -LIMIT), LIMIT) for s in score[i]], object)
        hit = np.flatnonzero((row >= floor[i]) & (ids[alive] != qids[i])) if len(alive) else ()
        if len(hit):
            best.take(i, np.array([int(s) for s in row[hit]], np.int64), ids[alive[hit]])


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with the candidates but those of its own id (all if fewer), ties to the smaller id.

    Both tables have (vec_id long, v array of long). Vectors of another length than the query's
    take no part. A query id that occurs twice counts once, with its least vector; repeated
    candidates each count. Other columns are not carried on; an empty table on either side gives
    an empty one.
    """
    import pyarrow as pa

    asked = queries.select("vec_id", "v").groupBy("vec_id").agg(F.min("v").alias("v"))
    cells = cells or max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // CELL))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    everywhere = block.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.lit(1).alias("kind"), F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("v"))
    held = candidates.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(cells)).alias("cell"), F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), "v")

    def run(batches):
        own, open_rows, ready = None, [], {}

        def close():
            """The blocks of the cell's candidates, by dimension."""
            ids, lengths = np.concatenate([r[0] for r in open_rows]), np.concatenate([r[1] for r in open_rows])
            values = np.concatenate([r[2] for r in open_rows])
            open_rows.clear()
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == dim)
                data = values[(ends[some] - dim)[:, None] + np.arange(dim)]
                order = np.argsort(-(data.astype(float) ** 2).sum(axis=1), kind="stable")
                ready[dim] = [Block(ids[some[at]], data[at].T) for at in (order[i : i + BLOCK] for i in range(0, len(order), BLOCK))]

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            cell, kind = (columns[i].to_numpy(zero_copy_only=False) for i in (0, 1))
            begin = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cell)]
            for s, e in zip(begin, begin[1:]):
                if cell[s] != own:
                    own, ready = cell[s], {}
                    open_rows.clear()
                ids, v = columns[2].slice(s, e - s), columns[3].slice(s, e - s)
                if not kind[s]:
                    open_rows.append((ids.flatten().to_numpy(), v.value_lengths().to_numpy(), v.flatten().to_numpy()))
                    continue
                if open_rows:
                    close()
                for i in range(e - s):
                    qids = ids[i].values.to_numpy()
                    flat = v[i].values.to_numpy()
                    dim = len(flat) // len(qids)
                    q = np.ascontiguousarray(flat.reshape(len(qids), dim).T)
                    best, rest = Best(len(qids), k), _rests(q)
                    for some in ready.get(dim, ()):
                        search_block(best, qids, q, some, rest)
                    full = best.id != np.iinfo(np.int64).max
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, k)[full.ravel()]), pa.array(best.id[full]), pa.array(best.score[full])], names=["query_id", "vec_id", "score"])

    dealt = held.unionByName(everywhere).repartition(cells, "cell").sortWithinPartitions("cell", "kind")
    part = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
