"""Operator 2: best-fit packing of token sequences, two documents for one (best-two-fit).

A bin is filled greedily: the longest piece that fits, again and again. Then its smallest piece
is set against every two unpacked pieces: of those that together are longer than it and still
fit the gap with it gone, the longest two take its place. Pieces are dealt at random into
groups of a bounded number; each group is packed in one task. Within a group only the counts
of lengths matter, so a bin is repeated as often as the counts allow, and a group takes a few
thousand steps however many pieces it has. Each group leaves one or two bins part empty.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable

from . import arrow
from . import pretoken as P
from .tokens import special_strings, tokenizer

CAPACITY = 1024
GROUP = 1 << 14


def fill(counts: np.ndarray, capacity: int) -> list[int]:
    """The lengths of the next bin, from how many pieces of each length are left."""
    left = counts.copy()
    out, gap = [], capacity
    while gap > 0:
        some = np.flatnonzero(left[1 : gap + 1])
        if not len(some):
            break
        pick = int(some[-1]) + 1
        out.append(pick)
        left[pick] -= 1
        gap -= pick
    if gap and out:
        small = out[-1]
        room = gap + small
        sizes = np.flatnonzero(left[1 : room + 1]) + 1
        if len(sizes):
            # For each first piece, the longest second one that fits.
            second = np.searchsorted(sizes, room - sizes, side="right") - 1
            ok = second >= 0
            first, other = sizes[ok], sizes[second[ok]]
            twin = (first == other) & (left[first] < 2)
            lower = second[ok] - 1
            other = np.where(twin, np.where(lower >= 0, sizes[np.maximum(lower, 0)], 0), other)
            both = np.where(other > 0, first + other, 0)
            if len(both) and both.max() > small:
                best = int(both.argmax())
                out[-1:] = [int(first[best]), int(other[best])]
    return out


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece; lengths are 0 to capacity."""
    n = len(lengths)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    ends = np.cumsum(counts)
    used = ends - counts
    counts[0] = 0
    bin_id = 0
    while counts.any():
        pattern = np.array(fill(counts, capacity))
        sizes, need = np.unique(pattern, return_counts=True)
        times = int((counts[sizes] // need).min())
        place = 0
        for size, k in zip(sizes.tolist(), need.tolist()):
            rows = order[used[size] : used[size] + times * k]
            bins[rows] = bin_id + np.repeat(np.arange(times), k)
            places[rows] = place + np.tile(np.arange(k) * size, times)
            used[size] += times * k
            counts[size] -= times * k
            place += size * k
        bin_id += times
    return bins, places


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than capacity."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


_table: dict = {}


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, and the ids
    themselves (little-endian unsigned 32-bit numbers) if asked for. Null texts are empty and
    still give one piece with the end id. Repeated rows each give their pieces, null ids stay
    null, other columns are not carried on, and an empty table gives no pieces."""
    import pyarrow as pa

    def encode(words):
        made = tokenizer(path).encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, at = made.ids, np.cumsum(np.bincount(np.array(made.word_ids, np.int64), minlength=len(words))).tolist()
        return [ids[a:b] for a, b in zip([0, *at], at)]

    special = special_strings(path)

    def rows(texts):
        """The ids of each text, in order, by blocks; those of texts with special strings by the library."""
        table = _table.setdefault(path, P.WordTable())
        whole = [i for i, x in enumerate(texts) if "<" in x and any(s in x for s in special)]
        by_library = dict(zip(whole, tokenizer(path).encode_batch([texts[i] for i in whole], add_special_tokens=False))) if whole else {}
        held: list[np.ndarray] = []
        now = 0

        def upto(n):
            nonlocal held, now
            while now < n:
                yield np.array(by_library[now].ids, np.uint32) if now in by_library else np.concatenate(held or [np.zeros(0, np.uint32)])
                held, now = [], now + 1

        for block in P.blocks(["" if i in by_library else x for i, x in enumerate(texts)]):
            cp, bounds = P.code_points([x for _, x in block])
            starts, ends = P.split_bytes_bpe(cp, bounds)
            pieces = table.rows_for(cp, starts, ends, encode) if len(starts) else np.zeros(0, np.int32)
            ids, lengths = table.gather(pieces)
            at = np.concatenate(([0], np.cumsum(P.summed(lengths, starts, bounds)))).tolist()
            for (i, _), a, b in zip(block, at, at[1:]):
                yield from upto(i)
                held.append(ids[a:b])
        yield from upto(len(texts))

    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in arrow.small(batches, 4 << 20):
            owners = batch.column(0)
            out = ([], [], [], [], [], [])
            for i, ids in enumerate(rows([x or "" for x in batch.column(1).to_pylist()])):
                raw = ids.astype("<u4", copy=False).tobytes() + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    for to, x in zip(out, (i, k, s, n, zlib.crc32(part), part if with_ids else None)):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([owners.take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5]), *([pa.array(out[5], pa.binary())] if with_ids else [])], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    made = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.name for f in arrow.schema(made)]
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, made)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (with a long column length from 0 to capacity) with sequence_id and offset. An empty table gives an empty table.

    The input is first made durable, so that the random dealing is the same when a lost task is run again."""
    pieces = durable(pieces.drop("sequence_id", "offset"))
    groups = max(1, -(-pieces.count() // group))
    fields = pieces.dtypes
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf):
        bins, places = best_two_fit(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = (pdf["__group"].to_numpy(np.int64) << 32) + bins
        pdf["offset"] = places
        return pdf.drop(columns="__group")

    return dealt.groupBy("__group").applyInPandas(one, ", ".join(f"`{n}` {t}" for n, t in fields) + ", sequence_id long, offset long")
