"""Operator 5: byte-level BPE encoding and decoding by folds of Spark's higher-order functions.

A word is a string with one symbol a token, at first one a byte. A fold (aggregate) over merges,
by rising rank, replaces each merge's pair of symbols by the symbol of the token that it makes,
from the left. That is what merging the leftmost pair of the least rank again and again comes to,
because a token always forms from the same two tokens, both of lower rank: tokens that lie side
by side and make up a token's bytes are the last state but one of these bytes by themselves.
merge_order checks the ranks themselves for this. The merges of a word are all tokens whose bytes
occur in it, found by numpy; one that never comes about replaces nothing.

For ranks that are not so ordered, a fold over a word's bytes merges, step by step, the adjacent
pair of the least rank, the leftmost one at ties, with the ranks of all pairs in a literal table.
That is a hash table without collisions laid out as two arrays, since looking a key up in a map
takes time in proportion to the map: the cell of a pair (a, b) is bases[a] xor b, and holds a
beside the pair's rank, so that a pair without a rank is told from the others. After a merge only
the two pairs beside it are looked up anew. Decoding maps ids to their binary pieces by a literal
array and concatenates them.

Words stay with their documents. The frequent words of a bounded sample are folded once and their
ids broadcast; a document brings along only the other words that it holds, each once, and these
are folded in its own row, unless an earlier row of the task has brought them within the last
RECENT. Words longer than LONG bytes, which the fold would take quadratic time for, are encoded by the tiktoken library in the same pass; no text leaves the fold as a whole.
The table of ids only saves work: every hit is compared with the word itself.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarix.session import durable

from . import arrow
from . import pretoken as P
from .folds import let
from .tokens import frequent_words, sampled

#: Bounds of the broadcast table (words) and of the sample behind it (documents, tasks); bytes of the longest word that is folded.
FREQUENT, SAMPLE, SAMPLE_TASKS, LONG = 1 << 16, 1 << 12, 8, 126
#: Rare words of a task that later rows of it may refer to.
RECENT = 1 << 18
#: Ids that no token has: one for the ends of a word, one for empty cells.
_END, _NONE = 65535, 65534
#: Cells of the table of pairs.
CELLS = 1 << 20


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def library(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bases, cells): cells[bases[a] ^ b] is a << 16 | rank for every pair (a, b) of ids that has a rank, and of no other pair."""
    table = ranks(path)
    by_first: dict[int, list[tuple[int, int]]] = {}
    for t, r in table.items():
        for i in range(1, len(t)):
            if t[:i] in table and t[i:] in table:
                by_first.setdefault(table[t[:i]], []).append((table[t[i:]], r))
    bases, cells, used = np.zeros(_END + 1, np.int64), np.full(CELLS, _NONE << 16, np.int64), np.zeros(CELLS, bool)
    draw = np.random.default_rng(5)
    # The first ids with the most pairs while there is room for them, each at the first base drawn where all its cells are free.
    for a, pairs in sorted(by_first.items(), key=lambda x: (-len(x[1]), x[0])):
        second, rank = np.array(pairs).T
        while True:
            tried = draw.integers(0, CELLS, 64 if len(pairs) < 2000 else 4)
            free = ~used[tried[:, None] ^ second].any(axis=1)
            if free.any():
                break
        base = int(tried[free.argmax()])
        used[base ^ second] = True
        bases[a], cells[base ^ second] = base, a << 16 | rank
    return bases, cells


@functools.cache
def merge_order(path: str) -> dict[int, tuple[int, int]] | None:
    """The two tokens that each token of several bytes forms from; those that no merges lead to have none. None if a token forms from one of no lower rank."""
    table = ranks(path)
    none = max(table.values()) + 1
    made = {}
    for t, r in table.items():
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            least = [table.get(a + b, none) for a, b in zip(parts, parts[1:])]
            if (best := min(least)) == none:
                break
            at = least.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            made[r] = (table[parts[0]], table[parts[1]])
            if max(made[r]) >= r:
                return None
    return made


@functools.cache
def symbols(path: str) -> list[str]:
    """The symbol of each id: a byte's is the character of its number, and the others' follow, surrogates left out."""
    table = ranks(path)
    found = [chr(256 + i + 0x800 * (256 + i >= 0xD800)) for i in range(max(table.values()) + 1)]
    for b in range(256):
        found[table[bytes([b])]] = chr(b)
    return found


def byte_ids(path: str) -> np.ndarray:
    return np.array([ranks(path)[bytes([b])] for b in range(256)], np.uint32)


def ids_of(singles: np.ndarray, text: str) -> np.ndarray:
    """The ids of a string of symbols; singles are byte_ids."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(code < 256, singles[np.minimum(code, 255)], code - np.uint32(256) - np.uint32(0x800) * (code >= 0xE000))


@functools.cache
def beginnings_of_tokens(path: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(base, shift, keys, values): an open-addressed table from the hashes of all beginnings of two bytes or more of tokens to the token's rank, or -1 where that is no token. Values of empty cells are -2."""
    tokens = sorted(t for t in ranks(path) if len(t) > 1)
    beginnings = {t[:i]: -1 for t in tokens for i in range(2, len(t) + 1)}
    beginnings.update((t, ranks(path)[t]) for t in tokens)
    draw = np.random.default_rng(7)
    lengths = np.fromiter(map(len, beginnings), np.int64, len(beginnings))
    flat, starts = np.frombuffer(b"".join(beginnings), np.uint8), np.cumsum(lengths) - lengths
    while True:
        base = int(draw.integers(1 << 62, 1 << 63)) * 2 + 1
        names = np.zeros(len(lengths), np.uint64)
        left = np.arange(len(lengths))
        for i in range(int(lengths.max(initial=0))):
            left = left[lengths[left] > i]
            names[left] = names[left] * np.uint64(base) + flat[starts[left] + i] + np.uint64(1)
        if len(np.unique(names)) == len(names):
            break
    bits = max(10, 1 + len(names).bit_length())
    keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
    ranked = np.fromiter(beginnings.values(), np.int32, len(names))
    at, left = _cell(names, 64 - bits), np.arange(len(names))
    while len(left):
        free = left[values[at[left]] == -2]
        cells, first = np.unique(at[free], return_index=True)
        keys[cells], values[cells] = names[free[first]], ranked[free[first]]
        left = left[keys[at[left]] != names[left]]
        at[left] = (at[left] + 1) & (len(keys) - 1)
    return base, 64 - bits, keys, values


def _cell(names: np.ndarray, shift: int) -> np.ndarray:
    return ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def merges_of(beginnings: tuple, words: list[bytes], most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of all tokens of two bytes or more that occur in each word, each once and rising, one word after the other, and how many each has.

    They are found by hashes, in runs of words of about so many bytes. Tokens have different hashes, so none is missed; bytes with the hash of a token at worst add a merge that replaces nothing."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    begin, found = 0, [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        found.append(_merges(*beginnings, words[begin:end]))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _merges(base: int, shift: int, keys: np.ndarray, values: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), lengths)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    at, names, size, found = np.arange(len(flat)), flat, 1, [np.zeros(0, np.int64)]
    while len(at):
        more = rest[at] > size
        at = at[more]
        names = names[more] * np.uint64(base) + flat[at + size]
        size += 1
        cell = _cell(names, shift)
        value = values[cell]
        astray = np.flatnonzero((keys[cell] != names) & (value != -2))
        while len(astray):
            cell[astray] = (cell[astray] + 1) & (len(keys) - 1)
            value[astray] = values[cell[astray]]
            astray = astray[(keys[cell[astray]] != names[astray]) & (value[astray] != -2)]
        token = value >= 0
        found.append(word[at[token]] << 32 | value[token])
        on = value > -2
        at, names = at[on], names[on]
    # Sorted in place, which is many times as fast as np.unique here.
    both = np.concatenate(found)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both & 0xFFFFFFFF).astype(np.int32), np.bincount(both >> 32, minlength=len(words))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def with_literal(df: DataFrame, path: str, name: str = "__ranks") -> DataFrame:
    """df with a column of the literal table: a scalar subquery, which Spark computes once and gives to each task as a literal of plain bytes."""
    import pyarrow as pa

    signs, order = symbols(path), merge_order(path)
    if order is None:
        bases, cells = pair_table(path)
        table = ranks(path)
        held = {"bases": [bases], "cells": [cells], "bytes": [np.array([table[bytes([b])] for b in range(256)], np.int64)]}
    else:
        held = {"pairs": [[signs[order[r][0]] + signs[order[r][1]] if r in order else "" for r in range(len(signs))]]}
    one = df.sparkSession.createDataFrame(pa.table({"symbols": [signs], **held}))
    return df.withColumn(name, one.select(F.struct("symbols", *held)).scalar())


def fold(words: Column, merges: Column, literal: Column, ordered: bool) -> Column:
    """The tokens (array of string, one symbol a token) of words (array of binary), whose merges are in an array beside them, as merges_of has them. An empty word has a list of ids there instead.

    literal is the column of with_literal and must be named only once in a select, so that the optimizer puts the table itself in its place.
    """

    def with_tables(signs, in_order):
        def word(w, m):
            return F.when(F.octet_length(w) == 0, F.array_join(F.transform(m, lambda i: signs[i]), "")).otherwise(in_order(F.decode(w, "ISO-8859-1"), m))

        return F.zip_with(words, merges, word)

    def by_order(t, signs):
        # A pair is found as bytes of UTF-8, which only match whole symbols.
        return let(t["pairs"], lambda pairs: with_tables(signs, lambda w, m: F.aggregate(m, w, lambda state, r: F.replace(state, pairs[r], signs[r]))))

    def by_pairs(t, signs):
        numbers = lambda w: F.transform(F.split(w, ""), lambda c: F.ascii(c))
        return least_pairs(t, lambda ids: with_tables(signs, lambda w, m: F.array_join(F.transform(ids(numbers(w)), lambda i: signs[i]), "")))

    return let(literal, lambda t: let(t["symbols"], lambda signs: (by_order if ordered else by_pairs)(t, signs)))


def least_pairs(t: Column, then) -> Column:
    """then(f) for a function f from a word's bytes (array of int) to its ids, which needs no order of the merges; t is the struct of with_literal.

    The fold's state is one array of numbers, rank << 23 | position << 16 | id, for the tokens so
    far: the rank is that of the pair with the next token, 65536 or more if there is none, and the
    position is that of the token's first byte. Its least element is the leftmost pair of the least rank.
    An id that no token has stands at either end, so that every pair has neighbours.
    """
    rest, place, no_rank = F.lit(1 << 20), 127 << 16, 1 << 39

    def ident(x):
        return x.bitwiseAND(_long(65535))

    def with_tables(bases, cells, singles):
        def rank(a, b):
            return cells[bases[a].bitwiseXOR(b)].bitwiseXOR(F.shiftleft(a, 16))

        def step(state, _):
            def merge(low):
                def beside(after):  # what stands after the pair's first token
                    def pair(n, new, before):  # n tokens stand before the one before the pair
                        left = F.shiftleft(rank(ident(before), new), 23).bitwiseOR(before.bitwiseAND(_long((1 << 23) - 1)))
                        merged = F.shiftleft(rank(new, ident(after[1])), 23).bitwiseOR(low.bitwiseAND(_long(place))).bitwiseOR(new)
                        return F.flatten(F.array(F.slice(state, F.lit(1), n), F.array(left, merged), F.slice(after, F.lit(2), rest)))

                    return let(F.size(state) - F.size(after) - 2, lambda n: let(F.shiftright(low, 23), lambda new: let(state[n], lambda before: pair(n, new, before))))

                rest_of = let(low.bitwiseAND(_long(place)), lambda own: F.filter(state, lambda x: x.bitwiseAND(_long(place)) > own))
                return F.when(low < _long(no_rank), let(rest_of, beside)).otherwise(state)

            return let(F.array_min(state), merge)

        def merged(b, ids):
            after = F.slice(F.flatten(F.array(ids, F.array(_long(_END)))), F.lit(2), rest)
            pairs = F.zip_with(ids, after, lambda x, y: F.shiftleft(rank(x, y), 23).bitwiseOR(x))
            placed = F.transform(pairs, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("bigint") + 1, 16)))
            first, last = F.array(_long(1 << 62 | _END)), F.array(_long(1 << 62 | place | _END))
            done = F.aggregate(F.slice(b, F.lit(2), rest), F.flatten(F.array(first, placed, last)), step)
            return let(done, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: ident(x).cast("int")))

        return then(lambda b: let(b, lambda b: let(F.transform(b, lambda x: singles[x]), lambda ids: merged(b, ids))))

    return let(t["bases"], lambda bases: let(t["cells"], lambda cells: let(t["bytes"], lambda singles: with_tables(bases, cells, singles))))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of a column of ids (array of int): their binary pieces, concatenated. Null ids give null, no ids an empty value; an id without a piece is an error."""
    import pyarrow as pa

    table = ranks(path)
    pieces: list[bytes | None] = [None] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    one = df.sparkSession.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.binary()))}))
    # A string of Spark is any bytes, and only strings can be joined from an array.
    known = df.withColumn("__pieces", one.select(F.col("pieces").cast("array<string>")).scalar())
    joined = let(F.col("__pieces"), lambda t: F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: t[i]), "")).cast("binary")
    return known.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()), joined.alias(out))


_tables: dict = {}


def _table(shared) -> P.WordTable:
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _tables:
        _tables.clear()
        words, bounds, flat = shared.value
        table = P.WordTable(1 << max(10, len(words).bit_length()))
        table.load(words.to_pylist(), [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())])
        _tables[key] = table
    return _tables[key]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", frequent: int = FREQUENT, keep: list[str] | None = None, memory: int = RECENT) -> DataFrame:
    """docs, or only its columns named in keep, with a column of ids (array of int) of each whole text.

    Null and empty texts get an empty array; repeated rows each keep their row; a column named
    like the new one is replaced; an empty table gives an empty table. A row's rare words are
    folded together, so a text's folded words must fit a task's memory, as the text does.
    """
    found = frequent_words(sampled(docs, text, SAMPLE, SAMPLE_TASKS), text, frequent, frequent, lambda: lambda x: x, P.split_bytes_bpe)
    words = durable(found.where(F.octet_length("word").between(1, LONG) & (F.col("n") > 1)))
    singles, beginnings = byte_ids(path), docs.sparkSession.sparkContext.broadcast(beginnings_of_tokens(path))
    ordered, made = merge_order(path) is not None, "__rest array<binary>, __merges array<array<int>>"

    def lists(values, lengths):
        import pyarrow as pa

        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values)

    def with_merges(words: list[str], lengths) -> list:
        """The columns made, for rows that bring along so many of the words."""
        import pyarrow as pa

        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        for i in long:
            raw[i] = b""
        ranked, n = merges_of(beginnings.value, raw) if ordered else (np.zeros(0, np.int32), np.zeros(len(raw), np.int64))
        if long:
            ids = [library(path).encode_ordinary(words[i]) for i in long]
            sizes = [len(x) for x in ids]
            ranked = np.insert(ranked, np.repeat((np.cumsum(n) - n)[long], sizes), np.concatenate(ids))
            n[long] = sizes
        return [lists(pa.array(raw, pa.binary()), lengths), lists(lists(pa.array(ranked, pa.int32()), n), lengths)]

    brought = arrow.append(words.repartition(SAMPLE_TASKS, "word"), ["word"], made, lambda: lambda ws: with_merges(ws, np.ones(len(ws), np.int64)))
    known = with_literal(brought, path).select("word", fold(F.col("__rest"), F.col("__merges"), F.col("__ranks"), ordered)[0].alias("tokens")).toArrow()
    runs = [ids_of(singles, x) for x in known.column("tokens").to_pylist()]
    # As Arrow, which takes no more memory in a worker than its bytes.
    content = known.column("word").combine_chunks(), np.cumsum([0, *map(len, runs)]), np.concatenate([np.zeros(0, np.uint32), *runs])
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def split():
        table = _table(shared)
        # The task's recent rare words with their numbers, in two dicts of half the memory, so that the older half goes at a time.
        seen: dict[str, int] = {}
        older: dict[str, int] = {}
        count = 0

        def run(texts):
            nonlocal count, seen, older
            codes: list = [[] for _ in texts]
            rest: list[str] = []
            brings = np.zeros(len(texts), np.int64)
            for block in P.blocks([x or "" for x in texts]):
                cp, bounds = P.code_points([x for _, x in block])
                starts, ends = P.split_bytes_bpe(cp, bounds)
                rows = table.find(cp, starts, ends)
                cuts = np.searchsorted(starts, bounds).tolist()
                for k, ((i, x), s, t) in enumerate(zip(block, cuts, cuts[1:])):
                    own, base = rows[s:t], int(bounds[k])
                    lost = np.flatnonzero(own < 0)
                    if len(lost):
                        new, before = [], len(rest)
                        for b, e in zip((starts[s + lost] - base).tolist(), (ends[s + lost] - base).tolist()):
                            word = x[b:e]
                            if (at := seen.get(word, older.get(word))) is None or at < count - memory:
                                if 2 * len(seen) >= memory:
                                    seen, older = {}, seen
                                at = seen[word] = count
                                count += 1
                                rest.append(word)
                            new.append(-1 - at)
                        own[lost] = new
                        brings[i] += len(rest) - before
                    codes[i].append(own)
            return [[np.concatenate(c) if len(c) > 1 else c[0] if c else c for c in codes], *with_merges(rest, brings)]

        return run

    def assemble(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = _table(shared)
        # The ids of the recent rare words, and the number of the first of them.
        recent, recent_length, first = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        for batch in arrow.small(batches, 2 << 20):
            codes, rest = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            per_doc = codes.value_lengths().to_numpy(zero_copy_only=False)
            own = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            words = rest.flatten()
            length = np.concatenate((recent_length, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)))
            flat = np.concatenate((recent, ids_of(singles, "".join(words.to_pylist()))))
            begin = np.cumsum(length) - length
            # A code below 0 names a rare word by its number in the task.
            mine = own < 0
            n, at = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            n[~mine], at[~mine] = table.length[own[~mine]], table.offset[own[~mine]]
            which = -1 - own[mine] - first
            n[mine], at[mine] = length[which], begin[which]
            ends = np.cumsum(n)
            where = P.spread(at, n, ends)
            from_doc = np.repeat(mine, n)
            ids = np.empty(len(where), np.int32)
            ids[~from_doc], ids[from_doc] = table.flat[where[~from_doc]], flat[where[from_doc]]
            doc_ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_doc)))]
            lists = pa.ListArray.from_arrays(pa.array(doc_ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], names=[*kept, out])
            if len(length) > memory:
                gone = len(length) - memory
                recent, recent_length, first = flat[begin[gone] :], length[gone:], first + gone
            else:
                recent, recent_length = flat, length

    parts = arrow.append(docs, [text], f"__codes array<int>, {made}", split, most=2 << 20, keep=keep)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    folded = with_literal(parts, path).select(*(F.col(f"`{c}`") for c in kept), "__codes", fold(F.col("__rest"), F.col("__merges"), F.col("__ranks"), ordered).alias("__rest"))
    return folded.mapInArrow(assemble, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))]))
