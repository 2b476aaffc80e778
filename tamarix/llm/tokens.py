"""Operator 4: token counts by a map-side two-tier lookup.

Tier one is a compact table, broadcast to all tasks, from frequent pre-tokens to their token
counts; its size is fixed by a parameter, and its words are those of a bounded sample of the
documents, chosen by a hash of the text. Tier two is a cache in each Python worker, also bounded, whose
misses the tokenizer library encodes. No pre-token is shuffled: the sample's documents are
gathered in a few tasks, each of which hands its most frequent words to the driver. Neither
tier changes a count, whatever the sample holds; they only save work.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from . import pretoken as P

FREQUENT = 1 << 16
PER_TASK = 1 << 14
#: Documents of the sample behind tier one, and the tasks that count its words.
SAMPLE, SAMPLE_TASKS = 1 << 12, 8


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lengths_of(path: str):
    """A function from distinct words to one-element runs that hold their numbers of tokens."""

    def lengths(words: list[str]) -> list[list[int]]:
        made = tokenizer(path).encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(made.word_ids, np.int64), minlength=len(words))[:, None].tolist()

    return lengths


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    """The strings that the library takes out of a text before it splits the rest."""
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


@functools.cache
def _stable():
    """Characters of scripts whose lower case and composition have been the same in all versions of Unicode for long."""
    import re

    return re.compile("[\x00-\u024f\u0384-\u0481\u048a-\u052f\u2000-\u2064\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


def normalized(path: str):
    """A function from a text to its normal form for the vocabulary at path, white space apart; None for a text with special strings, which the library must take whole."""
    import unicodedata

    special, library = special_strings(path), tokenizer(path).normalizer

    def normal(text: str) -> str | None:
        if "<" in text and any(x in text for x in special):
            return None
        if text.isascii():
            return text.lower()
        if _stable().fullmatch(text) and not ("\u03a3" in text or "\u0130" in text) and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return library.normalize_str(text)

    return normal


def frequent_words(docs: DataFrame, text: str, most: int, per_task: int, start, split) -> DataFrame:
    """(word, n): the words that docs hold most often, ties in the words' order. Each task counts all its words and passes on its per_task most frequent.
    start(), called once a task, gives a function from a text to its normal form, or None for one that is not counted."""
    import pyarrow as pa

    def count(batches):
        table, words, counts, normal = P.WordTable(1 << 18), [], np.zeros(1, np.int64), start()

        def flush():
            best = np.argsort(-counts[: len(words)], kind="stable")[:per_task]
            best = best[counts[best] > 1] if len(words) > per_task else best
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in best.tolist()], pa.string()), pa.array(counts[best], pa.int64())], names=["word", "n"])

        def take(new):
            words.extend(new)
            return [[0]] * len(new)

        for batch in arrow.small(batches, 2 << 20):
            texts = [y for x in batch.column(0).to_pylist() if x and (y := normal(x)) is not None]
            for block in P.blocks(texts):
                cp, bounds = P.code_points([x for _, x in block])
                starts, ends = split(cp, bounds)
                if table.size + len(starts) > table.most and table.size:
                    yield flush()
                    table.clear()
                    words.clear()
                    counts[:] = 0
                rows = table.rows_for(cp, starts, ends, take)
                if len(counts) < len(words):
                    counts = np.concatenate((counts, np.zeros(2 * len(words) - len(counts), np.int64)))
                counts[: len(words)] += np.bincount(rows, minlength=len(words))
        if words:
            yield flush()

    found = docs.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "word").limit(most)


def sampled(docs: DataFrame, text: str, most: int, tasks: int) -> DataFrame:
    """About `most` documents (at most twice as many, or all of a small table), chosen by a hash of the text, in so many partitions."""
    share = most / max(docs.count(), 1)
    chosen = F.pmod(F.xxhash64(F.col(f"`{text}`"), F.lit(23)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    # Copies of a text have one hash; together they count once.
    return docs.select(F.col(f"`{text}`")).where(chosen).distinct().limit(2 * most).repartition(tasks)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", frequent: int = FREQUENT, keep: list[str] | None = None) -> DataFrame:
    """docs, or only its columns named in keep, with a long column of the tokens of each whole text, as the tokenizer file at path gives them.

    Null and empty texts count 0. Texts with special strings go to the library whole, with its
    default treatment of them. Repeated rows each keep their row; a column named like the new
    one is replaced; an empty table gives an empty table.
    """
    found = frequent_words(sampled(docs, text, SAMPLE, SAMPLE_TASKS), text, frequent, frequent, lambda: normalized(path), P.split_word_bpe)
    words = [r.word for r in found.select("word").collect()]
    shared = docs.sparkSession.sparkContext.broadcast((words, lengths_of(path)(words) if words else []))

    def start():
        encode, normal = lengths_of(path), normalized(path)
        tiers = _worker_tiers(shared)

        def run(texts):
            out = np.zeros(len(texts), np.int64)
            plain, where = [], []
            for i, x in enumerate(texts):
                if x:
                    if (y := normal(x)) is None:
                        out[i] = len(tokenizer(path).encode(x, add_special_tokens=False).ids)
                    else:
                        plain.append(y)
                        where.append(i)
            at = np.array(where, np.int64)
            for block in P.blocks(plain):
                cp, bounds = P.code_points([x for _, x in block])
                starts, ends = P.split_word_bpe(cp, bounds)
                np.add.at(out, at[[i for i, _ in block]], P.summed(_lengths(tiers, cp, starts, ends, encode), starts, bounds))
            return [out]

        return run

    return arrow.append(docs, [text], f"`{out}` long", start, most=4 << 20, keep=keep)


_tiers: dict = {}


def _worker_tiers(shared):
    """The broadcast table and this worker's own cache; kept while the worker lives."""
    key = shared._path if hasattr(shared, "_path") else id(shared)
    if key not in _tiers:
        _tiers.clear()
        words, counts = shared.value
        table = P.WordTable(1 << max(10, len(words).bit_length()))
        table.load(words, counts)
        _tiers[key] = (table, P.WordTable(1 << 19))
    return _tiers[key]


def _lengths(tiers, cp, starts, ends, encode) -> np.ndarray:
    first, second = tiers
    rows = first.find(cp, starts, ends)
    found = rows >= 0
    out = np.zeros(len(rows), np.int64)
    out[found] = first.flat[first.offset[rows[found]]]
    lost = np.flatnonzero(~found)
    if len(lost):
        rows = second.rows_for(cp, starts[lost], ends[lost], encode)
        out[lost] = second.flat[second.offset[rows]]
    return out
