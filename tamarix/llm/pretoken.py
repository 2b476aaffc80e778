"""Vectorised pre-tokenising: regular-expression splits as array operations over code points.

Both public vocabularies split a text into runs of letters, numbers and other marks. A batch
of texts becomes one array of code points; runs, attached spaces and contractions are found by
comparing neighbours. What is a letter, a number or white space is asked of the tokenizer
library's own pattern engine, so all of Unicode splits as the library splits it.

Words are looked up in tables by 64-bit hashes of their characters, and every hit is compared
character by character with the word that the table holds; words that share a hash get rows of
their own. So a hash only saves work and never decides what a word is.
"""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Characters of a block, and how many times as long a text may be before it is cut into parts.
CHARS, LONG_TEXT = 1 << 18, 4


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library's pattern engine has it."""
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        # With bytes as the only tokens, what the pattern matches comes back as it was.
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(engine.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in one array, and where each text starts (with the end at last)."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], ends))


def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray, fresh: np.ndarray) -> None:
    """Join 's 't 'm 'd 're 've 'll to their apostrophe where that starts a piece."""
    n = len(cp)
    at = np.flatnonzero((cp == 39) & start[:n])
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~fresh[at + 1]]
    if not len(at):
        return
    one = cp[at + 1]
    short = at[np.isin(one, [115, 116, 109, 100])]
    start[short + 1] = False
    start[short + 2] = True
    rest = at[at + 2 < n]
    rest = rest[~fresh[rest + 2]]
    a, b = cp[rest + 1], cp[rest + 2]
    long = rest[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]
    start[long + 1] = False
    start[long + 3] = True


def split_bytes_bpe(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the byte-level vocabulary (public_tokenizers.PATTERN)."""
    n = len(cp)
    kind = classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last white space before other characters stands alone, or joins them if it is a blank.
    head = np.flatnonzero(start[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
    start[head - 1] = True
    start[head[cp[head - 1] == 32]] = False
    _contractions(cp, kind, start, fresh)
    start |= fresh
    edges = np.flatnonzero(start)
    return edges[:-1], edges[1:]


def split_word_bpe(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the lower-case vocabulary; white space is dropped and each number character stands alone."""
    n = len(cp)
    kind = classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    start = fresh.copy()
    start[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    _contractions(cp, kind, start, fresh)
    start |= fresh
    edges = np.flatnonzero(start)
    keep = kind[edges[:-1]] != SPACE
    return edges[:-1][keep], edges[1:][keep]


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each piece's characters."""
    up, down = _pow(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_values()[cp] * up[: len(cp)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == 0] = 1
    return h


def spread(values: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For runs of these lengths, one after the other: the run's value plus the place within the run."""
    return np.repeat(values - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTable:
    """An open-addressed table from words to runs of small numbers, at most about `most` words long; when full it starts anew."""

    def __init__(self, most: int = 1 << 19):
        self.most = most
        self.mask = np.uint64(2 * most - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.rows = np.zeros(int(self.mask) + 1, np.int32)
        self.twins: dict[str, int] = {}  # words whose hash another word of the table has
        self.size, self.used, self.written = 0, 0, 0
        self.offset, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.word_offset, self.word_length, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def find(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """The row of each piece; -1 for a word that the table lacks, -2 for one whose hash another word has."""
        names = hashes(cp, starts, ends) if names is None else names
        at = (names & self.mask).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == names, self.rows[at], np.int32(-1))
        left = np.flatnonzero((seen != names) & (seen != 0))
        at, mask = at[left], int(self.mask)
        while len(left):
            at = (at + 1) & mask
            seen, want = self.keys[at], names[left]
            hit = seen == want
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (seen != 0)
            left, at = left[go], at[go]
        self._compare(out, cp, starts, ends)
        return out

    def _compare(self, rows: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Set the row to -2 (or a twin's) where the piece is not the word of its row."""
        at = np.flatnonzero(rows >= 0)
        mine, n = rows[at], (ends - starts)[at]
        alike = self.word_length[mine] == n
        odd = at[~alike]
        at, mine, n = at[alike], mine[alike], n[alike].astype(np.int64)
        to = np.cumsum(n)
        differ = np.flatnonzero(cp[spread(starts[at], n, to)] != self.chars[spread(self.word_offset[mine], n, to)])
        if len(differ):
            odd = np.concatenate((odd, at[np.unique(np.searchsorted(to, differ, side="right"))]))
        for i in odd.tolist():
            rows[i] = self.twins.get(cp[starts[i] : ends[i]].tobytes().decode("utf-32-le"), -2) if self.twins else -2

    def _append(self, words: list[str], runs: list) -> np.ndarray:
        """Rows for new words, without their hashes."""
        n = len(words)
        lengths = np.fromiter(map(len, runs), np.int32, n)
        sizes = np.fromiter(map(len, words), np.int32, n)
        total, chars = int(lengths.sum()), int(sizes.sum())
        for name, need in (("offset", self.size + n), ("length", self.size + n), ("word_offset", self.size + n), ("word_length", self.size + n), ("flat", self.used + total), ("chars", self.written + chars)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate((held, np.zeros(max(len(held), need - len(held)), held.dtype))))
        rows = slice(self.size, self.size + n)
        self.length[rows], self.word_length[rows] = lengths, sizes
        self.offset[rows] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.word_offset[rows] = self.written + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat[self.used : self.used + total] = np.fromiter((x for r in runs for x in r), np.uint32, total)
        self.chars[self.written : self.written + chars] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size, self.used, self.written = self.size + n, self.used + total, self.written + chars
        return np.arange(self.size - n, self.size, dtype=np.int32)

    def add(self, names: np.ndarray, words: list[str], runs: list) -> np.ndarray:
        """Take in new words of new, distinct hashes with their runs; their rows."""
        rows = self._append(words, runs)
        at, mask = (names & self.mask).astype(np.int64), int(self.mask)
        left = np.arange(len(names))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.rows[slots] = names[won], rows[won]
            left = left[self.keys[at[left]] != names[left]]
            at[left] = (at[left] + 1) & mask
        return rows

    def load(self, words: list[str], runs: list) -> None:
        """Take in distinct words."""
        if words:
            cp, bounds = code_points(words)
            names, first = np.unique(hashes(cp, bounds[:-1], bounds[1:]), return_index=True)
            self.add(names, [words[i] for i in first.tolist()], [runs[i] for i in first.tolist()])
            for i in sorted(set(range(len(words))) - set(first.tolist())):
                self.twins[words[i]] = int(self._append([words[i]], [runs[i]])[0])

    def rows_for(self, cp, starts, ends, encode) -> np.ndarray:
        """The row of each piece; encode(list of words) gives the runs of words met for the first time, each once."""
        names = hashes(cp, starts, ends)
        rows = self.find(cp, starts, ends, names)
        lost = np.flatnonzero(rows == -1)
        if len(lost):
            new, first, back = np.unique(names[lost], return_index=True, return_inverse=True)
            if self.size + len(new) > self.most and self.size:
                self.clear()
                return self.rows_for(cp, starts, ends, encode)
            pick = lost[first]
            words = [cp[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[pick].tolist(), ends[pick].tolist())]
            made = self.add(new, words, encode(words))[back]
            self._compare(made, cp, starts[lost], ends[lost])
            rows[lost] = made
        for i in np.flatnonzero(rows == -2).tolist():
            word = cp[starts[i] : ends[i]].tobytes().decode("utf-32-le")
            if word not in self.twins:
                self.twins[word] = int(self._append([word], encode([word]))[0])
            rows[i] = self.twins[word]
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the rows, one after the other, and the length of each."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths, dtype=np.int64)
        return self.flat[spread(self.offset[rows], lengths, ends)], lengths


def parts(text: str, chars: int):
    """Parts of a text of at least so many characters, cut before blanks that follow other characters than white space: no piece of either vocabulary crosses such a place."""
    begin, n, kind = 0, len(text), classes()
    while begin < n:
        cut = text.find(" ", begin + chars)
        while cut > 0 and kind[ord(text[cut - 1])] == SPACE:
            cut = text.find(" ", cut + 1)
        cut = cut if cut > 0 else n
        yield text[begin:cut]
        begin = cut


def blocks(texts: list[str], chars: int = CHARS):
    """Lists of (number of the text, part of it), in order, with about so many characters each; only a text LONG_TEXT times as long has several parts."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in (text,) if len(text) <= LONG_TEXT * chars else parts(text, chars):
            if size and size + len(part) > chars:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield held


def summed(values: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of pieces by the text that holds them."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    at = np.searchsorted(starts, bounds)
    return sums[at[1:]] - sums[at[:-1]]
