"""Operator 6: personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans, which always stay. The field adds spans where the same or a
similar string stands elsewhere in the document without what the pattern wants, such as a
telephone number without its plus sign. A kind whose check a token has failed is barred there. Its nodes are the tokens with digits or an @ sign. Its
edges are the chain (neighbouring tokens of one line) and skips: all tokens of a document with
the same digits, the same eight final digits or the same letters are tied to one hub, and so are
the tokens of a number in spaced groups. All edges of a batch of documents pass messages at once
(loopy sum-product, damped) until they settle. A skip edge favours equal labels, and the label
of a hub with a base span among its tokens is known, so a sure label is two steps from all its
repetitions, however far off and however many they are.

All is fitted on a bounded sample of documents, with the base spans as labels: the node weights (a
softmax over the shape of a token and its neighbours), the chain's transitions, and through the
whole field, by its own messages, how strongly a skip edge binds: half of the known labels are
hidden, and the strength that gives them the greatest marginal likelihood is taken.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

KINDS = ("email", "ip", "card", "phone")
#: Fitting sample (documents and tokens), and the belief that adds a span.
SAMPLE_DOCS, SAMPLE_TOKENS, SURE = 2000, 50_000, 0.9
#: Messages of a document have settled when none moves by more; loopy messages need not, and stop after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 2000
#: Log potential for equal labels on a skip edge where nothing is fitted and the choices for the fit, for a node inside a base span, and against what is ruled out.
SKIP, SKIPS, CLAMP, FIRM = 4.0, (1.0, 2.0, 4.0, 6.0), 8.0, 1e6
#: Tokens and digits of a number in spaced groups at most.
GROUPS, DIGITS = 8, 19

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# Within a run of digits no later start can match where the first one does not, so only the first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str, failed: list | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and apart within a kind; matches that fail their check are dropped, not tried again. failed, if given, gets the dropped ones of addresses and cards."""
    out = [(0, s, e) for s, e in emails(text)]
    if _MARK.search(text) is None:
        return out
    if failed is not None:
        failed += [(1, *m.span()) for m in _IP.finditer(text)] + [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """The stretches without white space that hold a digit or an @, less the marks around them."""
    out, pos, n = [], 0, len(text)
    while m := _MARK.search(text, pos):
        s = e = m.start()
        while s > pos and not text[s - 1].isspace():
            s -= 1
        while e < n and not text[e].isspace():
            e += 1
        pos = e
        while s < e and not (text[s].isalnum() or text[s] == "+"):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if s < e:
            out.append((s, e))
    return out


N_SHAPES = 14


def shape(word: str) -> list[float]:
    """What a token looks like; the patterns' own tests are not among it."""
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    return [
        1.0, "@" in word, word.startswith("+"), min(word.count("."), 4) / 4, word.count(".") == 3 and not letters, min(word.count("-"), 4) / 4,
        digits == len(word), min(digits, 20) / 20, digits >= 7, digits >= 13, min(letters, 20) / 20, letters == 0, digits <= 3, 10 <= digits <= 12,
    ]


def keys(word: str) -> list[str]:
    """What similar tokens have in common: tokens with equal keys share a hub."""
    digits = _NOT_DIGIT.sub("", word)
    low = word.lower()
    out = []
    if "@" in word or len(digits) >= 5:
        out.append("w" + low)
    if len(digits) >= 7:
        out.append("d" + digits)
    if len(digits) >= 9:
        out.append("t" + digits[-8:])
    return out


def group_keys(digits: list[str]) -> list[str]:
    """The keys of a number written in spaced groups, as keys() gives them for one token; the final eight digits only where the first group is among them."""
    joined = "".join(digits)
    out = ["d" + joined] if 7 <= len(joined) <= DIGITS else []
    if 9 <= len(joined) <= DIGITS and len(joined) - len(digits[0]) < 8:
        out.append("t" + joined[-8:])
    return out


class Field:
    """The nodes, hubs and edges of a batch of documents. A skip edge is (hub, node); a hub is the set of the labels it can have, empty for all."""

    def __init__(self):
        self.shapes: list[list[float]] = []
        self.fixed: list[int] = []
        self.barred: list[int] = []
        self.spans: list[tuple[int, int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.hubs: list[set[int]] = []

    def add(self, number: int, text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]] | None = None) -> None:
        """Take in a document with its base spans and the matches that base_spans dropped; without those, they are looked for."""
        if failed is None:
            failed = []
            base_spans(text, failed)
        failed = sorted((s, e, k) for k, s, e in {*failed} - {*base})
        f = 0
        seen: dict[str, list[tuple[range, int]]] = {}
        groups: list[tuple[str, tuple | None]] = []  # digits and base span of the tokens of one run
        before = None
        by_start = sorted((s, e, k) for k, s, e in base)
        i = 0
        for s, e in tokens(text):
            node = len(self.spans)
            while i < len(by_start) and by_start[i][1] <= s:
                i += 1
            within = next(((a, b, k) for a, b, k in by_start[i : i + 4] if a < e and s < b), None)
            kind = within[2] + 1 if within else 0
            word = text[s:e]
            while f < len(failed) and failed[f][1] <= s:
                f += 1
            self.barred.append(next((k + 1 for a, b, k in failed[f : f + 2] if a < e and s < b and not (k == 2 and 16 <= len(word) <= 19 and word.isdecimal() and word.isascii() and luhn(word))), 0))
            self.shapes.append(shape(word))
            self.fixed.append(kind)
            self.spans.append((number, s, e))
            if before is not None and s - before[1] <= 2 and "\n" not in text[before[1] : s]:
                self.chain.append((before[0], node))
            else:
                groups = []
            before = (node, e)
            for key in keys(word):
                seen.setdefault(key, []).append((range(node, node + 1), kind))
            if any(c.isalpha() or c == "@" for c in word):
                groups = []
                continue
            groups = [*groups[1 - GROUPS :], (_NOT_DIGIT.sub("", word), within)]
            for n in range(2, len(groups) + 1):
                part = groups[-n:]
                if sum(len(d) for d, _ in part) > DIGITS:
                    break
                # The end of a base span is sure, its beginning may be shared by other numbers.
                sure = kind if within and e >= within[1] and all(w == within for _, w in part) else 0
                for key in group_keys([d for d, _ in part]):
                    seen.setdefault(key, []).append((range(node - n + 1, node + 1), sure))
        for key, places in seen.items():
            if len(places) > 1:
                known = {kind for _, kind in places if kind}
                if known or all(len(at) == 1 for at, _ in places):
                    self.skip += [(len(self.hubs), node) for node in sorted({node for at, _ in places for node in at})]
                    self.hubs.append(known)

    def inputs(self) -> np.ndarray:
        """The shapes of the nodes and of their neighbours on the chain."""
        own = np.array(self.shapes, float).reshape(-1, N_SHAPES)
        both = np.zeros_like(own)
        if self.chain:
            a, b = np.array(self.chain).T
            both[b] += own[a]
            both[a] += own[b]
        return np.hstack((own, both))

    def beliefs(self, weights: np.ndarray, transitions: np.ndarray, skip: float = SKIP, hidden: np.ndarray | None = None) -> np.ndarray:
        """The marginals of each node when the messages along all edges have settled. The labels of hidden nodes are not told, nor are those of hubs that a hidden node is tied to."""
        n, k = len(self.spans), len(KINDS) + 1
        unary = np.vstack((self.inputs() @ weights, np.zeros((len(self.hubs), k))))
        fixed = np.array(self.fixed, np.int64)
        untold: set[int] = set()
        if hidden is not None:
            fixed = np.where(hidden, 0, fixed)
            lost = set(np.flatnonzero(hidden).tolist())
            told = {hub for hub, node in self.skip if fixed[node]}
            untold = {hub for hub, node in self.skip if node in lost} - told
        sure = np.flatnonzero(fixed > 0)
        unary[sure, fixed[sure]] += CLAMP
        barred = np.array(self.barred, np.int64)
        ruled_out = np.flatnonzero(barred > 0)
        unary[ruled_out, barred[ruled_out]] -= FIRM
        for hub, known in enumerate(self.hubs):
            if known and hub not in untold:
                unary[n + hub, [label for label in range(k) if label not in known]] -= FIRM
        edges = np.array(self.chain + [(n + hub, node) for hub, node in self.skip], np.int64).reshape(-1, 2)
        if len(edges):
            m = len(edges)
            kind = np.arange(m) >= len(self.chain)
            tables = np.stack((transitions, skip * np.eye(k)))
            pair = np.concatenate((tables[kind * 1], tables[kind * 1].transpose(0, 2, 1)))
            source, to = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            number = np.array([s[0] for s in self.spans], np.int64)[edges[:, 1]]
            number = np.concatenate((number, number))
            message = np.zeros((2 * m, k))
            live = np.arange(2 * m)  # the edges of documents that have not settled
            for _ in range(ROUNDS):
                total = unary.copy()
                np.add.at(total, to[live], message[live])
                out = total[source[live]] - message[back[live]]
                new = np.logaddexp.reduce(out[:, :, None] + pair[live], axis=1)
                new -= new.max(axis=1, keepdims=True)
                moved = np.zeros(number.max() + 1)
                np.maximum.at(moved, number[live], np.abs(new - message[live]).max(axis=1))
                message[live] = 0.5 * message[live] + 0.5 * new
                live = live[moved[number[live]] >= TOLERANCE]
                if not len(live):
                    break
            np.add.at(unary, to, message)
        unary = unary[:n]
        unary -= unary.max(axis=1, keepdims=True) if n else 0
        p = np.exp(unary)
        return p / p.sum(axis=1, keepdims=True) if n else p


def added_spans(texts: list[str], bases: list[list], model, failed: list[list] | None = None) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to each text's base spans; they overlap none of those."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    field = Field()
    for i, (text, base) in enumerate(zip(texts, bases)):
        field.add(i, text, base, failed[i] if failed else None)
    if not field.spans:
        return out
    p = field.beliefs(*model)
    best = p.argmax(axis=1)
    fixed = np.array(field.fixed)
    linked = {b: a for a, b in field.chain}
    merged: dict[int, int] = {}
    for i in np.flatnonzero((best > 0) & (fixed == 0) & (p[np.arange(len(best)), best] >= SURE)).tolist():
        number, s, e = field.spans[i]
        before = linked.get(i)
        if before in merged and out[number][merged[before]][0] == best[i] - 1:
            kind, s, _ = out[number][merged[before]]
            out[number][merged[before]] = (kind, s, e)
            merged[i] = merged[before]
        else:
            merged[i] = len(out[number])
            out[number].append((int(best[i]) - 1, s, e))
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Node weights, chain transitions and the strength of skip edges from the base spans of a bounded sample of documents, chosen by a hash of the id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    ids = rows.select("i").where("i is not null").dropDuplicates().orderBy(F.xxhash64("i", F.lit(29)), "i").limit(SAMPLE_DOCS)
    sampled = rows.join(F.broadcast(ids), "i").where(F.col("t").rlike("[0-9@]")).groupBy("i").agg(F.min("t").alias("t")).orderBy("i")
    field = Field()
    for k, row in enumerate(sampled.toLocalIterator()):
        field.add(k, row.t, base_spans(row.t))
        if len(field.spans) > SAMPLE_TOKENS:
            break
    k = len(KINDS) + 1
    x, y = field.inputs(), np.array(field.fixed, np.int64)
    weights = np.zeros((2 * N_SHAPES, k))
    if len(y):
        truth = np.eye(k)[y]
        for _ in range(300):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= 1.0 * (x.T @ (p - truth) / len(y) + 1e-4 * weights)
    pairs = np.ones((k, k))
    for a, b in field.chain:
        pairs[y[a], y[b]] += 1
    transitions = np.log(pairs / pairs.sum()) - np.log(pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum() ** 2)
    transitions = np.clip(transitions, -3, 3)
    return weights, transitions, fit_skip(field, weights, transitions)


def fit_skip(field: Field, weights: np.ndarray, transitions: np.ndarray) -> float:
    """The strength of SKIPS under which the field gives the greatest likelihood to every second known label, hidden from it; the middle one where no hidden node has a hub whose other nodes tell something."""
    known = np.flatnonzero(np.array(field.fixed, np.int64) > 0)
    hidden = np.zeros(len(field.fixed), bool)
    hidden[known[::2]] = True
    if not any(hidden[node] for _, node in field.skip):
        return SKIP
    truth = np.array(field.fixed, np.int64)[hidden]
    likely = [np.log(np.maximum(field.beliefs(weights, transitions, skip, hidden)[hidden, truth], 1e-12)).sum() for skip in SKIPS]
    return SKIPS[int(np.argmax(np.round(likely, 6)))]


def _spans(texts: list[str], model) -> tuple[list[list], list[list]]:
    """(base spans, added spans) of each text."""
    failed: list[list] = [[] for _ in texts]
    bases = [base_spans(t, f) for t, f in zip(texts, failed)]
    return bases, added_spans(texts, bases, model, failed)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or only its columns named in keep, with base_spans and spans (strings kind:start:end, by kind as listed, then start, comma-joined; code points, end exclusive). Null texts are empty.
    Repeated rows each keep their row, columns named like the two are replaced, an empty table gives an empty table, and a text's spans do not hang on the texts beside it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        bases, more = _spans([t or "" for t in texts], shared.value)
        return [[_joined(b) for b in bases], [_joined(sorted(b + m)) for b, m in zip(bases, more)]]

    return arrow.append(docs, [text], "base_spans string, spans string", lambda: run, most=4 << 20, keep=keep)


def redact(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with each span of the text, overlapping ones as one, replaced by its kind in brackets. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(t, spans):
        out, done = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in spans):
            if s >= done:
                out += [t[done:s], f"[{KINDS[k].upper()}]"]
            done = max(done, e)
        return "".join((*out, t[done:]))

    def run(texts):
        full = [t or "" for t in texts]
        bases, more = _spans(full, shared.value)
        return [[t and one(t, b + m) for t, b, m in zip(texts, bases, more)]]

    return arrow.append(docs, [text], f"`{text}` string", lambda: run, most=4 << 20).select(*(f"`{c}`" for c in docs.columns))
