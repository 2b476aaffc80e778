"""Operator 10: toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into symbols: insult and threat words with weights, targets (whom the
clause is about), negations, verbs of reported speech and quotation marks. Small transducers
read the symbols of a clause side by side: one keeps whether a target is near, one whether a
negation governs what follows, one whether the clause reports another's speech. Their
composition, built lazily as states are met, sends the weight of each insult or threat to one
channel: plain, targeted, negated or reported, and threats with or without a target. Each channel
is an arc with a weight, and what a clause matches is the sum of its lexemes times their arcs.

A document scores by its clauses alone: by the sum and the greatest of what they match, and by
the share of clauses that match anything, put through a logistic function whose weights are never
negative. The arcs' weights keep an order that no data can turn round: a word thrown at somebody
counts for more than the word alone, and that for more than the word negated or quoted; a threat
at somebody for more than a threat.

What is learned, from a bounded sample of labelled rows: the weights of words and word stems
(log odds over the sample), the arcs' weights (among the choices in ARCS) and the logistic
function. Everything else runs over all rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable

from . import arrow

#: Bounds of the labelled sample (rows of each label) and of the learned lexicon.
TOXIC_ROWS, CLEAN_ROWS, ENTRIES = 4000, 6000, 20_000
LEAST_ROWS, LEAST_SHARE, LEAST_STEM = 6, 0.8, 5

# Fixed seed lists of the grammar, by symbol.
SEEDS = {
    "insult": "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile vermin filth connard salope idiote imbécile débile abruti ordure minable arschloch dummkopf trottel abschaum widerlich wertlos hurensohn idiota imbécil estúpido estúpida basura escoria asqueroso patético inútil",
    "threat": "kill murder strangle stab shoot tuer tuerai égorger töten umbringen erschießen matar mataré apuñalar",
    "target": "you your youre u he she they them him her tu toi vous ton ta tes il elle eux du dich dir ihr euch er sie tú usted ustedes vosotros él ella ellos",
    "negation": "not no never without isnt arent dont nobody pas jamais aucun sans nicht kein keine niemals nie ohne nunca jamás sin ningún tampoco",
    "report": "said says wrote told claimed called quoted dit disait écrit affirme sagte sagt schrieb nannte dijo dice escribió llamó",
}
SYMBOL = {w: kind for kind, words in SEEDS.items() for w in words.split() if kind not in ("insult", "threat")}
CHANNELS = ("plain", "targeted", "negated", "reported", "threat", "aimed_threat")
#: The arcs' weights that are tried; plain is 1. Each choice keeps the order that the grammar asks for.
ARCS = {"targeted": (1.25, 1.5, 2.0), "negated": (0.1, 0.2, 0.3), "reported": (0.1, 0.2, 0.3), "threat": (0.5, 1.0, 1.5)}
#: The greatest constant of the logistic function: a text that matches nothing gives no reason to reject it, however few rows were labelled.
CONSTANT = -2.0
AIMED = 1.5  # an aimed threat, as a multiple of a threat
#: Of a document: what its clauses match in each channel, the same of its strongest clause, and how many clauses match and are there.
FEATURES = (*CHANNELS, *(f"top_{c}" for c in CHANNELS), "matching", "clauses")
_TOKEN = re.compile(r"\w+|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n]")

# Each transducer maps (state, symbol) to the next state; the symbols not named keep or lower it.
SCOPE, REACH = 4, 4


def near_target(state: int, symbol: str) -> int:
    """How many more words a target stays near."""
    return REACH if symbol == "target" else max(state - 1, 0)


def negation(state: int, symbol: str) -> int:
    """How many more words a negation governs; a second one lifts it."""
    if symbol == "negation":
        return 0 if state else SCOPE
    return max(state - 1, 0)


def reported(state: int, symbol: str) -> int:
    """1 after a verb of speech, 2 inside the quotation marks."""
    if symbol == "quote":
        return 0 if state == 2 else 2
    return 1 if symbol == "report" and state != 2 else state


@functools.cache
def step(state: tuple[int, int, int], symbol: str) -> tuple[tuple[int, int, int], str | None]:
    """The composed transducer: the next state, and the channel that an insult or threat goes to."""
    target, negated, speech = state
    after = (near_target(target, symbol), negation(negated, symbol), reported(speech, symbol))
    if symbol not in ("insult", "threat"):
        return after, None
    if speech:
        return after, "reported"
    if negated:
        return after, "negated"
    if symbol == "threat":
        return after, "aimed_threat" if target else "threat"
    return after, "targeted" if target else "plain"


def arcs(targeted: float, negated: float, reported: float, threat: float) -> np.ndarray:
    """The weights of the channels."""
    return np.array([1.0, targeted, negated, reported, threat, AIMED * threat])


MIDDLE = arcs(*(choice[1] for choice in ARCS.values()))


def matched(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the logistic function sees of rows of FEATURES: the sum, the strongest clause, and the share of clauses that match."""
    n = len(CHANNELS)
    total, top = features[:, :n] @ weights, features[:, n : 2 * n] @ weights
    return np.column_stack((np.log1p(total), np.log1p(top), np.minimum(1.0, features[:, 2 * n] / features[:, 2 * n + 1])))


class Grammar:
    """The lexicon compiled into one automaton. lexicon: (entry, is a whole word, symbol, weight)."""

    def __init__(self, lexicon: list[tuple[str, bool, str, float]]):
        import ahocorasick

        self.whole = {e: (s, w) for e, whole, s, w in lexicon if whole}
        self.stems = {e: (s, w) for e, whole, s, w in lexicon if not whole}
        self.longest = max(map(len, self.stems), default=0)
        self.find = ahocorasick.Automaton()
        for entry in {*self.whole, *self.stems}:
            self.find.add_word(entry, len(entry))
        if len(self.find):
            self.find.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if found := self.whole.get(word):
            return found
        for n in range(min(len(word), self.longest), 0, -1):
            if found := self.stems.get(word[:n]):
                return found
        return SYMBOL.get(word, "word"), 0.0

    def clauses(self, text: str):
        """The sums by channel of each clause with a hit."""
        done = 0
        for end, size in self.find.iter(text) if len(self.find) and text else ():
            begin = end - size + 1
            if begin < done or begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                continue
            a = max((text.rfind(mark, done, begin) + 1 for mark in ".!?;:\n"), default=0) or done
            stop = _CLAUSE.search(text, end + 1)
            b = stop.start() if stop else len(text)
            state, found = (0, 0, 0), dict.fromkeys(CHANNELS, 0.0)
            tokens = [(m, self.symbol(m) if m[0].isalnum() else ("quote", 0.0)) for m in _TOKEN.findall(text, a, b)]
            for _, (symbol, weight) in self._ahead(tokens):
                state, channel = step(state, symbol)
                if channel:
                    found[channel] += weight
            if any(found.values()):
                yield [found[c] for c in CHANNELS]
            done = b

    def features(self, text: str | None) -> list[float]:
        """What FEATURES names. The strongest clause is chosen with the arcs' middle weights."""
        low = (text or "").lower()
        found = list(self.clauses(low))
        if not found:
            return [0.0] * (len(FEATURES) - 1) + [1.0 + len(_CLAUSE.findall(low))]
        top = max(found, key=lambda c: (float(np.dot(c, MIDDLE)), c))
        return [*(sum(x) for x in zip(*found)), *top, float(len(found)), 1.0 + len(_CLAUSE.findall(low))]

    @staticmethod
    def _ahead(tokens: list) -> list:
        """A target right after an insult counts as one before it: the pair is read turned round."""
        out = list(tokens)
        for i in range(len(out) - 1):
            if out[i][1][0] in ("insult", "threat") and out[i + 1][1][0] == "target":
                out[i], out[i + 1] = out[i + 1], out[i]
        return out


def entries(text: str) -> set[tuple[str, bool]]:
    """The words of a text, whole, and their beginnings of 4 to 8 characters."""
    words = set(re.findall(r"[^\W\d_]{3,30}", text.lower()))
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in range(4, min(8, len(w)) + 1)}


def held_out(doc_id):
    """Whether a row is never learned from; false for a null id, which no label belongs to."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of labelled rows outside the held-out quarter, chosen by a hash of the id,
    copies of a text as one, and how many labelled rows each of those rows stands for. Rows with unknown labels take no part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    most = {1: TOXIC_ROWS, 0: CLEAN_ROWS}
    picked = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in most.items()]
    ids = picked[0].union(picked[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # Copies would repeat a document's own words: one row for each whole text.
    rows = durable(texts.dropDuplicates(["doc_id"]).groupBy("toxic", F.sha2("text", 256).alias("o")).agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic"))
    fitted = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return rows, {t: max(1.0, sizes.get(t, 0) / max(fitted.get(t, 0), 1)) for t in most}


def learn_lexicon(rows: DataFrame) -> list[tuple[str, bool, str, float]]:
    """Words and stems that stand mostly in toxic rows, weighted by their log odds; with the seeds."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            n, t = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = entries(text)
                n.update(found)
                if toxic:
                    t.update(found)
            keys = list(n)
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.bool_()), pa.array([t[k] for k in part], pa.int64()), pa.array([n[k] for k in part], pa.int64())], names=["entry", "whole", "t", "n"])

    counts = rows.mapInArrow(count, "entry string, whole boolean, t long, n long").groupBy("entry", "whole").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    kept = counts.where((F.col("t") >= LEAST_ROWS) & (F.col("t") >= LEAST_SHARE * F.col("n"))).orderBy(F.desc("t"), "entry", "whole").limit(ENTRIES).collect()
    odds = lambda r: float(np.log((r.t + 0.5) / (r.n - r.t + 0.5)))
    words = {r.entry: r for r in kept if r.whole}
    threats = set(SEEDS["threat"].split())
    lexicon = [(w, True, "threat" if w in threats else "insult", odds(r)) for w, r in sorted(words.items())]
    # A stem only where it stands for more than one word: not for the words that are listed anyway.
    stems: list[str] = []
    for r in sorted((r for r in kept if not r.whole and len(r.entry) >= LEAST_STEM), key=lambda r: (len(r.entry), r.entry)):
        listed = max((words[w].t for w in words if w.startswith(r.entry)), default=0)
        if r.t >= listed + LEAST_ROWS and not any(r.entry.startswith(x) for x in stems):
            stems.append(r.entry)
            lexicon.append((r.entry, False, "insult", odds(r)))
    for kind in ("insult", "threat"):
        lexicon += [(w, True, kind, 2.0) for w in SEEDS[kind].split() if w not in words]
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the features, none below 0, and last the constant; and the loss. By Newton steps over the weights that are not held at 0."""
    x = np.column_stack((x, np.ones(len(x))))
    lam = np.full(x.shape[1], ridge)
    lam[-1] = 1e-3

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (lam * w * w).sum())

    w = np.full(x.shape[1], 0.1)
    w[-1] = CONSTANT - 1
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + lam * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(lam)
        free = (w > 0) | (g < 0)
        free[-1] = w[-1] < CONSTANT or g[-1] > 0
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        size = 1.0
        while True:
            new = w - size * move
            new[:-1] = np.maximum(new[:-1], 0)
            new[-1] = min(new[-1], CONSTANT)
            if loss(new) <= now or size < 1e-6:
                break
            size /= 2
        moved, w = np.abs(new - w).max(), new
        now = loss(w)
        if moved < 1e-8:
            break
    return w, now


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list, list[float], list[float]]:
    """(lexicon, arcs' weights, weights of the logistic function). Without labelled rows of both kinds, the seeds with fixed weights."""
    rows, stands_for = sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    lexicon = learn_lexicon(rows)

    import pyarrow as pa

    def features(batches):
        grammar = Grammar(lexicon)
        for batch in batches:
            made = np.array([grammar.features(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(made[:, k]) for k in range(len(FEATURES)))], names=["toxic", *FEATURES])

    found = rows.mapInArrow(features, "toxic int, " + ", ".join(f"{n} double" for n in FEATURES)).toPandas()
    y = found["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return lexicon, MIDDLE.tolist(), [1.0, 1.0, 0.0, -3.0]
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    order = np.lexsort(found.to_numpy(float).T)  # so that the sums do not depend on the rows' order
    seen, y, weight = found[list(FEATURES)].to_numpy(float)[order], y[order], weight[order] / weight.mean()
    tried = []
    for choice in itertools.product(*ARCS.values()):
        w, loss = fit_logistic(matched(seen, arcs(*choice)), y, weight)
        tried.append((round(loss, 6), choice, w.tolist()))
    _, choice, w = min(tried)
    return lexicon, arcs(*choice).tolist(), w


def score(docs: DataFrame, model: tuple[list, list[float], list[float]], text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, or only its columns named in keep, with a double column from 0 to 1. Null and empty texts get the score of a text without hits.
    Repeated rows each keep their row, a column named like the new one is replaced, and an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        lexicon, channels, weights = shared.value
        grammar, channels, w = Grammar(lexicon), np.array(channels), np.array(weights)

        def run(texts):
            x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            return [1 / (1 + np.exp(-np.clip(matched(x, channels) @ w[:-1] + w[-1], -30, 30)))]

        return run

    return arrow.append(docs, [text], f"`{out}` double", start, most=4 << 20, keep=keep)
