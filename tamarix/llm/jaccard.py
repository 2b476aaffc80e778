"""Near copies: SimHash links, each verified by the Jaccard similarity of word runs, and an exact join for those SimHash misses.

First the method of operator 3: fingerprints of the runs' hashes, and links between those that
differ in 3 bits at most. A link stands only if the sets of runs are similar enough. A fingerprint
of 64 bits cannot find all: at a similarity of 0.8 some 10 of its bits differ. So what SimHash has
not joined meets once more, by a prefix-filtered join, which is exact.

Each text is the set of the hashes of its runs of words, in one fixed order of all hashes. Two
sets of similarity t share t * n hashes at least, n being the size of either, so they share one
among the first n - ceil(t * n) + 1 of each. Any order gives the same links. The order here is by
how many sets hold a hash, counted over all sets, rarest first: what no other set holds stands
first, and a set whose first hashes are all of that kind is similar to none. Most sets end there:
`counted` says of each how many of its hashes occur elsewhere, from 32 bits of each hash and its
bucket, so that it may see too many but never too few. The others are counted once more, exactly,
among themselves (`first_shared`); they alone go into the SimHash index and the join.

Texts with equal sets fold into one, and hashes at which the same sets meet are one meeting. In
rounds, while the pairs at meetings are more than the rows there, sets are compared with a few sets
of other components, at first with those they meet most often, then by a share of all pairs; at last
every other pair of a meeting whose components differ. Meetings within one component are left at each
round, so a large group of near copies costs no square of pairs. No pair is left out: two
large groups of sets that share many hashes and still are not similar are compared set by set,
and there the pairs do grow as the square.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarix.session import Scratch, durable

from . import arrow, simhash
from .components import components
from .simhash import shingle_hashes

WIDTH, LEAST = 5, 0.8
#: Bytes of text in a block of `counted`; its least number of buckets (a power of 2), and the bytes of text for each of more.
BLOCK, BUCKETS, BUCKET_TEXT = 1 << 20, 1 << 9, 16 << 20
#: Rows of a component at a meeting from which first links are drawn; then one in so many pairs between components is compared before all are.
DRAWN, SHARES = 8, (64, 8)
#: Sample for `frequent`'s order of the hashes: about so many documents, the count that makes a hash frequent, and how many of those are kept.
SAMPLE_DOCS, FREQUENT, ENTRIES = 8192, 4, 1 << 16


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the runs of `width` words, ascending."""
    return np.unique(np.array(shingle_hashes(text, width) if text else [], np.uint64).view(np.int64))


def frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; how often) of the frequent hashes of a sample of rows (h, text)."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            held = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            if held:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["shingle", "n"])

    share = SAMPLE_DOCS / max(rows.count(), 1)
    sampled = rows.where(F.pmod(F.xxhash64("h", F.lit(31)), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("text")
    counts = sampled.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(ENTRIES).toPandas().sort_values("shingle")
    return found["shingle"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefixes(rows: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int, least: float) -> DataFrame:
    """rows with fold (a hash of the set), n (its size), fp (the SimHash) and prefix (its first hashes in the order)."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def start():
        from xxhash import xxh64_intdigest

        keys, counts = shared.value

        def run(texts):
            folds, sizes, prints, firsts = [], [], [], []
            for text in texts:
                hashes = np.array(shingle_hashes(text, width) if text else [], np.uint64)
                prints.append(simhash.fingerprint_of(hashes))
                made = np.unique(hashes.view(np.int64))
                n = len(made)
                folds.append(xxh64_intdigest(made.tobytes(), 7) - (1 << 63))
                sizes.append(n)
                if n and len(keys):
                    at = np.minimum(np.searchsorted(keys, made), len(keys) - 1)
                    often = np.where(keys[at] == made, counts[at], 0)
                    made = made[np.argsort(often, kind="stable")]
                firsts.append(made[: n - int(np.ceil(least * n - 1e-9)) + 1].tolist() if n else [])
            return [folds, sizes, prints, firsts]

        return run

    return arrow.append(rows, ["text"], "fold long, n int, fp long, prefix array<long>", start)


def least_first(n, least: float):
    """How many of the first hashes of a set of n must be looked at: n - ceil(least * n) + 1."""
    return n - F.ceil(F.lit(least) * n - 1e-9) + 1


def counted(rows: DataFrame, width: int) -> DataFrame:
    """h, fold (a hash of the set), n (its size), fp (the SimHash) and shared (how many of its hashes occur in more than one row) of each of rows (h, text).

    Blocks of texts send their hashes to buckets, which tell each block the owners of those that
    occur again. Hashes count as equal if their bucket and their last 32 bits are.
    """
    import pyarrow as pa

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BUCKETS, size // BUCKET_TEXT).bit_length() - 1
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def binary(values, bounds):
        ends = pa.array((bounds * values.itemsize).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, ends.buffers()[1], pa.py_buffer(values)])

    def send(batches):
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        block = TaskContext.get().partitionId() << 32
        for batch in arrow.small(batches, BLOCK):
            if not batch.num_rows:
                continue
            sets, folds, prints = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = np.array(shingle_hashes(text, width) if text else [], np.uint64)
                prints.append(simhash.fingerprint_of(hashes))
                sets.append(np.unique(hashes.view(np.int64)))
                folds.append(xxh64_intdigest(sets[-1].tobytes(), 7) - (1 << 63))
            n = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets).view(np.uint64)
            bucket = (flat >> np.uint64(64 - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, low, owner = bucket[order], flat[order].astype(np.uint32), np.repeat(np.arange(len(n)), n)[order]
            begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            step = np.diff(owner, prepend=0)
            step[begin] = owner[begin]
            step = step.astype(np.uint8 if step.max(initial=0) < 256 else np.uint32)
            bounds = np.append(begin, len(bucket))
            told = np.concatenate((batch.column("h").to_numpy(), np.array(folds, np.int64), n, np.array(prints, np.int64)))
            # What is told of the block itself goes along in a row without hashes.
            buckets = pa.array(np.append(bucket[begin].astype(np.int64), -1 - (block & 0xFFFFFFFF)))
            rows_of = [binary(x, np.append(bounds, bounds[-1])) for x in (low, step)]
            yield pa.RecordBatch.from_arrays([buckets, pa.array(np.full(len(buckets), block)), *rows_of, pa.array([None] * len(begin) + [told.tobytes()], pa.binary())], names=["bucket", "block", "low", "step", "told"])
            block += 1

    def meet(batches):
        held, now = [], None

        def answer():
            lows = np.concatenate([low for _, low, _ in held])
            order = np.argsort(lows)
            equal = lows[order][1:] == lows[order][:-1]
            again = np.zeros(len(lows), bool)
            again[order[1:]] |= equal
            again[order[:-1]] |= equal
            at = np.cumsum([len(low) for _, low, _ in held])[:-1]
            owners = [np.cumsum(step.astype(np.uint32), dtype=np.uint32)[a].tobytes() for (_, _, step), a in zip(held, np.split(again, at))]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array(owners, pa.binary()), pa.nulls(len(held), pa.binary())], names=["block", "owners", "told"])

        for batch in batches:
            for bucket, block, low, step, told in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != now and held:
                    yield answer()
                    held.clear()
                now = bucket
                if told is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b""]), pa.array([told])], names=["block", "owners", "told"])
                else:
                    held.append((block, np.frombuffer(low, np.uint32), np.frombuffer(step, np.uint8 if len(step) < len(low) else np.uint32)))
        if held:
            yield answer()

    def tell(batches):
        now, told, owners = None, None, []

        def block_rows():
            h, fold, n, fp = told.reshape(4, -1)
            shared = np.bincount(np.concatenate(owners), minlength=len(h)) if owners else np.zeros(len(h), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, fold, n, fp, shared)], names=["h", "fold", "n", "fp", "shared"])

        for batch in batches:
            for block, own, info in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now and now is not None:
                    yield block_rows()
                    told, owners = None, []
                now = block
                if info is not None:
                    told = np.frombuffer(info, np.int64)
                else:
                    owners.append(np.frombuffer(own, np.uint32))
        if now is not None:
            yield block_rows()

    sent = rows.select("h", "text").mapInArrow(send, "bucket long, block long, low binary, step binary, told binary")
    met = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block long, owners binary, told binary")
    return met.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tell, "h long, fold long, n long, fp long, shared long")


def first_shared(sets: DataFrame, least: float) -> DataFrame:
    """id, n, alone (how many hashes no other set holds) and prefix (the shared ones among the first, rarest first) of those of sets (id, n, items) that can be similar to another."""
    index = sets.select("id", "n", F.explode("items").alias("shingle")).withColumn("often", F.count("*").over(Window.partitionBy("shingle")))
    held = index.where("often > 1").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    held = held.withColumn("alone", F.col("n") - F.size("s")).withColumn("most", least_first(F.col("n"), least) - F.col("alone")).where("most > 0")
    return held.select("id", "n", "alone", F.transform(F.slice("s", F.lit(1), F.col("most").cast("int")), lambda x: x["shingle"]).alias("prefix"))


def verified(held: Scratch, pairs: DataFrame, distinct: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids that are similar enough, of distinct (id, n, prefix) and sets (id, items); held."""

    def beside(pairs, sets, columns):
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
        return pairs

    # Of the hashes in common, those outside one of the prefixes lie in the rest of one of the two.
    close = beside(pairs, distinct, ["n", "prefix"])
    rest = F.greatest(*(F.col(f"n_{x}") - least_first(F.col(f"n_{x}"), least) for x in "ab"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + rest
    close = held.hold(close.where(most >= F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b"))
    both = beside(close, sets, ["items"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    found = held.hold(both.where(shared / (F.size("items_a") + F.size("items_b") - shared) >= F.lit(least)).select("a", "b"))
    held.drop(close)
    return found


def simhash_links(held: Scratch, distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids by operator 3's index: those with equal fingerprints in a star, and links between fingerprints."""
    some = distinct.where("n > 0").select("id", "fp")
    prints = durable(some.groupBy("fp").agg(F.min("id").alias("rep")))
    equal = some.join(prints, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = simhash.links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return held.hold(equal.union(links).distinct())


def meetings(distinct: DataFrame) -> DataFrame:
    """(meeting, id, n, at, times): the sets that share hashes of their prefixes. Hashes at which the very same sets meet are
    one meeting; at is a set's first place in it, after those of its column alone if it has that, and times counts the hashes."""
    index = distinct.select("id", "n", *(["alone"] if "alone" in distinct.columns else []), F.posexplode("prefix").alias("at", "shingle"))
    if "alone" in index.columns:
        index = index.select("id", "n", (F.col("at") + F.col("alone")).alias("at"), "shingle")
    same = Window.partitionBy("shingle")
    shared = index.withColumns({"size": F.count("*").over(same), "meeting": F.bit_xor(F.xxhash64("id")).over(same)}).where("size > 1")
    return shared.repartition("meeting").groupBy("meeting", "id").agg(F.first("n").alias("n"), F.min("at").alias("at"), F.count("*").alias("times"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, h (a hash of the text) and component of each row: equal for texts that a chain of
    pairs of similarity `least` or more joins. Texts without words are equal to each other."""
    with Scratch(docs.sparkSession) as held:
        return durable(_near_copies(held, docs, doc_id, text, width, least))


def _near_copies(held: Scratch, docs: DataFrame, doc_id: str, text: str, width: int, least: float) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_hash(text).alias("h"))
    made = held.hold(counted(rows, width))
    # One row for each set, so that the copies of a text are not carried on.
    every = made.groupBy("fold").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.max("shared").alias("shared"), F.count("*").alias("copies"))
    every = held.hold(every.withColumn("id", F.monotonically_increasing_id()))
    folds = held.hold(made.select("h", "fold").distinct())
    held.drop(made)
    # The hashes of a set that has copies all occur in more than one row.
    some = every.where("n > 0").where((F.col("copies") > 1) | (F.col("n") - F.col("shared") < least_first(F.col("n"), least)))
    texts = rows.select("h", "text").join(some.select("h", "id", "n", "fp"), "h").dropDuplicates(["id"])
    sets = held.hold(arrow.append(texts, ["text"], "items array<long>", lambda: lambda ts: [[shingle_set(t, width).tolist() for t in ts]], keep=["id", "n", "fp"]))
    distinct = held.hold(first_shared(sets, least).join(sets.select("id", "fp"), "id"))
    names = distinct.select("id", F.col("id").alias("component"))

    def apart(pairs):
        """pairs (a, b) of different components, with those."""
        for x in "ab":
            pairs = pairs.join(names.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x)
        return pairs.where("ca <> cb")

    def link(pairs):
        """The components after the similar ones of the pairs (a, b)."""
        found = verified(held, pairs, distinct, sets, least)
        joined = components(apart(found).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        return held.hold(names.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component")))

    def fits(one, other):
        """Whether sets that meet at these places can be similar, if they meet nowhere before."""
        n, m = F.col(f"{one}n"), F.col(f"{other}n")
        room = F.least(n - F.col(f"{one}at"), m - F.col(f"{other}at"))
        return (n >= F.lit(least) * m - 1e-9) & (m >= F.lit(least) * n - 1e-9) & (room >= F.lit(least / (1 + least)) * (n + m) - 1e-9)

    def mixed(rows):
        """Those of rows (meeting, id, ..) at whose meeting more than one component meets, with their components."""
        named = rows.join(names, "id")
        whole = Window.partitionBy("meeting")
        named = named.withColumns({"x": F.min("component").over(whole), "y": F.max("component").over(whole)})
        return held.hold(named.where("x <> y").drop("x", "y"))

    def few(left):
        """Whether the pairs at the meetings are no more than the rows there."""
        each = left.groupBy("meeting", "component").agg(F.count("*").alias("k")).groupBy("meeting").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("q"))
        rows_left, pairs_left = each.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("q")) / 2)).first()
        return (pairs_left or 0) <= (rows_left or 0)

    def near(left):
        """(a, b): of each set and the sets drawn for it at its meetings, the three that it meets most often. DRAWN rows of a component take part at a meeting; drawn are two of the component with the most rows, and the set before it."""
        rank = F.row_number().over(Window.partitionBy("meeting", "component").orderBy(F.xxhash64("id"), "id"))
        whole = Window.partitionBy("meeting")
        this = F.struct("id", "n", "at", "component")
        sized = left.withColumn("rank", rank).where(F.col("rank") <= DRAWN).withColumn("top", F.max(F.struct("rank", F.col("component").alias("c"))).over(whole))
        draw = lambda i: F.min(F.when(F.col("component") == F.col("top.c"), F.struct(F.xxhash64("id", F.lit(i)).alias("draw"), this.alias("s")))).over(whole)["s"]
        drawn = sized.withColumn("others", F.array(draw(0), draw(1), F.lag(this).over(whole.orderBy("n", "id"))))
        others = F.array_distinct(F.filter("others", lambda x: x["component"] != F.col("component")))
        found = drawn.select("id", "n", "at", "times", F.explode(others).alias("to")).where(fits("", "to."))
        best = found.groupBy("id", F.col("to.id").alias("to")).agg(F.sum("times").alias("times")).groupBy("id")
        best = best.agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "to")), asc=False), 1, 3).alias("s")).select("id", F.explode("s.to").alias("to"))
        return best.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()

    def across(left, share):
        """(a, b): one in `share` of the pairs that differ in component and can be similar; all of them for 1."""
        one, other = left.alias("p"), left.alias("q")
        on = (F.col("p.meeting") == F.col("q.meeting")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component")) & fits("p.", "q.")
        if share > 1:
            on &= F.pmod(F.xxhash64("p.id", "q.id"), F.lit(share)) == 0
        return one.join(other, on).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()

    done = simhash_links(held, distinct)
    names = link(done)
    shared = held.hold(meetings(distinct))
    left = mixed(shared)
    for share in (None, *SHARES, 1):
        if share == 1 or not few(left):
            fresh = held.hold((near(left) if share is None else across(left, share)).join(done, ["a", "b"], "left_anti"))
            done, names = done.union(fresh), link(fresh)
            if share != 1:
                left = mixed(left.drop("component"))
    named = every.select("fold", "id").join(names, "id", "left").select("fold", F.coalesce("component", "id").alias("component"))
    return rows.select("doc_id", "h").join(folds, "h").join(named, "fold").select("doc_id", "h", "component")


def text_hash(text: str = "text"):
    return F.xxhash64(F.col(f"`{text}`"))
