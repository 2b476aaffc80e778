"""Each operator against a brute-force version, and on the edge cases of edge_docs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarix.llm import bpe, capfilter, components, packing, pii, pretoken, sharding, simhash, tokens, topk, toxicity, urls

BYTES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def test_split_equals_the_library():
    bpe_library = Tokenizer.from_file(BYTES).pre_tokenizer
    rng = random.Random(1)
    marks = list("ab'sté  \n\t.,!?12½-_²'’“ñßΣд中한 ") + ["'ll", "'re", " 's", "\u00a0", "\u2003", "\x1c", "\x85"]
    for _ in range(1500):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 25)))
        cp, bounds = pretoken.code_points([text])
        starts, ends = pretoken.split_bytes_bpe(cp, bounds)
        assert [text[s:e] for s, e in zip(starts, ends)] == [text[s:e] for _, (s, e) in bpe_library.pre_tokenize_str(text)], repr(text)


def test_sharding(spark, edge_docs):
    got = sharding.shard(edge_docs, 4).collect()
    assert len(got) == edge_docs.count()
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 8}) == 1
    many = spark.range(4000).select(sharding.jumps(F.col("id"), 10).alias("j")).select("j.*").toPandas()
    assert many.groupby("now").size().between(320, 480).all() and (many.now != many.grown).sum() < 500
    assert set(many.grown[many.now != many.grown]) == {10}
    again = sharding.shard(edge_docs, 4).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in sharding.shard(edge_docs.repartition(3), 4).select("doc_id", "text", "shard", "slot").collect())
    assert sharding.shard(edge_docs.limit(0), 4).count() == 0


def test_packing(edge_docs):
    library = Tokenizer.from_file(BYTES)
    docs = edge_docs
    got = packing.pack(packing.token_pieces(docs, BYTES, with_ids=True)).toPandas()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    key = lambda i: None if i is None or i != i else int(i)
    for r in got.itertuples():
        assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts[key(r.doc_id)])
    assert got.length.sum() == sum(len(t) for same in texts.values() for t in same)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 1024
    assert packing.pack(packing.token_pieces(docs.limit(0), BYTES)).count() == 0


def test_two_take_the_place_of_the_smallest():
    # Greedy takes 6 + 3 and leaves 1; two pieces of 2 fit the gap of 4 better than the 3.
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.fill(counts, 10) == [6, 2, 2]
    lengths = np.random.default_rng(3).integers(1, 600, 5000)
    bins, places = packing.best_two_fit(lengths, 1024)
    assert bins.max() + 1 <= lengths.sum() / 1024 * 1.01 + 1
    assert max(np.bincount(bins, lengths)) <= 1024


def test_simhash(spark, edge_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    fps = [(r.doc_id, np.uint64(np.int64(r.fp))) for r in got]
    group = {i: {i} for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if np.bitwise_count(fps[i][1] ^ fps[j][1]) <= 3 and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    for i, r in enumerate(got):
        ids = [fps[k][0] for k in group[i] if fps[k][0] is not None]
        assert by[(r.doc_id, r.fp)] == min(ids, default=None)
    assert by[(4, 0)] == 4 and simhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_large_groups_are_cut_not_capped(spark):
    rng = np.random.default_rng(2)
    near = {int(np.uint64(99) ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 2, False).astype(np.uint64))) for _ in range(400)}
    rows = [(int(np.int64(np.uint64(v))), i) for i, v in enumerate(sorted(near | {int(x) for x in rng.integers(0, 2**63, 200)}))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    results = [sorted(map(tuple, components.components(simhash.links(df, group_cap=cap)).collect())) for cap in (2048, 6)]
    assert results[0] == results[1] and len(results[0]) >= 0.95 * len(near)


def test_token_counts(edge_docs):
    library = Tokenizer.from_file(WORDS)
    for frequent in (1 << 16, 2):
        for r in tokens.count_tokens(edge_docs, WORDS, frequent=frequent).collect():
            assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert tokens.count_tokens(edge_docs.limit(0), WORDS).count() == 0


def test_bpe_round_trip(edge_docs):
    library = bpe.library(RANKS)
    coded = bpe.encode(edge_docs, RANKS, frequent=16)
    for r in bpe.decode(coded, RANKS, out="back").collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()


def test_personal_data(edge_docs):
    text = "a.b@c.org, x@y z@w.de 10.0.0.1 1.2.3.999 +49 (171) 555-0100, 4111 1111 1111 1111 and 4111111111111112"
    got = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert got == [("email", "a.b@c.org"), ("email", "z@w.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (171) 555-0100")]
    model = pii.fit(edge_docs)
    for r in pii.find(edge_docs, model).collect():
        base = {x for x in r.base_spans.split(",") if x}
        assert base <= {x for x in r.spans.split(",") if x}
    assert pii.find(edge_docs.limit(0), model).count() == 0
    redacted = {r.doc_id: r.text for r in pii.redact(edge_docs, model).where("doc_id in (5, 9)").collect()}
    assert redacted[5] is None and "[CARD]" in redacted[9]


def test_skip_edges_carry_labels():
    weights, transitions = np.zeros((2 * pii.N_SHAPES, 5)), np.zeros((5, 5))
    weights[0, 0] = 1.0  # without the skip edge, no token is personal data
    text = "call +4917155501234 now, or later on 4917155501234; not 7777"
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], (weights, transitions))[0]
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in added] == [("phone", "4917155501234")]


def brute_top(vectors, queries, k):
    out = {}
    for q in queries:
        scored = [(-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_exact_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=16), 2)]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 16), (302, [None] + [0.0] * 15), (303, rows[5][1]), (304, rows[5][1]), (305, [1e12] * 16), (306, [0.0] * 16)]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    vectors = {r.vec_id: r.v for r in df.collect()}
    assert set(vectors) == {*range(300), 303, 304, 305, 306}
    got = topk.search(df.where("vec_id % 20 = 0"), df, cells=3).collect()
    want = brute_top(vectors, [i for i in vectors if i % 20 == 0], 10)
    for q, best in want.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == best


def test_spherical_caps(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    vectors = np.concatenate((base, base[:20] + 0.02 * rng.normal(size=(20, 24)), np.repeat(base[:1], 30, 0), base[1] + 0.01 * rng.normal(size=(60, 24))))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 24), (902, [float("inf")] * 24), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    for cap in (2048, 16):
        got = {r.vec_id: r for r in capfilter.near_duplicates(df, cap=cap).collect()}
        assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))
        assert [got[i].n_links for i in range(len(vectors))] == (near.sum(1) - 1).tolist()
        group = list(range(len(vectors)))
        for i, j in zip(*np.nonzero(near)):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
        assert [got[i].component_id for i in range(len(vectors))] == group and all(got[i].kept == (group[i] == i) for i in range(len(vectors)))
    again = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 2), (7, [0.0, 2.0], 3), (7, [0.0, 2.0], 3), (None, [1.0, 0.0], 4)], "vec_id long, embedding array<double>, kept int")
    found = sorted(map(str, (tuple(r) for r in capfilter.near_duplicates(again).collect())))
    assert found == sorted(map(str, [(5, 0, 5, True), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (None, 0, None, True)]))
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://good.org/a", '<a href="http://next.net/x">'), (2, "http://next.net/x?q", None), (3, "HTTP://Sub.Bad.com/de/1", ""),
        (4, "http://evil.net/", "<a href='https://sub.bad.com/'>"), (5, None, None), (6, "no scheme", None), (7, "x://example.org/en/1#f", None), (7, "x://example.org/en/1#f", None),
    ]
    got = sorted(map(tuple, urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([
        (1, "good.org", "/a", "org/", "allow"), (2, "next.net", "/x", None, "allow"), (3, "sub.bad.com", "/de/1", "com/de/", "block"), (4, "evil.net", "/", None, "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "example.org", "/en/1", "example.org/en/1", "block"), (7, "example.org", "/en/1", "example.org/en/1", "block"),
    ], key=str)


def test_toxicity(spark):
    assert toxicity.step((0, 0, 0), "insult")[1] == "plain"
    after = toxicity.step((0, 0, 0), "negation")[0]
    assert toxicity.step(after, "insult")[1] == "negated"
    assert toxicity.step(toxicity.step((0, 0, 0), "report")[0], "insult")[1] == "reported"
    assert toxicity.step(toxicity.step((0, 0, 0), "target")[0], "threat")[1] == "aimed_threat"
    docs = spark.createDataFrame([(i, f"line {i} about rivers and stones" + (" you are a zorgan" if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(coalesce(text, '') LIKE '%zorgan%' AS INT) AS toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score >= 0.3) == ("zorgan" in (r.text or "")) for r in got)
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (3, 9), (9, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, 3: 3, 9: 3}


def test_pipeline_small(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert {"doc_id", "sequence_id"} <= set(got.columns) and len(got) > 50
    assert got.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.parametrize("name", ["op1_external_shuffle", "op3_simhash", "op10_toxicity"])
def test_registered_queries_return_a_row_a_document(spark, name):
    from tamarix.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    assert QUERIES[name](spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_pipeline_drops_near_copies_at_the_stage_rule(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for group in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(204)]
        rows.append(" ".join(base))
        for changed in (22, 10, 5, 28):  # words replaced at the end: similarities of about 0.8, 0.9 and 0.95, and below
            rows.append(" ".join(base[:-changed] + [f"x{rng.randrange(10**6)}" for _ in range(changed)]))
    rows += [rows[0], "", None, "few words", "Few  words", "one two three four five", " ".join(["same"] * 30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [i for i, g in enumerate(group) if g == i] and 40 < len(kept) < 90


def test_sure_labels_reach_all_repetitions():
    transitions = np.zeros((5, 5))
    number = "4917155501234"
    for bias in (0.0, 1.0):
        weights = np.zeros((2 * pii.N_SHAPES, 5))
        weights[0, 0] = bias
        found = lambda text: [(pii.KINDS[k], text[s:e]) for k, s, e in pii.added_spans([text], [pii.base_spans(text)], (weights, transitions))[0]]  # noqa: E731, B023
        assert found(f"call +{number}. " + f"later on {number}, " * 50 + "not 7777") == [("phone", number)] * 50
        assert found(f"{number} or\n" * 50 + f"call +{number}") == [("phone", number)] * 50
        spaced = "49 171 555 01 234"
        assert found(f"call +{spaced}\n" + f"or {spaced} then\n" * 50 + f"or {number}\n49 171 555 99 999") == [("phone", spaced)] * 50 + [("phone", number)]
        assert found(f"call +{number}\n" + f"or {spaced} then\n" * 20) == [("phone", spaced)] * 20
    assert found("card 4111 1111 1111 1111\nor 4111 1111 1111 1112 and 4111111111111112") == []


def test_toxic_words_behind_a_shared_header_are_learned(spark):
    header = "All rights reserved by the makers of this collection; copies of it may be passed on as they stand. "
    assert len(header) >= 99
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("river stone field cloud lamp chair road bread glass paper".split()) for _ in range(12))
    rows = [(i, header + prose() + (f" blargun {i}" if i % 4 == 0 else f" end {i}")) for i in range(400)]
    rows += [(i, prose() + f" {i}") for i in range(400, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(text LIKE '%blargun%' AS INT) AS toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score >= 0.3) == ("blargun" in r.text) for r in got)
    sample, stands_for = toxicity.sample(docs.union(docs.where("doc_id < 400").selectExpr("doc_id + 5000", "text")), labels.union(labels.where("doc_id < 400").selectExpr("doc_id + 5000", "toxic")))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = labels.union(labels.where("doc_id < 400").selectExpr("doc_id + 5000", "toxic")).where(~toxicity.held_out("doc_id"))
    assert stands_for == {t: known.where(F.col("toxic") == t).count() / n[t] for t in (0, 1)}


def test_distrust_reaches_the_end_of_a_chain(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(14)] + [(14, "http://bad.com/de/", None), (15, "http://clean.net/", "")]
    rows[13] = (13, "http://h13.net/", '<a href="//bad.com/de/">')
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys(range(15), "block"), 15: "allow"}


def test_ranks_are_those_of_the_limit(spark):
    rng = np.random.default_rng(9)
    n = 12
    counts = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.4) * (1 - np.eye(n, dtype=int))
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    seed = rng.random(n)
    links = spark.createDataFrame([(str(a), str(b), float(share[a, b])) for a in range(n) for b in range(n) if share[a, b]], "a string, b string, share double")
    got = {int(r.host): r.rank for r in urls.propagate(spark.createDataFrame([(str(i), float(seed[i])) for i in range(n)], "host string, seed double"), links).collect()}
    want = np.linalg.solve(np.eye(n) - 0.85 * share.T, 0.15 * seed)
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-9


def test_the_field_runs_without_a_base_span():
    weights, transitions = np.zeros((2 * pii.N_SHAPES, 5)), np.zeros((5, 5))
    weights[0, 4] = 6.0  # the shapes alone make each token a phone number
    alone, text = pii.added_spans(["call 4917155501234", "no digits"], [[], []], (weights, transitions)), "call 4917155501234"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in alone[0]] == [("phone", "4917155501234")] and alone[1] == []


def test_pipeline_decides_by_row_where_ids_repeat(spark):
    import corpus_pipeline

    one, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "green", "blue"))
    rows = [(5, one, "a"), (5, other, "b"), (5, other, "b"), (7, one, "c"), (8, other + " end", "d"), (3, third, "e"), (5, third, "f"), (None, one, "g"), (None, one, "g")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, one, "a"), (5, other, "b"), (3, third, "e"), (None, one, "g"), (None, one, "g")], key=str)


def test_near_copies_by_simhash_then_exactly(spark):
    """SimHash's links are a step of their own, a shared passage is one meeting, and nothing is left on disk."""
    import glob
    import os

    from tamarix.llm import jaccard
    from tamarix.session import CLEAN_UP, Scratch

    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage = prose(900), prose(30)
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(6)] + [" ".join([*prose(40), *passage]) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    with Scratch(spark) as held:
        rows = docs.withColumn("h", jaccard.text_hash())
        distinct = held.hold(jaccard.prefixes(rows, jaccard.frequent(rows, 5), 5, 0.8).drop("text").withColumn("id", F.col("doc_id")))
        prints = {r.id: r.fp for r in distinct.select("id", "fp").collect()}
        assert [prints[i] for i in range(len(texts))] == simhash.fingerprint_all(texts, 5).tolist()
        near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 if (prints[i] ^ prints[j]) >= 0 else ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3
        linked = {(r.a, r.b) for r in jaccard.simhash_links(held, distinct).collect()}
        assert linked and all(near(a, b) for a, b in linked)
        met = jaccard.meetings(distinct).where("id >= 6").groupBy("meeting").count().where("count = 5").count()
        assert met <= 1
        place = held.folder
        assert os.path.isdir(place)
    assert not os.path.exists(place) and spark.conf.get(CLEAN_UP) == "false" and (folder is None or not glob.glob(f"{folder}/scratch-*"))
    got = {r.doc_id: r.component for r in jaccard.near_copies(docs).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len(set(got.values())) == 6


def test_counts_do_not_depend_on_the_sample(spark, edge_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokens.tokenizer(path)
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in edge_docs.collect())
    for most in (0, 3, tokens.FREQUENT):
        assert sorted(r.n_tokens for r in tokens.count_tokens(edge_docs, path, frequent=most).collect()) == want


def test_near_copies_compare_only_what_can_be_similar(spark, monkeypatch):
    """Texts of which more than a fifth is their own meet nobody, whatever else they share; hashes are counted over all texts; a group of near copies costs few pairs."""
    from tamarix.llm import jaccard

    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        passage = prose(60)
        texts += [" ".join([*prose(40), *passage]) for _ in range(3)]
    base = prose(200)
    for _ in range(150):  # each with 2 of 200 words changed: similarities about 0.8 between two of them
        words = list(base)
        for k in rng.sample(range(200), 2):
            words[k] = prose(1)[0]
        texts.append(" ".join(words))
    texts += [texts[0], texts[200], "", None, "few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(jaccard.shingle_set(t, 5).tolist()) for t in texts]

    rows = {r.h: r for r in jaccard.counted(docs.withColumn("h", jaccard.text_hash()).select("h", "text"), 5).collect()}
    times = {}
    for x in sets:
        for s in x:
            times[s] = times.get(s, 0) + 1
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", jaccard.text_hash().alias("h")).collect()}
    for i, x in enumerate(sets):
        assert (rows[hashes[i]].n, rows[hashes[i]].shared) == (len(x), sum(times[s] > 1 for s in x))

    compared, verified = [], jaccard.verified

    def counting(held, pairs, *rest):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return verified(held, pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counting)
    got = {r.doc_id: r.component for r in jaccard.near_copies(docs).collect()}
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    first = {}
    assert all(first.setdefault(got[i], g) == g for i, g in enumerate(group)) and len(first) == len(set(group))
    # Of the 150 near copies 11,175 pairs could be made, of the others 180.
    assert len(compared) == len(set(compared)) < 3000
