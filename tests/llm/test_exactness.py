"""Words are exact, layouts do not matter, and hot or empty inputs have defined results."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarix.llm import bpe, packing, pretoken, sharding, simhash, tokens, topk, toxicity

BYTES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def twins(doublings: int) -> tuple[str, str]:
    """Two words whose polynomial hashes are equal modulo any power of two up to the 64th, whatever the base."""
    a, b = "k", "q"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def unusual(n: int, seed: int) -> list[str]:
    """Texts over scripts, marks, emoji, unassigned and astral characters, special strings and odd blanks."""
    rng = random.Random(seed)
    some = ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", " ", "  ", "\t\n", " ", "　", "é", "İ", "Σ", "ς", "ͅ", "\U0001f600", "\U0001f9d1‍\U0001f33e", "नमस्ते", "สวัส", "شمس", "שלום", "͸", "\U000323af", "\U0001e030", "Ᲊ", "Zahl 12½٣"]
    pick = lambda: rng.choice(some) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(pick() for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    a, b = twins(11)
    texts = [f"{a}\n{b}\n{a}", f"{b} {a}", a.upper() + "\n" + b.upper(), "x" * 300 + " " + "7" * 400, " ".join(twins(6) * 40), None, ""] + unusual(5000, 3)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_classes_are_those_of_both_libraries():
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((pretoken.LETTER, r"\p{L}+"), (pretoken.NUMBER, r"\p{N}+"), (pretoken.SPACE, r"\s+")):
        found = {c for text, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every) for c in map(ord, text)}
        assert found == set(np.flatnonzero(pretoken.classes() == kind).tolist())


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(pretoken, "hashes", lambda cp, s, e: np.full(len(s), 77, np.uint64))
    table = pretoken.WordTable(1 << 10)
    words = [f"w{i}" for i in range(30)] + ["w3", "w29"]
    cp, bounds = pretoken.code_points(words)
    for _ in range(2):
        rows = table.rows_for(cp, bounds[:-1], bounds[1:], lambda ws: [[int(w[1:])] for w in ws])
        assert table.gather(rows)[0].tolist() == [*range(30), 3, 29]
    loaded = pretoken.WordTable(1 << 10)
    loaded.load(words[:30], [[int(w[1:])] for w in words[:30]])
    assert loaded.gather(loaded.find(cp, bounds[:-1], bounds[1:]))[0].tolist() == [*range(30), 3, 29]


def test_long_texts_are_cut_where_no_piece_crosses(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", " ", "  ", "\n ", " \n", "'s", "12", "!", "é"]) for _ in range(4000))
    for split in (pretoken.split_bytes_bpe, pretoken.split_word_bpe):
        whole = [text[s:e] for s, e in zip(*split(*pretoken.code_points([text])))]
        parts = list(pretoken.parts(text, 50))
        assert "".join(parts) == text and len(parts) > 20
        assert [p[s:e] for p in parts for s, e in zip(*split(*pretoken.code_points([p])))] == whole


def test_ids_equal_the_libraries(odd_docs):
    library, words, ranked = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), bpe.library(RANKS)
    assert isinstance(ranked, tiktoken.Encoding)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in tokens.count_tokens(odd_docs, WORDS).collect():
        assert r.n_tokens == len(words.encode(texts[r.doc_id], add_special_tokens=False).ids), repr(texts[r.doc_id])
    coded = bpe.encode(odd_docs, RANKS, keep=["doc_id"])
    for r in bpe.decode(coded, RANKS).collect():
        assert r.ids == ranked.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode(), repr(texts[r.doc_id])
    got: dict[int, bytes] = {}
    for r in sorted(packing.token_pieces(odd_docs, BYTES, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, text in texts.items():
        assert np.frombuffer(got[i], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_rows_refer_to_recent_words_only(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["zorg", "blimfa", "quaxil", "trubon", "welpick"]) + str(rng.randrange(30)) for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for memory in (1, 7, 1 << 16):
        got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, frequent=4, memory=memory).collect()}
        assert got == {i: bpe.library(RANKS).encode_ordinary(t) for i, t in enumerate(texts)}


def test_every_pair_has_its_rank_and_no_other_pair():
    bases, cells = bpe.pair_table(RANKS)
    table = bpe.ranks(RANKS)
    pairs = {(table[t[:i]], table[t[i:]]): r for t, r in table.items() for i in range(1, len(t)) if t[:i] in table and t[i:] in table}
    a, b = np.array(list(pairs)).T
    assert ((cells[bases[a] ^ b] ^ (a << 16)) == np.array(list(pairs.values()))).all()
    rng = np.random.default_rng(1)
    for x, y in zip(rng.integers(0, 50256, 20000).tolist(), rng.integers(0, 50256, 20000).tolist()):
        assert (int(cells[bases[x] ^ y]) ^ (x << 16)) == pairs.get((x, y), -1) or ((x, y) not in pairs and (int(cells[bases[x] ^ y]) ^ (x << 16)) >= 65536)


def test_slots_do_not_hang_on_the_layout(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"), F.lit("x").alias("SHARD"))
    results = []
    for parts, shuffled in ((1, 4), (7, 3)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        try:
            results.append(sorted(map(tuple, sharding.shard(docs.repartition(parts), 5, bucket_rows=64).select("doc_id", "text", "shard", "grown_shard", "slot").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    # The shard is that of the published jump hash over the same draws: the last jump below the number of shards.
    order = [r[0] for r in sorted(results[0], key=lambda r: (r[2], r[4]))]
    assert order != sorted(order)


def test_fisher_yates_is_a_uniform_permutation(spark):
    rows = spark.range(6000).select(F.col("id"), F.array(*map(F.lit, "abc")).alias("r"))
    got = rows.select(F.array_join(sharding.fisher_yates(F.col("r"), F.col("id")), "").alias("p")).groupBy("p").count().collect()
    assert len(got) == 6 and all(850 < r["count"] < 1150 for r in got)
    one = spark.createDataFrame([([],), ([1],)], "r array<int>").select(sharding.fisher_yates(F.col("r"), F.lit(1)).alias("p")).collect()
    assert [r.p for r in one] == [[], [1]]


def test_shards_are_written_in_slot_order(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharded = sharding.shard(docs, 3)
    sharding.write(sharded, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, sharded.select("doc_id", "shard", "slot").collect()))


def test_rows_without_an_id_link_others(spark, monkeypatch):
    values = {"a": 0, "b": 0b111, "c": 0b111111, "d": (1 << 40) - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text, width, out, keep: docs.select(*keep, F.coalesce(*(F.when(F.col(text) == k, F.lit(v)) for k, v in values.items())).cast("long").alias(out)))
    docs = spark.createDataFrame([(4, "a"), (None, "b"), (9, "c"), (None, "d")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == sorted([(4, 0, 4), (None, 7, 4), (9, 63, 4), (None, (1 << 40) - 1, None)], key=str)


def test_search_has_defined_edges(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    rows = spark.createDataFrame([(i, [10**18, -i]) for i in range(5)] + [(7, [1, 2]), (7, [0, 5]), (9, [3]), (11, [])], "vec_id long, v array<long>")
    assert topk.search(none, rows).count() == 0 and topk.search(rows, none).count() == 0
    got = topk.search(rows, rows, k=3, cells=2).collect()
    first = sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])
    assert [(r.vec_id, r.score) for r in first] == [(1, topk.LIMIT), (2, topk.LIMIT), (3, topk.LIMIT)]
    assert not [r for r in got if r.query_id in (9, 11)] and not [r for r in got if r.query_id == 7 and r.vec_id == 7]
    wide = topk.integers(spark.createDataFrame([(1, [1e300, -1e300], 5)], "vec_id long, embedding array<double>, V int"))
    assert wide.first().v == [2**63 - 1, -(2**63)]


def test_a_word_counts_by_its_clause(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("river stone field cloud lamp chair road bread glass paper".split()) for _ in range(10))
    docs = spark.createDataFrame([(i, prose() + ". that is what a " + ("zorgan" if i % 5 == 0 else "stone")) for i in range(500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(text LIKE '%zorgan%' AS INT) AS toxic")
    model = toxicity.fit(docs, labels)
    texts = ["you zorgan here.", "what zorgan here.", "not a zorgan here.", 'said "a zorgan" here.', "i will kill you here.", "i will kill time here.", "nothing here at all."]
    score = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    targeted, plain, negated, quoted, aimed, threat, nothing = (score[t] for t in texts)
    assert targeted > plain > max(negated, quoted) >= min(negated, quoted) > nothing and aimed > threat > nothing


def test_the_composition_equals_its_transducers():
    """Brute force: run the three transducers apart over every sequence of symbols and combine them by hand."""
    import itertools

    for symbols in itertools.product(("insult", "threat", "target", "negation", "report", "quote", "word"), repeat=4):
        state = (0, 0, 0)
        target = negated = 0
        speech = 0
        for s in symbols:
            want = None
            if s in ("insult", "threat"):
                want = "reported" if speech else "negated" if negated else {"insult": ("plain", "targeted"), "threat": ("threat", "aimed_threat")}[s][target > 0]
            state, channel = toxicity.step(state, s)
            assert channel == want
            target, negated, speech = toxicity.near_target(target, s), toxicity.negation(negated, s), toxicity.reported(speech, s)
            assert state == (target, negated, speech)


def test_base_spans_are_the_four_patterns():
    import re

    from tamarix.llm import pii

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            n = int(c) * (1 + i % 2)
            total += n - 9 * (n > 9)
        return total % 10 == 0

    def brute(text):
        digits = lambda m: re.sub(r"[^0-9]", "", m[0])
        out = [(0, *m.span()) for m in email.finditer(text)]
        out += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(2, *m.span()) for m in card.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [(3, *m.span()) for m in phone.finditer(text) if 8 <= len(digits(m)) <= 15]

    rng = random.Random(12)
    pieces = ["a", "b@c", ".", "@", "-", "+", "1", "22", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", " ", "\n", "(", ")", "%_", "x@y.z", "10.0.0.1", "+49 171 555", "ä", "٣", "..", "--"]
    for _ in range(30000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_spans_do_not_hang_on_other_texts_and_digits_take_linear_time():
    import time

    from tamarix.llm import pii

    weights, transitions = np.zeros((2 * pii.N_SHAPES, 5)), np.zeros((5, 5))
    weights[0, 0] = 0.5
    texts = ["call +4917155501234 or 4917155501234 or 49171 55501234", "mail a.b@c.org, a.b@c.org", "no digits", "7" * 200 + " 1.2.3.4 1.2.3.4", ""] * 3
    bases = [pii.base_spans(t) for t in texts]
    together = pii.added_spans(texts, bases, (weights, transitions))
    assert together == [pii.added_spans([t], [b], (weights, transitions))[0] for t, b in zip(texts, bases)]
    began = time.process_time()
    pii.base_spans("9" * 400_000, [])
    assert time.process_time() - began < 2


def test_the_strength_of_skip_edges_is_fitted():
    from tamarix.llm import pii

    field = pii.Field()
    for i in range(20):
        text = f"call +49171555{i:05d} now\nor +49171555{i:05d} then"
        field.add(i, text, pii.base_spans(text))
    weights, transitions = np.zeros((2 * pii.N_SHAPES, 5)), np.zeros((5, 5))
    assert pii.fit_skip(field, weights, transitions) == max(pii.SKIPS)  # equal numbers always have equal labels here
    assert pii.fit_skip(pii.Field(), weights, transitions) == pii.SKIP


def test_hubs_are_dealt_where_hosts_are_many(spark, monkeypatch):
    from tamarix.llm import urls

    rows = [(i, f"http://h{i % 7}.net/{i}", f'<a href="http://h{(i * 3) % 7}.net/"><a href="//bad.com/x">' if i % 5 else None) for i in range(60)] + [(99, "http://bad.com/de/", None), (None, "http://h1.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    first = sorted(map(str, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert sorted(map(str, urls.judge(pages).collect())) == first and len(first) == 62
    assert urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_stages_handle_edges(spark, edge_docs, number, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (10, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (edge_docs, edge_docs.limit(0)):
        got = stage(spark, docs, str(tmp_path))
        if number < 3:
            assert got.columns == docs.columns
            assert got.count() <= docs.count() and (docs.isEmpty() or got.where("doc_id is null").count() == 1)
        else:
            assert got.count() >= docs.count()


def test_rare_words_are_remembered_over_the_whole_memory(spark, monkeypatch):
    seen, with_literal = [], bpe.with_literal
    monkeypatch.setattr(bpe, "with_literal", lambda df, *rest: seen.append(df) or with_literal(df, *rest))
    words = [f"zorg{c}blimfa" for c in "abcdefghijklmnopqr"]
    docs = spark.createDataFrame([(0, "\n".join(words[:15])), (1, "\n".join([*words[15:], words[14]]))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, frequent=1, memory=16, keep=["doc_id"]).collect()}
    assert got == {r.doc_id: bpe.library(RANKS).encode_ordinary(r.text) for r in docs.collect()}
    # The sixteenth word fills the memory between the two times of the fifteenth; that one is still remembered.
    folded = [bytes(w).decode() for r in seen[-1].collect() for w in r["__rest"]]
    assert folded.count(words[14]) == 1 and set(words) <= set(folded)


def test_merges_by_rank_make_the_librarys_tokens():
    library, table, made = bpe.library(RANKS), bpe.ranks(RANKS), bpe.merge_order(RANKS)
    # Every token of several bytes forms from two of lower rank.
    assert made.keys() == {r for t, r in table.items() if len(t) > 1} and all(max(x) < r for r, x in made.items())
    rng = random.Random(3)
    words = ["".join(rng.choice("aethinorsé日 \0\n-9" if i % 2 else "aethinors") for _ in range(rng.randint(0, 40))).encode() for i in range(3000)] + [b"a" * 126, b""]
    merges, n = bpe.merges_of(bpe.beginnings_of_tokens(RANKS), words, 500)
    pieces, begin, signs = {r: t for t, r in table.items()}, 0, bpe.symbols(RANKS)
    for w, k in zip(words, n.tolist()):
        mine, begin = merges[begin : begin + k].tolist(), begin + k
        assert mine == sorted({table[w[i:j]] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in table})
        state = w.decode("latin-1")
        for r in mine:
            state = state.replace(signs[made[r][0]] + signs[made[r][1]], signs[r])
        got = bpe.ids_of(bpe.byte_ids(RANKS), state).tolist()
        assert got == (library._encode_single_piece(w) if w else []) and b"".join(pieces[i] for i in got) == w
    assert begin == len(merges)


def test_a_row_brings_along_only_the_merges_of_its_words(spark, monkeypatch):
    seen, with_literal = [], bpe.with_literal
    monkeypatch.setattr(bpe, "with_literal", lambda df, *rest: seen.append(df) or with_literal(df, *rest))
    docs = spark.createDataFrame([(0, "zorgblimfa thbleesnt " + "x" * 130), (1, None), (2, "zorgblimfa\nquaxil")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, frequent=1, keep=["doc_id"]).collect()}
    assert got == {r.doc_id: bpe.library(RANKS).encode_ordinary(r.text or "") for r in docs.collect()}
    pieces = {r: t for t, r in bpe.ranks(RANKS).items()}
    rows = [(bytes(w), m) for r in seen[-1].collect() for w, m in zip(r["__rest"], r["__merges"])]
    # The word that occurs twice is brought along once at most.
    assert {b" thbleesnt", b"quaxil", b""} <= {w for w, _ in rows} and len({w for w, _ in rows}) == len(rows)
    assert all(m == sorted(set(m)) and all(pieces[i] in w for i in m) for w, m in rows if w) and any(m for w, m in rows if w)
    # A word that is too long for the fold has its ids there.
    assert [m for w, m in rows if not w] == [bpe.library(RANKS).encode_ordinary(" " + "x" * 130)]


def test_ranks_that_do_not_rise_are_folded_by_pairs(spark, tmp_path):
    import base64

    # "abc" ranks below "ab", which it forms from.
    tokens_ = [*(bytes([b]) for b in range(256)), b"abc", b"ab", b"abcd", b"dd"]
    path = str(tmp_path / "odd.tiktoken")
    with open(path, "w") as file:
        file.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens_))
    assert bpe.merge_order(path) is None
    texts = ["abcabdabcdddd abc", "ab\nabcd é", "", None, "abc" * 60, "dddabcdd", "日本abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        assert r.ids == bpe.library(path).encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
