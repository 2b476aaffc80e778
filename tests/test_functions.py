
import re
import threading

import psutil
import pytest
from pyspark.sql import functions as F

from tamarix.acl import RowAcl
from tamarix.errors import PrivilegeError
from tamarix.functions import text, vector
from tamarix.operators import files
from tamarix.streaming import dataflow


def test_html_text_is_lenient():
    page = "<!DOCTYPE html><head><title>t</title></head><body><!-- ad --><p>a<br>b<p>c<script>x</script> &amp; d"
    assert text.html_texts(page) == ["a", "b", "c", " & d"]
    assert text.html_texts(None) is None and text.html_texts("") == []


def test_chunks_cover_words_and_break_at_headings():
    body = "one two three\n# head\nfour five"
    made = text.chunk_text(body, 2)
    assert [c for _, _, c in made] == ["one two", "three", "# head", "four five"]
    assert all(body[s:e] == c for s, e, c in made)


def test_tokens_of_long_texts(spark):
    long = "don't " * 30_000  # more than two runs of tokens
    rows = [(1, long), (2, None), (3, ""), (4, "  \n"), (5, "é, x_1"), (5, "é, x_1")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = sorted((i, k, m[0], m.start(), m.end()) for i, t in rows for k, m in enumerate(re.finditer(r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]", t or "")))
    assert sorted(map(tuple, text.tokens(df, keep=["id"]).collect())) == want
    first = text.tokens(df, most=2)
    assert first.columns == ["id", "text", "token_no", "token", "token_start", "token_end"]
    assert sorted((r.id, r.token_no, r.token) for r in first.collect()) == [w[:3] for w in want if w[1] < 2]


def test_tokens_are_not_held_at_once(spark):
    df = spark.range(150, numPartitions=1).select("id", F.repeat(F.lit("ab, "), 10_000).alias("text"))
    most, done = [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    most[0] = max(most[0], p.memory_info().rss * (p.name() != "java"))
                except psutil.Error:
                    pass

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert text.tokens(df).select("id", "token").where("token = ','").count() == 1_500_000
    finally:
        done.set()
        thread.join()
    assert most[0] < 500e6


def test_vectors(spark):
    df = spark.createDataFrame([("low", [0.5, -0.25, 0.0]), ("high", [2.0, 3.0, 0.5]), ("none", None)], "id string, v array<float>")
    score = vector.dot(F.col("v"), vector.vector([2, 1, 4]))
    assert [r.id for r in df.where(score < 1.1).collect()] == ["low"]
    assert [r.id for r in vector.top_k(df, score, 1, "id").collect()] == ["high"]
    with pytest.raises(Exception):
        df.select(vector.dot(F.col("v"), vector.vector([1.0]))).collect()


def test_acl_is_closed(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    acl = RowAcl([("u", "t", "select", "id = 1"), ("w", "*", "*", "*")])
    run = lambda user, q: sorted(r[0] for r in acl.query(spark, user, q, {"t": t}).collect())
    assert run("u", "SELECT id FROM t WHERE name = 'b' OR name = 'a'") == [1]
    assert run("u", "SELECT id FROM t UNION ALL SELECT id FROM t") == [1, 1]
    assert run("u", "WITH x AS (SELECT * FROM t) SELECT id FROM x WHERE id IN (SELECT id FROM t)") == [1]
    assert run("w", "SELECT id FROM t") == [1, 2, 3]
    with pytest.raises(PrivilegeError):
        acl.condition("stranger", "t", "select")
    with pytest.raises(Exception):
        run("stranger", "SELECT id FROM t")


def test_tree_stops_at_missing_parents(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id long, parent_id long")
    assert sorted(map(tuple, files.tree(nodes, 3, True).collect())) == [(1, 2), (2, 1), (3, 0)]
    assert sorted(map(tuple, files.tree(nodes, 4, True).collect())) == [(4, 0)]


def test_barrier_stream_fires_once(spark, tmp_path):
    rows = [("r1", "a", 1.0, 1), ("r1", "a", 9.0, 2), ("r1", "b", None, 3), ("r2", "a", 5.0, 4)]
    schema = "run string, field string, value double, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = dataflow.barrier_stream(stream, ["a", "b"]).writeStream.format("memory").queryName("barrier_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert spark.table("barrier_out").count() == 0
        spark.createDataFrame([("r1", "b", 2.0, 5), ("r1", "b", 3.0, 6)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        spark.createDataFrame([("r1", "b", 4.0, 7)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("barrier_out").collect()] == [("r1", 1.0, 2.0)]
    finally:
        q.stop()
