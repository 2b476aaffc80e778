"""Files, collections, search, and events between publishers and subscribers."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tamarix import errors
from tamarix.operators import collections, files, retrieval
from tamarix.streaming import dataflow, pubsub


@pytest.fixture(scope="module")
def tree(spark):
    held = lambda x: json.dumps({"content": base64.b64encode(x).decode()})
    rows = [
        ("r", "root", None, True, None, None), ("r-a", "docs", "r", True, None, None), ("r-a-1", "one", "r-a", False, held(b"first"), None), ("r-a-2", "two", "r-a", False, held(b"\xff\x00"), None),
        ("r-b", "old", "r", True, None, "2024-01-01"), ("r-b-c", "inner", "r-b", True, None, None), ("ra", "other", None, True, None, None), ("x-1", "lost", "x", False, held(b"l"), None),
    ]
    return spark.createDataFrame(rows, "id string, name string, parent_id string, is_directory boolean, file string, archived_at string").withColumn("archived_at", F.col("archived_at").cast("timestamp_ntz"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_file_tree(spark, tree):
    assert ids(files.children(tree, "r")) == ["r-a"] and ids(files.children(tree, None)) == ["r", "ra"] and ids(files.node(tree, "r-b")) == []
    assert [(r.id, bytes(r.content)) for r in files.read_file(tree, "r-a-2").collect()] == [("r-a-2", b"\xff\x00")] and files.read_file(tree, "r-a").count() == 0
    assert [r.id for r in files.breadcrumb(tree, "r-a-1").collect()] == ["r", "r-a", "r-a-1"] and [r.id for r in files.breadcrumb(tree, "x-1").collect()] == ["x-1"]
    assert sorted(map(tuple, files.sub_directories(tree, "r").collect())) == [("r", 0), ("r-a", 1)]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "id long, parent_id long")
    assert sorted(map(tuple, files.tree(loop, 3, True).collect())) == [(1, 2), (2, 1), (3, 0)] and files.tree(loop, 9, True).count() == 0
    chain = spark.range(130).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id")).where("id < 12")
    assert files.tree(chain, 0, False).agg(F.max("depth")).first()[0] == 11


def test_written_and_removed(spark, tree):
    new = spark.createDataFrame([("r-a-1", "one", "r-a", bytearray(b"changed")), ("r-a-9", "nine", "r-a", bytearray(b""))], "id string, name string, parent_id string, content binary")
    now = files.written(tree, new)
    assert bytes(files.read_file(now, "r-a-1").first().content) == b"changed" and now.count() == tree.count() + 1
    vectors = spark.createDataFrame([("r-a-1", 1), ("r-a-2", 2), ("x-1", 3)], "file_id string, v int")
    gone, kept = files.soft_deleted(tree, vectors, "r-a", F.current_timestamp().cast("timestamp_ntz"))
    assert ids(files.present(gone)) == ["r", "r-b-c", "ra", "x-1"] and [r.file_id for r in kept.collect()] == ["x-1"]
    assert gone.where("id = 'r-b'").first().archived_at.year == 2024


def test_collections(spark):
    docs = spark.createDataFrame([("c", 1, "añb long text"), ("c", 2, "second"), ("d", 1, "other")], "collection string, doc_id int, content string")
    parts = spark.createDataFrame([("c", 1, 1, 3, [1.0, 0.0]), ("c", 1, 4, 8, [0.0, 2.0]), ("c", 2, 0, 6, [3.0, 4.0]), ("d", 1, 0, 5, [9.0, 9.0])], "collection string, doc_id int, start int, end int, embedding array<float>")
    got = [(r.doc_id, r.start, r.score, r.content, r.before_context, r.after_context) for r in collections.top_k(docs, parts, "c", [1, 1], 3, min_score=1.5, before=2, after=3).orderBy(F.desc("score")).collect()]
    assert got == [(2, 0, 7.0, "second", "", ""), (1, 4, 2.0, " lon", "�b", "g t")]
    assert [r.doc_id for r in collections.top_k(docs, parts, "c", [0, 1], 1, metric="cos", with_content=False).collect()] == [1]
    assert [r.start for r in collections.top_k(docs, parts, "c", [1, 0], 1, metric="l2", with_content=False).collect()] == [1]
    assert {r.collection: r.documents for r in collections.collections(collections.add_documents(docs, docs.limit(1))).collect()} == {"c": 2, "d": 1}
    left, rest = collections.delete_documents(docs, parts, docs.where("doc_id = 1 AND collection = 'c'"))
    assert left.count() == 2 and rest.count() == 2
    assert collections.set_embeddings(parts, parts.where("collection = 'c' AND start = 1")).count() == 3


def test_search_with_scope_and_originals(spark):
    chunk = "file_id long, directory_id long, chunk_start int, chunk_end int, embedding array<float>"
    chunks = spark.createDataFrame([(1, 10, 0, 4, [2.0, 0.0]), (2, 20, 0, 4, [3.0, 0.0]), (3, None, 0, 4, [9.0, 0.0]), (4, 10, 0, 4, [0.05, 0.0]), (5, 20, 0, 4, [1.0, 0.0])], chunk)
    held = spark.createDataFrame([(1, "page of text", 7, False), (2, "page of text", 20, False), (3, "x" * 9, None, False), (4, "weak", 10, False), (5, "fifth file", 20, False), (7, "original.pdf", 10, False), (10, "", None, True), (20, "", None, True)], "file_id long, content string, parent_id long, is_directory boolean")
    run = lambda scope: [(r.file_id, r.score, r.original_id) for r in retrieval.search(chunks, held, [1, 0], scope=scope).collect()]
    assert run(retrieval.in_scope([10], None)) == [(1, 2.0, 7)]
    assert run(retrieval.in_scope([10], [5])) == [(1, 2.0, 7), (5, 1.0, 5)]
    assert run(retrieval.in_scope(None, None)) == [(1, 2.0, 7), (5, 1.0, 5)]  # 1 and 2 hold one text
    found = retrieval.search(chunks, held, [1, 0])
    assert found.count() == 3 and {r.file_id: r.prompt for r in retrieval.prompt(found).collect()}[5] == '<file id="5"><sections><section>fift</section></sections></file>'
    both = retrieval.federated({"drive": found, "mail": found.select("file_id", "score")})
    assert both.count() == 6 and both.where("app = 'mail' AND chunk IS NULL").count() == 3


def test_embedding_stand_in(spark):
    got = retrieval.embedded(spark.createDataFrame([("a b",), ("B  a",), ("",), (None,)], "text string"), size=16).collect()
    assert got[0].embedding == got[1].embedding and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-6 and got[2].embedding == [0.0] * 16 and got[3].embedding is None


def run_stream(stream, folder, name, mode="append"):
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp-{name}").start()


def test_publish_and_subscribe(spark, tmp_path):
    x = pubsub.Exchange(spark, str(tmp_path / "x"))
    shape = "seq long, source string, path string, data string"
    subscriptions = [run_stream(x.subscribe("c"), tmp_path, "sub_all"), run_stream(x.subscribe("c", source="s1"), tmp_path, "sub_s1"), run_stream(x.subscribe("c", path="/a"), tmp_path, "sub_a")]
    try:
        x.publish("c", spark.createDataFrame([(1, "s1", "/a/b", '{"m": 1}'), (2, "s2", None, "{}")], shape))
        x.publish("c", spark.createDataFrame([(3, "s1", "/z", "{}")], shape))
        for q in subscriptions:
            q.processAllAvailable()
        seen = [sorted(r.seq for r in spark.table(n).collect()) for n in ("sub_all", "sub_s1", "sub_a")]
        assert seen == [[1, 2, 3], [1, 3], [1]] and [r.seq for r in x.history("c").collect()] == [1, 2, 3]
    finally:
        for q in subscriptions:
            q.stop()


def test_fan_out_and_windows(spark, tmp_path):
    events = "seq long, ts timestamp_ntz, k string"
    spark.createDataFrame([(1, "2024-01-01 00:01:00", "a"), (2, "2024-01-01 00:04:00", "a"), (3, "2024-01-01 02:00:00", "b"), (3, "2024-01-01 02:00:00", "b")], "seq long, ts string, k string").selectExpr("seq", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "k").write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(events).parquet(f"{tmp_path}/in")
    taken = {"one": [], "two": []}
    q = dataflow.fan_out(source(), lambda b, n: taken["one"].append(b.count()), lambda b, n: taken["two"].extend(r.seq for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp-f").start()
    counted = run_stream(dataflow.windowed_counts(source(), "ts", "10 minutes"), tmp_path, "counted")
    unique = run_stream(dataflow.deduplicated(source().withColumn("reference_id", F.col("k")).withColumn("seq_id", F.col("seq")).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), tmp_path, "uniq")
    try:
        for s in (q, counted, unique):
            s.processAllAvailable()
        assert taken["one"] == [4] and sorted(taken["two"]) == [1, 2, 3, 3]
        assert [(r.n) for r in spark.table("counted").collect()] == [2]  # the later window is still open
        assert sorted(r.seq for r in spark.table("uniq").collect()) == [1, 2, 3]
    finally:
        for s in (q, counted, unique):
            s.stop()


def test_streams_are_joined_within_an_interval(spark, tmp_path):
    made = lambda name, rows: spark.createDataFrame(rows, "user long, ts string").selectExpr("user", "CAST(ts AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/{name}")
    made("views", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")])
    made("buys", [(1, "2024-01-01 00:09:00"), (2, "2024-01-01 00:30:00"), (1, "2023-12-31 23:59:00")])
    read = lambda name: spark.readStream.schema("user long, ts timestamp_ntz").parquet(f"{tmp_path}/{name}")
    q = run_stream(pubsub.joined(read("views"), read("buys"), "user", "ts", "10 MINUTES"), tmp_path, "joined")
    try:
        q.processAllAvailable()
        assert [(r.user, r.right_user) for r in spark.table("joined").collect()] == [(1, 1)]
    finally:
        q.stop()


def test_graphs(spark):
    nodes = spark.createDataFrame([("in", "source"), ("sum", "add"), ("idle", "strange")], "id string, type string")
    edge = "from_node string, from_key string, to_node string, to_key string, edge_no int"
    edges = spark.createDataFrame([("in", "x", "sum", "a", 1), ("in", "x", "sum", "b", 2), ("in", "y", "sum", "a", 3)], edge)
    graph = pubsub.compiled(nodes, edges, ["source", "add"])
    assert sorted(map(tuple, graph.collect())) == [("sum", "add", "a", "in", "y"), ("sum", "add", "b", "in", "x")]
    events = spark.createDataFrame([("r1", "in", "x", 1.0, 1), ("r1", "in", "x", 5.0, 2), ("r1", "in", "y", 2.0, 3), ("r2", "in", "x", 9.0, 1)], "run string, from_node string, from_key string, value double, seq long")
    assert [(r.run.run, r.run.node, r.a, r.b) for r in dataflow.barrier(pubsub.routed(events, graph), ["a", "b"]).collect()] == [("r1", "sum", 2.0, 1.0)]
    with pytest.raises(errors.SyntaxError_):
        pubsub.compiled(nodes, spark.createDataFrame([("in", "x", "idle", "a", 1)], edge), ["source", "add"])
    with pytest.raises(errors.UndefinedTable):
        pubsub.compiled(nodes, spark.createDataFrame([("in", "x", "gone", "a", 1)], edge), ["source", "add"])


def test_replay_and_end_of_results(spark):
    got = pubsub.replayed(spark.createDataFrame([(2, 1, "c"), (1, 5, "b"), (1, 2, "a"), (3, 1, "d")], "stream_no int, seq long, v string")).orderBy("position").collect()
    assert [(r.position, r.v) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    taken, ended = [], []
    pubsub.to_end(spark.range(5), taken.append, lambda: ended.append(len(taken)))
    assert ended == [5]
    with pytest.raises(ZeroDivisionError):
        pubsub.to_end(spark.range(5), lambda row: 1 // 0, lambda: ended.append("no"))
    assert ended == [5]
