"""Objects, named sources, and the options of server reads."""

import pandas as pd
import pytest

from tamarix import errors
from tamarix.sources import jdbc
from tamarix.sources.objects import Bucket
from tamarix.sources.registry import Registry, to_split
from tamarix.sources.store import Store


def test_objects(spark, tmp_path):
    b = Bucket(spark, str(tmp_path / "bucket"))
    b.create()
    for key, content in (("a/one.txt", b"1"), ("a/b/two.txt", b"22"), ("a/empty", b""), ("top", b"\x00\xff")):
        b.put(key, content)
    assert [(r.key, r.size) for r in b.list("a/").collect()] == [("a/b/two.txt", 2), ("a/empty", 0), ("a/one.txt", 1)]
    assert [(r.key, r.is_prefix) for r in b.list("a/", delimiter="/").collect()] == [("a/b/", True), ("a/empty", False), ("a/one.txt", False)]
    assert [r.key for r in b.list("a/o").collect()] == ["a/one.txt"] and b.list("zzz/").count() == 0
    assert b.get("top") == b"\x00\xff" and b.get("a/empty") == b"" and b.head("a/b/two.txt")["size"] == 2
    assert {r.key: bytes(r.content) for r in b.contents("a").collect()} == {"a/one.txt": b"1", "a/b/two.txt": b"22"}
    b.put("top", b"new")
    assert b.get("top") == b"new"
    with pytest.raises(errors.UndefinedTable):
        b.get("none")
    with pytest.raises(errors.SyntaxError_):
        b.list("", delimiter="-")


def test_server_reads():
    got = jdbc.options("jdbc:postgresql://h/d", "SELECT '$1', x FROM t WHERE a = $1 AND b = $2 -- $3", ["o'k", None], user="u")
    assert got == {"url": "jdbc:postgresql://h/d", "user": "u", "query": "SELECT '$1', x FROM t WHERE a = 'o''k' AND b = NULL -- $3"}
    ranged = jdbc.options("jdbc:x", "SELECT 1", partition_column="id", bounds=(0, 100), partitions=4)
    assert ranged["dbtable"] == "(SELECT 1) AS q" and ranged["numPartitions"] == "4" and "query" not in ranged
    for bad in (lambda: jdbc.options("jdbc:x", "SELECT $2", [1]), lambda: jdbc.options("jdbc:x", "SELECT 1", partition_column="id")):
        with pytest.raises(ValueError):
            bad()


def test_named_sources(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db")).session()
    s.execute("CREATE TABLE t (id INT, name TEXT)")
    s.execute("INSERT INTO t VALUES (1, 'a'), (2, 'it''s')")
    r = Registry(spark, s.execute)
    r.json("fixed", '[{"k": 1}, {"k": 2}]')
    r.sql("by_name", "SELECT id FROM t WHERE name = {{ user.name }}")
    r.function("frame", lambda props: pd.DataFrame({"x": [props["n"], 5]}))
    r.mapped("doubled", "frame", lambda frame: frame * 2, "x long")
    assert sorted(x.k for x in r.run("fixed").collect()) == [1, 2]
    assert [x.id for x in r.run("by_name", {"user": {"name": "it's"}}).collect()] == [2]
    assert r.run("by_name", {"user": {"name": "' OR 1 = 1 --"}}).count() == 0
    assert sorted(x.x for x in r.run("doubled", {"n": 3}).collect()) == [6, 10]
    assert '"columns":["k"]' in to_split(r.run("fixed")) and r.run("frame", {"n": 1}).count() == 2
    with pytest.raises(errors.UndefinedTable):
        r.run("missing")
    with pytest.raises(errors.InvalidText):
        r.json("bad", '{"k": 1}')
