import sqlite3

import pytest

from tamarix.sources.sqlite import SqliteSource, camel_case


def test_read(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (user_id integer, full_name text, x real)")
        c.executemany("insert into t values (?, ?, ?)", [(k, f"n{k}", k / 2) for k in range(100)] + [(None, None, None)])
    spark.dataSource.register(SqliteSource)
    read = spark.read.format("sqlite").option("path", path)
    whole = read.options(query="select * from t", camelCase="true").load()
    assert whole.columns == ["userId", "fullName", "x"] and whole.count() == 101
    few = read.options(query="select user_id, x from t where user_id > ?", params="[97]", camelCase="false").load()
    assert sorted(map(tuple, few.collect())) == [(98, 49.0), (99, 49.5)]
    parts = spark.read.format("sqlite").options(path=path, query="select * from t", partitionColumn="user_id", lowerBound="0", upperBound="50", numPartitions="4").load()
    assert parts.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in parts.collect() if r[0] is not None) == list(range(100)) and parts.count() == 101


@pytest.mark.parametrize("name, camel", [("user_id", "userId"), ("id", "id"), ("a_b_c", "aBC")])
def test_camel_case(name, camel):
    assert camel_case(name) == camel
