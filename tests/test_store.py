import pytest

from tamarix import errors
from tamarix.privileges import Privilege
from tamarix.sources.store import Store, bind


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes(store):
    s = store.session()
    s.execute("CREATE TABLE t (id VARCHAR(50) UNIQUE, name TEXT, age INTEGER)")
    assert rows(s.execute("INSERT INTO t (id, name) VALUES ('a', 'n1'), ('b', 'n2'), (NULL, 'n3'), (NULL, 'n4')")) == [(4,)]
    with pytest.raises(errors.UniqueViolation):
        s.execute("INSERT INTO t (id, name) VALUES ('a', 'again')")
    with pytest.raises(errors.SyntaxError_):
        s.execute("INSERT INTO t VALUES ('c', 'short')")
    assert rows(s.execute("UPDATE public.t SET age = 3, name = concat(name, '!') WHERE t.id = $1", ["a"])) == [(1,)]
    with pytest.raises(errors.UniqueViolation):
        s.execute("UPDATE t SET id = 'a' WHERE id = 'b'")
    assert rows(s.execute("DELETE FROM t WHERE id IS NULL AND name = 'n3'")) == [(1,)]
    assert rows(s.execute("SELECT name, age FROM public.t WHERE id IN ('a', 'b')")) == [("n1!", 3), ("n2", None)]
    s.execute("ALTER TABLE t ADD COLUMN note TEXT, ADD COLUMN at TIMESTAMP")
    assert rows(s.execute("SELECT count(*) AS n, count(note) AS m FROM t")) == [(3, 0)]
    with pytest.raises(errors.UniqueViolation):
        s.execute("INSERT INTO t (id) SELECT id FROM t")
    s.execute("DROP TABLE t")
    with pytest.raises(errors.UndefinedTable):
        s.execute("SELECT * FROM t")


def test_transactions(store):
    a, b = store.session(), store.session()
    a.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    a.execute("CREATE TABLE u (id INT)")
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (1)")
    assert rows(b.execute("SELECT count(*) AS n FROM t")) == [(0,)]
    b.execute("INSERT INTO u VALUES (5)")  # another table: no conflict
    a.execute("COMMIT")
    assert rows(b.execute("SELECT t.id, u.id AS v FROM t, u")) == [(1, 5)]
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (2)")
    b.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(errors.SerializationFailure):
        a.execute("COMMIT")
    a.execute("BEGIN")
    a.execute("DELETE FROM t")
    a.execute("ROLLBACK")
    assert rows(a.execute("SELECT id FROM t")) == [(1,), (2,)]
    with pytest.raises(errors.TransactionStateError):
        a.execute("COMMIT")
    with pytest.raises(errors.NotNullViolation):
        a.execute("INSERT INTO t VALUES (NULL)")


def test_vectors_and_indexes(store):
    s = store.session()
    s.execute("CREATE TABLE v (id VARCHAR(50), e VECTOR(4))")
    s.execute("INSERT INTO v VALUES ('a', '[0.5, 1, 2, 4]')")
    s.execute("INSERT INTO v VALUES ('a', $1)", [[1.0, 0.0, 0.0, 0.0]])
    assert rows(s.execute("SELECT e[3] AS x FROM v")) == [(0.0,), (4.0,)]
    s.execute("CREATE INDEX i ON v USING hnsw (e) WITH (metric = 'cos', M = 24, ef_construction = 90, ef = 35, dim = 4)")
    with pytest.raises(errors.UniqueViolation):
        s.execute("CREATE UNIQUE INDEX k ON v(id)")
    with pytest.raises(errors.SyntaxError_):
        s.execute("CREATE TABLE w (e VECTOR(3))")


def test_privileges_and_parameters(store):
    store.session().execute("CREATE TABLE t (id INT)")
    reader = store.session(Privilege.READ_ONLY)
    assert rows(reader.execute("SELECT * FROM t")) == []
    for statement in ("INSERT INTO t VALUES (1)", "DROP TABLE t", "UPDATE t SET id = 1", "CREATE DATABASE d"):
        with pytest.raises(errors.PrivilegeError):
            reader.execute(statement)
    assert bind("SELECT '$1', $1, {{ a.b }}", ["x'\\"], {"a": {"b": 2}}) == "SELECT '$1', 'x\\'\\\\', 2"
    with pytest.raises(errors.SyntaxError_):
        bind("SELECT $2", [1])
