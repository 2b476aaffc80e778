"""The store's statements beyond plain changes."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarix import errors
from tamarix.acl import RowAcl
from tamarix.privileges import Privilege
from tamarix.sources.cluster import Cluster
from tamarix.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "shop"))


@pytest.fixture
def s(store):
    s = store.session()
    s.execute("CREATE TABLE item (id INT PRIMARY KEY, label VARCHAR(5), tags JSONB, stock INT4)")
    s.execute("INSERT INTO item (id, label, stock) VALUES (1, 'one', 10), (2, 'two', 20), (3, 'three', 30)")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_are_resolved_with_their_schema(s):
    assert rows(s.execute("SELECT count(*) AS n FROM shop.public.item")) == [(3,)]
    assert rows(s.execute('SELECT "label" FROM public.item WHERE id = 1')) == [("one",)]
    for bad in ("DROP TABLE nowhere.item", "SELECT * FROM nowhere.item", "SELECT * FROM other.public.item", "INSERT INTO other.public.item (id) VALUES (9)"):
        with pytest.raises(errors.UndefinedTable):
            s.execute(bad)
    assert rows(s.execute("SELECT 'public.item' AS x")) == [("public.item",)]


def test_values_that_do_not_fit_are_refused(s):
    for bad, error in (("INSERT INTO item (id, label) VALUES (4, 'longer')", errors.TooLong), ("INSERT INTO item (id, tags) VALUES (4, '{oops')", errors.InvalidText), ("UPDATE item SET label = 'longer' WHERE id = 1", errors.TooLong)):
        with pytest.raises(error):
            s.execute(bad)
    assert s.execute("INSERT INTO item (id, label, tags) VALUES (4, 'fours', '{\"a\": 1}')").first()[0] == 1
    s.execute("CREATE TABLE v (e VECTOR(4))")
    with pytest.raises(errors.TooLong):
        s.execute("INSERT INTO v VALUES ('[1, 2, 3]')")


def test_failed_statements_leave_no_trace(store, s):
    count = lambda: sum(len(store.fs.listStatus(f.getPath())) for f in store.fs.listStatus(store._path("data")))
    s.execute("BEGIN")
    before = count()
    for bad in ("ALTER TABLE item ADD COLUMN note TEXT, ADD COLUMN label TEXT", "INSERT INTO item (id) VALUES (9), (9)", "INSERT INTO item (id) SELECT CAST(label AS INT) FROM item"):
        with pytest.raises(Exception):
            s.execute(bad)
    assert "note" not in s.table("item").columns and s.table("item").count() == 3
    s.execute("INSERT INTO item (id) VALUES (9)")
    s.execute("ROLLBACK")
    after = [f for d in store.fs.listStatus(store._path("data")) for f in store.fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet")]
    assert len(after) <= before and s.table("item").count() == 3


def test_ctid_rises_and_stays(s):
    first = dict(rows(s.execute("SELECT id, ctid FROM item")))
    assert len(set(first.values())) == 3 and min(first.values()) >= 1 and "ctid" not in s.execute("SELECT * FROM item").columns
    s.execute("UPDATE item SET stock = 0 WHERE id = 2")
    s.execute("INSERT INTO item (id) VALUES (7)")
    later = dict(rows(s.execute("SELECT id, ctid FROM item")))
    assert {k: later[k] for k in first} == first and later[7] > max(first.values())
    assert s.execute(f"DELETE FROM item WHERE ctid = {later[7]}").first()[0] == 1


def test_overwrite_ctas_upsert_returning(s):
    s.execute("CREATE TABLE copy AS SELECT id, label, stock * 2 AS twice FROM item WHERE id > 1")
    assert rows(s.execute("SELECT * FROM copy")) == [(2, "two", 40), (3, "three", 60)]
    s.execute("INSERT OVERWRITE copy SELECT 5, 'five', 0")
    assert rows(s.execute("SELECT * FROM copy")) == [(5, "five", 0)]
    assert rows(s.execute("INSERT INTO item (id, label) VALUES (8, 'new') RETURNING id, upper(label) AS up")) == [(8, "NEW")]
    assert rows(s.execute("UPDATE item SET stock = stock + 1 WHERE id < 3 RETURNING id, stock")) == [(1, 11), (2, 21)]
    assert rows(s.execute("DELETE FROM item WHERE id = 8 RETURNING label")) == [("new",)]
    assert s.execute("INSERT INTO item (id, label) VALUES (1, 'x'), (9, 'y') ON CONFLICT (id) DO NOTHING").first()[0] == 1
    done = s.execute("INSERT INTO item (id, stock) VALUES (1, 5), (10, 6) ON CONFLICT (id) DO UPDATE SET stock = item.stock + excluded.stock RETURNING id, stock")
    assert rows(done) == [(1, 16), (10, 6)]
    assert rows(s.execute("SELECT id, label, stock FROM item")) == sorted([(1, "one", 16), (2, "two", 21), (3, "three", 30), (9, "y", None), (10, None, 6)], key=str)
    with pytest.raises(errors.UniqueViolation):
        s.execute("INSERT INTO item (id) VALUES (1), (1) ON CONFLICT (id) DO UPDATE SET stock = 0")


def test_an_index_orders_the_files(store, s):
    s.execute("INSERT INTO item (id, stock) SELECT CAST(k AS INT), CAST(1000 - k AS INT) FROM generate_series(100, 400) AS t(k)")
    s.execute("CREATE INDEX by_stock ON item (stock)")
    for f in s.tables["item"]["files"]:
        stock = [r.stock for r in store.read(s.tables["item"], [f]).collect()]
        assert stock == sorted(stock, key=lambda x: (x is not None, x))
    plan = s.execute("SELECT id FROM item WHERE stock = 700")._jdf.queryExecution().toString()
    assert "EqualTo(stock,700)" in plan.replace(" ", "") and "ReadSchema: struct<id:int,stock:int>" in plan
    assert rows(s.execute("SELECT id FROM item WHERE stock = 700")) == [(300,)]


def test_nearest_uses_the_index_options(s):
    s.execute("CREATE TABLE v (id INT, owner TEXT, e VECTOR(4))")
    s.execute("INSERT INTO v VALUES (1, 'a', '[3, 0, 0, 0]'), (2, 'a', '[1, 1, 0, 0]'), (3, 'b', '[0, 0, 9, 0]'), (4, 'b', NULL)")
    assert [r.id for r in s.nearest("v", [1, 1, 0, 0], 2, column="e").collect()] == [1, 2]
    s.execute("CREATE INDEX near ON v USING hnsw (e) WITH (metric = 'l2', namespace = 'owner', m = 8, ef_construction = 50, ef = 20, dim = 4)")
    assert [r.id for r in s.nearest("v", [1, 1, 0, 0], 2).collect()] == [2, 1]
    assert [r.id for r in s.nearest("v", [1, 1, 0, 0], 5, namespace="b").collect()] == [3]
    assert [r.id for r in s.execute("SELECT id FROM v WHERE l2(e, '[1, 1, 1, 1]') < 3 ORDER BY l2(e, '[1, 1, 1, 1]') LIMIT 1").collect()] == [2]
    with pytest.raises(Exception):
        s.execute("SELECT l2(e, '[1]') AS x FROM v").collect()


def test_row_rules_hold_for_every_statement(store, s, spark, tmp_path):
    acl = RowAcl([("ann", "item", "select", "id <= 2"), ("ann", "item", "update", "id = 1"), ("ann", "item", "delete", "id = 2"), ("bob", "item", "select", "*"), ("bob", "item", "insert", "*")])
    ann, bob = store.session(user="ann", acl=acl), store.session(user="bob", acl=acl)
    assert rows(ann.execute("SELECT id FROM item WHERE id = 3 OR id = 1")) == [(1,)]
    assert rows(ann.execute("SELECT a.id FROM item a JOIN item b ON a.id + 1 = b.id")) == [(1,)]
    assert ann.execute("UPDATE item SET stock = 0").first()[0] == 1 and ann.execute("DELETE FROM item WHERE id = 2 OR id = 3").first()[0] == 1
    assert rows(s.execute("SELECT id, stock FROM item")) == [(1, 0), (3, 30)]
    for session, bad in ((ann, "INSERT INTO item (id) VALUES (5)"), (bob, "UPDATE item SET id = 0"), (bob, "DELETE FROM item")):
        with pytest.raises(errors.PrivilegeError):
            session.execute(bad)
    assert bob.execute("INSERT INTO item (id) SELECT max(id) + 1 FROM item").first()[0] == 1
    path = str(tmp_path / "shop" / s.tables["item"]["files"][0])
    spark.range(3).createOrReplaceGlobalTempView("leak")
    spark.range(3).write.mode("overwrite").saveAsTable("leak_table")
    try:
        for hole in (f"SELECT * FROM parquet.`{path}`", "SELECT * FROM global_temp.leak", "SELECT * FROM leak_table", "SELECT * FROM item WHERE id IN (SELECT id FROM leak_table)", "WITH x AS (SELECT 1) INSERT INTO item (id) VALUES (6)"):
            for run in (ann.execute, lambda q: acl.query(spark, "ann", q, {"item": s.table("item")})):
                with pytest.raises(Exception):
                    run(hole).collect()
    finally:
        spark.sql("DROP TABLE leak_table")
        spark.catalog.dropGlobalTempView("leak")


def test_rules_are_loaded_and_merged(spark):
    metadata = '{"filters": [{"command": "select", "table": "t", "condition": "id = 1"}, {"command": "*", "table": "u", "condition": "*"}]}'
    acl = RowAcl.load(spark.createDataFrame([("ann", metadata), ("ann", '{"filters": [{"command": "select", "table": "t", "condition": "id = 3"}]}'), ("bob", "{}")], "user_id string, metadata string"))
    t = spark.range(5)
    assert sorted(r.id for r in acl.bound(spark, "ann", {"t": t})("SELECT id FROM t").collect()) == [1, 3]
    assert acl.has_access("ann", "u", "delete") and not acl.has_access("ann", "t", "delete") and acl.has_any_access("ann", "insert") and not acl.has_any_access("bob", "select")
    assert [acl.has_access("ann", "u", c) for c in ("select", "insert", "update", "delete")] == [True] * 4
    with pytest.raises(errors.PrivilegeError):
        acl.query(spark, "ann", "CREATE TABLE x (id INT)", {"t": t})


def test_versions_checkpoints_and_vacuum(store, s):
    then = store.latest()
    label = store.checkpoint()
    s.execute("DELETE FROM item WHERE id > 1")
    old = store.session(version=then)
    assert old.table("item").count() == 3 and s.table("item").count() == 1
    with pytest.raises(errors.TransactionStateError):
        old.execute("DELETE FROM item")
    s.execute("INSERT OVERWRITE item SELECT 4, 'x', NULL, 1")
    assert store.vacuum(older_than=0) >= 1 and store.session(version=then).table("item").count() == 3
    store.restore(label)
    assert sorted(r.id for r in store.session().table("item").collect()) == [1, 2, 3]
    with pytest.raises(errors.UndefinedTable):
        store.restore("no such")


def test_information_schema(store, s):
    got = rows(s.execute("SELECT column_name, is_nullable, data_type, character_maximum_length FROM information_schema.columns WHERE table_name = 'item'"))
    assert ("id", "NO", "int", None) in got and ("label", "YES", "varchar", 5) in got and len(got) == 4
    assert rows(s.execute("SELECT t.table_name, x.index_name FROM information_schema.tables t JOIN information_schema.statistics x USING (table_name)")) == [("item", "item_id_key")]
    with pytest.raises(errors.PrivilegeError):
        store.session(Privilege.READ_ONLY).execute("SELECT * FROM information_schema.tables")


def test_functions_procedures_and_handlers(spark, s):
    from pyspark.sql.functions import udtf

    s.register("shout", lambda x: x.upper() + "!", "string")

    @udtf(returnType="n int")
    class Countdown:
        def eval(self, start: int):
            for k in range(start, 0, -1):
                yield (k,)

    s.register_table_function("countdown", Countdown)
    s.procedures["add"] = lambda a, b: a + b
    s.procedures["labels"] = lambda: s.execute("SELECT label FROM item")
    s.handlers.append(lambda session, q: spark.range(2) if q.lower() == "ping" else None)
    assert rows(s.execute("SELECT shout(label) AS x FROM item WHERE id = 1")) == [("ONE!",)]
    assert rows(s.execute("SELECT n FROM countdown(3)")) == [(1,), (2,), (3,)]
    assert rows(s.execute("EXECUTE add(2, 3)")) == [(5,)] and rows(s.execute("EXECUTE shout('a')")) == [("A!",)] and s.execute("EXECUTE labels()").count() == 3
    assert s.execute("PING").count() == 2
    s.memory["held"] = spark.createDataFrame([(1, 4.0), (1, 6.0), (3, 1.0)], "id int, x double")

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    s.register("spread", spread, "double")
    assert rows(s.execute("SELECT i.label, spread(h.x) AS r FROM held h JOIN item i ON i.id = h.id GROUP BY i.label")) == [("one", 2.0), ("three", 0.0)]
    for bad, error in (("EXECUTE nothing(1)", errors.UndefinedTable), ("VACUUM", errors.SyntaxError_)):
        with pytest.raises(error):
            s.execute(bad)


def test_advisory_locks(store):
    a, b = store.session(), store.session()
    assert a.execute("SELECT pg_advisory_lock(7)").count() == 0
    with pytest.raises(errors.TransactionStateError):
        a.execute("SELECT pg_advisory_lock(8)")
    with pytest.raises(errors.TransactionStateError):
        b.execute("SELECT pg_advisory_unlock(7)")
    order = []
    waiting = threading.Thread(target=lambda: (b.execute("SELECT pg_advisory_lock(7)"), order.append("b")))
    waiting.start()
    waiting.join(0.5)
    order.append("a")
    a.execute("SELECT pg_advisory_unlock(7)")
    waiting.join(20)
    assert order == ["a", "b"]
    b.execute("SELECT pg_advisory_unlock(7)")


def test_files_in_and_out(s, tmp_path, spark):
    for kind in ("csv", "json", "parquet", "orc"):
        assert s.execute(f"COPY (SELECT id, label FROM item) TO '{tmp_path}/{kind}' WITH (FORMAT {kind})").first()[0] == 3
        s.execute(f"CREATE TABLE from_{kind} (id INT, label TEXT)")
        assert s.execute(f"COPY from_{kind} FROM '{tmp_path}/{kind}' WITH (FORMAT '{kind}')").first()[0] == 3
        s.execute(f"CREATE EXTERNAL TABLE out_{kind} (id INT, label TEXT) STORED AS {kind} LOCATION '{tmp_path}/{kind}'")
        assert rows(s.execute(f"SELECT * FROM out_{kind}")) == rows(s.execute(f"SELECT * FROM from_{kind}")) == [(1, "one"), (2, "two"), (3, "three")]
    with pytest.raises(errors.SyntaxError_):
        s.execute("DELETE FROM out_csv WHERE id = 1")
    with pytest.raises(errors.PrivilegeError):
        s.store.session(Privilege.READ_ONLY).execute(f"COPY from_csv FROM '{tmp_path}/csv'")


def test_clusters_and_users(spark, tmp_path):
    cluster = Cluster(spark, str(tmp_path / "c"))
    cluster.create("east")
    s = cluster.session("east")
    s.execute("CREATE DATABASE west")
    assert cluster.catalogs() == ["east", "west"]
    with pytest.raises(errors.DuplicateCatalog):
        s.execute("CREATE DATABASE west")
    with pytest.raises(errors.UndefinedCatalog):
        cluster.session("north")
    s.execute("CREATE TABLE t (id INT)")
    assert rows(s.execute("SELECT count(*) AS n FROM east.public.t")) == [(0,)]
    for user in ("ann", "bob"):
        s.execute(f"EXECUTE set_catalog_user_credential('east', '{user}', 'pw of {user}')")
    s.execute("EXECUTE set_catalog_user_credential('east', 'ann', 'changed')")
    assert rows(s.execute("EXECUTE list_catalog_users('east')")) == [("east", "ann"), ("east", "bob")]
    assert cluster.may_enter("east", "ann", "changed") and cluster.may_enter("east", "bob", "pw of bob") and not cluster.may_enter("east", "ann", "pw of ann") and not cluster.may_enter("west", "ann", "changed")
    with pytest.raises(errors.PrivilegeError):
        cluster.store("east").session(Privilege.READ_ONLY, cluster=cluster).execute("CREATE DATABASE x")


def test_many_changes_equal_a_dictionary(s):
    import random

    rng, want = random.Random(7), {1: 10, 2: 20, 3: 30}
    for _ in range(12):
        k, v = rng.randrange(1, 8), rng.randrange(100)
        what = rng.choice(["insert", "update", "delete"])
        if what == "insert":
            if k in want:
                with pytest.raises(errors.UniqueViolation):
                    s.execute("INSERT INTO item (id, stock) VALUES ($1, $2)", [k, v])
            else:
                s.execute("INSERT INTO item (id, stock) VALUES ($1, $2)", [k, v])
                want[k] = v
        elif what == "update":
            assert s.execute("UPDATE item SET stock = $1 WHERE id <= $2", [v, k]).first()[0] == sum(i <= k for i in want)
            want = {i: v if i <= k else x for i, x in want.items()}
        else:
            assert s.execute("DELETE FROM item WHERE id = $1", [k]).first()[0] == (k in want)
            want.pop(k, None)
    assert dict(rows(s.execute("SELECT id, stock FROM item"))) == want
    assert s.table("item").where(F.col("id").isNull()).count() == 0
