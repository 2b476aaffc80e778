"""Catalogue queries that go through the engine's own statements, streams and applications."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.acl import RowAcl
from tamarix.catalogue import _DOT, _query_vector, query, table
from tamarix.operators import collections, files, relational, retrieval
from tamarix.session import shared_folder
from tamarix.sources.cluster import Cluster
from tamarix.sources.registry import Registry
from tamarix.sources.store import Session, Store
from tamarix.streaming import dataflow, pubsub


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def opened(spark, sf_dir: str, *names: str) -> Session:
    """A session of a new store with external tables over the given files."""
    session = Store(spark, folder(spark, "store"), "shop").session()
    for name in names:
        session.execute(f"CREATE EXTERNAL TABLE {name} STORED AS parquet LOCATION '{sf_dir}/{name}.parquet'")
    return session


def statements(name: str, tables: tuple[str, ...], script: list, oracle: str):
    """Register a script of statements; the last one is the query."""

    def run(spark, sf_dir) -> DataFrame:
        session = opened(spark, sf_dir, *tables)
        for line in script[:-1]:
            session.execute(*((line,) if isinstance(line, str) else line))
        last = script[-1]
        return session.execute(*((last,) if isinstance(last, str) else last))

    query(name, oracle)(run)


_OWN = "CREATE TABLE own AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"

statements("store_insert", ("orders",), ["CREATE TABLE own (k INT8 PRIMARY KEY, status VARCHAR(1) NOT NULL, price FLOAT8, note TEXT)", "INSERT INTO own (k, status, price) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "SELECT k, status, price, note FROM public.own"], "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS note FROM orders")
statements("store_update", ("orders",), [_OWN, "UPDATE own SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_orderstatus = 'P' OR o_totalprice < 5000", "SELECT * FROM own"], "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice < 5000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' OR o_totalprice < 5000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
statements("store_delete", ("orders",), [_OWN, "DELETE FROM own WHERE o_custkey % 3 = 0 AND own.o_orderstatus <> 'F'", "SELECT * FROM own"], "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus <> 'F')")
statements("store_returning", ("orders",), [_OWN, "DELETE FROM own WHERE o_totalprice > 400000 RETURNING o_orderkey, o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
statements("store_overwrite", ("orders",), [_OWN, "INSERT OVERWRITE own SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM own"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
statements("store_upsert", ("supplier",), ["CREATE TABLE own (s_suppkey INT8 UNIQUE, s_acctbal FLOAT8)", "INSERT INTO own SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0", "INSERT INTO own SELECT s_suppkey, 1.5 FROM supplier WHERE s_suppkey % 3 = 0 ON CONFLICT (s_suppkey) DO UPDATE SET s_acctbal = own.s_acctbal + excluded.s_acctbal", "SELECT * FROM own"], "SELECT s_suppkey, CASE WHEN s_suppkey % 2 <> 0 THEN 1.5 WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
statements("store_transaction", ("nation",), ["CREATE TABLE own (k INT, name TEXT)", "BEGIN", "INSERT INTO own SELECT n_nationkey, n_name FROM nation", "COMMIT", "BEGIN", "DELETE FROM own", "ROLLBACK", "SELECT * FROM own"], "SELECT n_nationkey AS k, n_name AS name FROM nation")
statements("store_alter", ("nation",), ["CREATE TABLE own AS SELECT n_nationkey FROM nation WHERE n_nationkey < 10", "ALTER TABLE own ADD COLUMN name TEXT, ADD COLUMN at TIMESTAMP", "INSERT INTO own (n_nationkey, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10", "SELECT n_nationkey, name, at IS NULL AS no_time FROM own"], "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS name, true AS no_time FROM nation")
statements("store_index_lookup", ("orders",), [_OWN, "CREATE INDEX by_customer ON own (o_custkey)", ("SELECT o_orderkey, o_custkey FROM own WHERE o_custkey = $1", [7])], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
statements("store_ctid", ("orders",), [_OWN, "DELETE FROM own WHERE o_orderstatus = 'P'", "SELECT count(*) AS n, count(DISTINCT ctid) = count(*) AS each_its_own, min(ctid) >= 1 AS from_one FROM own"], "SELECT count(*) AS n, true AS each_its_own, true AS from_one FROM orders WHERE o_orderstatus <> 'P'")
statements("store_information_schema", ("nation", "region"), ["SELECT table_name, column_name, ordinal_position FROM information_schema.columns"], "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
statements("store_names", ("nation",), ['SELECT "n_name" AS "a name", current_schema() AS schema_name FROM shop.public.nation'], "SELECT n_name AS \"a name\", 'public' AS schema_name FROM nation")
statements("store_parameters", ("orders",), [("SELECT o_orderkey FROM orders WHERE o_orderstatus = {{ wanted.status }} AND o_orderdate < $1", [datetime.datetime(1995, 6, 17)], {"wanted": {"status": "F"}})], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-06-17'")
statements("store_distinct_on", ("orders",), ["SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"], "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
statements("store_qualify", ("orders",), ["SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2"], "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
statements("store_patterns", ("part",), ["SELECT p_partkey, p_name ~ '^s.*t$' AS a, p_name !~* 'BOLT' AS b, p_type SIMILAR TO '(S|P)%' AS c, p_name ILIKE 'S%' AS d FROM part"], "SELECT p_partkey, regexp_matches(p_name, '^s.*t$') AS a, NOT regexp_matches(p_name, 'BOLT', 'i') AS b, regexp_full_match(p_type, '(S|P).*') AS c, p_name ILIKE 'S%' AS d FROM part")
statements("store_strings", ("part",), ["SELECT p_partkey, strpos(p_name, 't') AS s, initcap(p_type) AS i, octet_length(p_name) AS o, btrim(concat(' ', p_brand, NULL, ' ')) AS b, starts_with(p_name, 'small') AS w, to_hex(p_size) AS h, regexp_replace(p_name, '[aeiou]', '#') AS r, sha256(p_brand) AS d, overlay(p_brand PLACING 'xx' FROM 1 FOR 2) AS v, chr(65 + p_size % 26) AS c FROM part"], "SELECT p_partkey, strpos(p_name, 't') AS s, upper(left(p_type, 1)) || lower(substring(p_type, 2)) AS i, strlen(p_name) AS o, trim(concat(' ', p_brand, NULL, ' ')) AS b, starts_with(p_name, 'small') AS w, lower(to_hex(p_size)) AS h, regexp_replace(p_name, '[aeiou]', '#') AS r, sha256(p_brand) AS d, 'xx' || substring(p_brand, 3) AS v, chr(65 + p_size % 26) AS c FROM part")
statements("store_dates", ("orders",), ["SELECT o_orderkey, date_bin('7 days', o_orderdate, TIMESTAMP_NTZ'1992-01-01 00:00:00') AS week, date_part('year', o_orderdate) AS y, to_char(o_orderdate, 'yyyy/MM') AS m FROM orders"], "SELECT o_orderkey, time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1992-01-01 00:00:00') AS week, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y/%m') AS m FROM orders")
statements("store_numbers", ("part",), ["SELECT p_partkey, trunc(p_retailprice, 1) AS t, round(cbrt(p_size), 6) AS c, factorial(p_size % 15) AS f, round(degrees(p_size), 4) AS d, mod(p_size, 7) AS m, p_size::float8 / 4 AS q FROM part"], "SELECT p_partkey, trunc(p_retailprice * 10) / 10 AS t, round(cbrt(p_size), 6) AS c, CAST(factorial(p_size % 15) AS BIGINT) AS f, round(degrees(p_size), 4) AS d, p_size % 7 AS m, CAST(p_size AS DOUBLE) / 4 AS q FROM part")
statements("store_arrays", ("nation",), ["SELECT n_nationkey, array_length([n_nationkey, n_regionkey, 7], 1) AS n, array_to_string(array_append([n_name], 'z'), '-') AS j, array_position([5, 6, 7], 6) AS p, cardinality(array_distinct([1, 1, n_regionkey])) AS c, array_to_string(array_slice(['a', 'b', 'c', 'd'], 2, 3), '') AS s, element_at(map('k', n_name), 'k') AS m, named_struct('f', n_regionkey).f AS f FROM nation"], "SELECT n_nationkey, CAST(3 AS INTEGER) AS n, n_name || '-z' AS j, CAST(2 AS BIGINT) AS p, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS c, 'bc' AS s, n_name AS m, n_regionkey AS f FROM nation")
statements("store_aggregates", ("nation", "lineitem"), ["SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, array_to_string(array_agg(n_name ORDER BY n_nationkey), ',') AS listed FROM nation GROUP BY n_regionkey"], "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, string_agg(n_name, ',' ORDER BY n_nationkey) AS listed FROM nation GROUP BY n_regionkey")
statements("agg_more", ("lineitem",), ["SELECT l_returnflag, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(covar_samp(l_quantity, l_tax), 8) AS cs, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS pd, bool_and(l_quantity > 0) AS every_one FROM lineitem GROUP BY l_returnflag"], "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(covar_samp(l_quantity, l_tax), 8) AS cs, quantile_disc(l_quantity, 0.5) AS pd, bool_and(l_quantity > 0) AS every_one FROM lineitem GROUP BY l_returnflag")
statements("fn_json_more", ("events",), ["SELECT event_id, try_variant_get(parse_json(props), '$.k', 'bigint') AS k, from_json(props, 'k BIGINT').k AS k2, try_parse_json(concat('{', props)) IS NULL AS broken, json_object_keys(props)[0] AS name FROM events"], "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k2, true AS broken, json_keys(props)[1] AS name FROM events")


@query("store_l2_sql", f"SELECT e.vec_id, round({_DOT}, 3) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {_DOT} > 0.1")
def store_l2_sql(spark, sf_dir):
    text = "[" + ",".join(repr(float(x)) for x in _query_vector(spark, sf_dir)) + "]"
    return opened(spark, sf_dir, "embeddings").execute("SELECT vec_id, round(CAST(l2(embedding, $1) AS FLOAT8), 3) AS score FROM embeddings WHERE l2(embedding, $1) > 0.1", [text])


@query("store_nearest", "SELECT e.vec_id, round(-sqrt(list_sum(list_transform(range(1, 65), lambda i: power(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 10")
def store_nearest(spark, sf_dir):
    session = opened(spark, sf_dir, "embeddings")
    size = len(_query_vector(spark, sf_dir))
    session.execute(f"CREATE TABLE own (vec_id INT8, label INT, embedding VECTOR({size}))")
    session.execute("INSERT INTO own SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id")
    session.execute(f"CREATE INDEX near ON own USING hnsw (embedding) WITH (metric = 'l2', namespace = 'label', m = 12, ef_construction = 60, ef = 30, dim = {size})")
    return session.nearest("own", _query_vector(spark, sf_dir), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("store_time_travel", "SELECT n_nationkey FROM nation")
def store_time_travel(spark, sf_dir):
    session = opened(spark, sf_dir, "nation")
    session.execute("CREATE TABLE own AS SELECT n_nationkey FROM nation")
    then = session.store.latest()
    session.execute("DELETE FROM own WHERE n_nationkey > 3")
    return session.store.session(version=then).execute("SELECT n_nationkey FROM own")


@query("store_restore", "SELECT n_nationkey FROM nation WHERE n_nationkey < 5")
def store_restore(spark, sf_dir):
    session = opened(spark, sf_dir, "nation")
    session.execute("CREATE TABLE own AS SELECT n_nationkey FROM nation WHERE n_nationkey < 5")
    label = session.store.checkpoint()
    session.execute("DROP TABLE own")
    session.store.restore(label)
    return session.store.session().execute("SELECT n_nationkey FROM own")


@query("store_copy", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_copy(spark, sf_dir):
    session, path = opened(spark, sf_dir, "supplier"), folder(spark, "copy")
    session.execute(f"COPY (SELECT s_suppkey, s_name, s_acctbal FROM supplier) TO '{path}' WITH (FORMAT csv, header true)")
    session.execute("CREATE TABLE own (s_suppkey INT8, s_name TEXT, s_acctbal FLOAT8)")
    session.execute(f"COPY own FROM '{path}' WITH (FORMAT csv, header true)")
    return session.execute("SELECT * FROM own")


@query("store_database", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def store_database(spark, sf_dir):
    cluster = Cluster(spark, folder(spark, "cluster"))
    cluster.create("east")
    cluster.session("east").execute("CREATE DATABASE west")
    west = cluster.session("west")
    west.execute(f"CREATE EXTERNAL TABLE nation STORED AS parquet LOCATION '{sf_dir}/nation.parquet'")
    return west.execute("SELECT n_name FROM west.public.nation WHERE n_regionkey = 2")


@query("store_functions", "SELECT n_nationkey, upper(n_name) || '!' AS shout FROM nation")
def store_functions(spark, sf_dir):
    session = opened(spark, sf_dir, "nation")

    @F.pandas_udf("string")
    def shout(names):
        return names.str.upper() + "!"

    session.register("shout", shout, "string")
    return session.execute("SELECT n_nationkey, shout(n_name) AS shout FROM nation")


@query("store_procedure", "SELECT CAST(count(*) AS BIGINT) AS data FROM orders WHERE o_custkey = 7")
def store_procedure(spark, sf_dir):
    session = opened(spark, sf_dir, "orders")
    session.procedures["orders_of"] = lambda k: session.execute("SELECT count(*) AS n FROM orders WHERE o_custkey = $1", [k]).first()[0]
    return session.execute("EXECUTE orders_of(7)")


@query("store_named_source", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def store_named_source(spark, sf_dir):
    registry = Registry(spark, opened(spark, sf_dir, "orders").execute)
    registry.sql("orders_of", "SELECT o_orderkey FROM orders WHERE o_custkey = {{ customer }}")
    return registry.run("orders_of", {"customer": 7})


@query("acl_statements", "SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_nationkey = 4 AND c_acctbal < 1000)")
def acl_statements(spark, sf_dir):
    owner = opened(spark, sf_dir, "customer")
    owner.execute("CREATE TABLE own AS SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
    rules = RowAcl([("ann", "own", "select", "*"), ("ann", "own", "update", "c_nationkey = 3"), ("ann", "own", "delete", "c_nationkey = 4")])
    ann = owner.store.session(user="ann", acl=rules)
    ann.execute("UPDATE own SET c_acctbal = 0 WHERE c_acctbal < 0")
    ann.execute("DELETE FROM own WHERE c_acctbal < 1000")
    return ann.execute("SELECT c_custkey, c_acctbal FROM own")


@query("acl_loaded", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 5")
def acl_loaded(spark, sf_dir):
    rows = [("ann", '{"filters": [{"command": "select", "table": "customer", "condition": "c_nationkey = 3"}]}'), ("public", '{"filters": [{"command": "*", "table": "customer", "condition": "c_nationkey = 5"}]}')]
    acl = RowAcl.load(spark.createDataFrame(rows, "user_id string, metadata string"))
    return acl.bound(spark, "ann", {"customer": table(spark, sf_dir, "customer")})("SELECT c_custkey FROM customer")


# Applications


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.when(F.col("label") % 3 > 0, F.col("label")).alias("directory_id"), F.lit(10).alias("chunk_start"), F.lit(40).alias("chunk_end"), "embedding")


@query("search_scope", f"""WITH c AS (SELECT e.vec_id AS file_id, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 3 > 0 AND (e.label IN (1, 2) OR e.vec_id IN (5, 8, 11, 14)) ORDER BY 2 DESC, 1 LIMIT 20),
 f AS (SELECT c.file_id, score, text, row_number() OVER (PARTITION BY md5(text) ORDER BY c.file_id) AS k FROM c JOIN documents d ON d.doc_id = c.file_id WHERE score > 0.1)
 SELECT f.file_id, round(score, 6) AS score, CASE WHEN f.file_id % 4 = 1 AND f.file_id // 4 IN (SELECT doc_id FROM documents) THEN f.file_id // 4 ELSE f.file_id END AS original_id FROM f WHERE k = 1""")
def search_scope(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 1, F.floor(F.col("doc_id") / 4)).alias("parent_id"), F.lit(False).alias("is_directory"))
    found = retrieval.search(_chunks(spark, sf_dir), held, _query_vector(spark, sf_dir), scope=retrieval.in_scope([1, 2], [5, 8, 11, 14]))
    return found.select("file_id", F.round("score", 6).alias("score"), "original_id")


@query("search_federated", "SELECT 'first' AS app, n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'second', s_name FROM supplier WHERE s_nationkey = 0")
def search_federated(spark, sf_dir):
    first = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("name"))
    second = table(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_name").alias("name"))
    return retrieval.federated({"first": first, "second": second}).select("app", "name")


@query("collection_top_k", f"SELECT e.vec_id AS doc_id, round({_DOT}, 6) AS score, substring(d.text, 11, 20) AS content FROM embeddings e, embeddings q, documents d WHERE q.vec_id = 0 AND d.doc_id = e.vec_id AND e.label = 2 AND d.lang = 'en' AND {_DOT} >= -10 ORDER BY {_DOT} DESC, e.vec_id LIMIT 5")
def collection_top_k(spark, sf_dir):
    english = table(spark, sf_dir, "documents").where("lang = 'en'")
    docs = english.select(F.lit("c").alias("collection"), "doc_id", F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("content"), F.col("text").alias("__text"))
    parts = table(spark, sf_dir, "embeddings").where("label = 2").join(english.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    parts = parts.select(F.lit("c").alias("collection"), F.col("vec_id").alias("doc_id"), F.lit(10).alias("start"), F.lit(30).alias("end"), "embedding")
    found = collections.top_k(docs, parts, "c", _query_vector(spark, sf_dir), 5, min_score=-10.0)
    return found.join(docs.select("doc_id", "__text"), "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.substring("__text", 11, 20).alias("content"))


def _files(spark, sf_dir):
    """Regions, nations and customers as a tree of files; customers without money are archived."""
    shape = ["id", "name", "parent_id", "is_directory", "archived_at"]
    none = F.lit(None).cast("timestamp_ntz")
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("f"), "r_regionkey"), "r_name", F.lit(None).cast("string"), F.lit(True), none).toDF(*shape)
    middle = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), "n_regionkey", F.lit("-"), "n_nationkey"), "n_name", F.concat(F.lit("f"), "n_regionkey"), F.lit(True), none).toDF(*shape)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    people = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    parent = F.concat(F.lit("f"), "n_regionkey", F.lit("-"), "n_nationkey")
    low = people.select(F.concat(parent, F.lit("-"), "c_custkey"), "c_name", parent, F.lit(False), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp_ntz"))).toDF(*shape)
    return top.union(middle).union(low)


@query("file_children", "SELECT 'f1-' || c_nationkey || '-' || c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) AND c_acctbal >= 0")
def file_children(spark, sf_dir):
    first = table(spark, sf_dir, "nation").where("n_regionkey = 1").agg(F.min("n_nationkey")).first()[0]
    return files.children(_files(spark, sf_dir), f"f1-{first}").select("id", "name")


@query("file_sub_directories", "SELECT 'f1' AS id, 0 AS depth UNION ALL SELECT 'f1-' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1")
def file_sub_directories(spark, sf_dir):
    return files.sub_directories(_files(spark, sf_dir), "f1")


@query("file_subtree_delete", "SELECT count(*) AS gone FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 OR c_acctbal < 0")
def file_subtree_delete(spark, sf_dir):
    held = _files(spark, sf_dir)
    gone, _ = files.soft_deleted(held, held.select(F.col("id").alias("file_id")), "f1", F.lit("2025-01-01").cast("timestamp_ntz"))
    return gone.where("archived_at IS NOT NULL AND NOT is_directory").agg(F.count("*").alias("gone"))


@query("chat_window", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")
def chat_window(spark, sf_dir):
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("k", back).where("k <= 2").select("conv_id", "turn", "role")


@query("worst_per_label", f"SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_DOT}, e.vec_id) AS k FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE k <= 4")
def worst_per_label(spark, sf_dir):
    from tamarix.functions import vector

    scored = table(spark, sf_dir, "embeddings").withColumn("score", vector.dot(F.col("embedding"), vector.vector(_query_vector(spark, sf_dir))))
    return vector.best_per_group(scored, "label", "score", 4, "vec_id", worst=True).select("label", "vec_id")


@query("unique_by_content", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def unique_by_content(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)), "h", "doc_id").select("doc_id")


# Streams


def _drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has to say about the input that is there."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _event_stream(spark, sf_dir, path: str) -> DataFrame:
    """The events as a stream of files."""
    table(spark, sf_dir, "events").write.parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")


@query("stream_barrier", """SELECT user_id, max(v) FILTER (WHERE event_type = 'view') AS view_value, max(v) FILTER (WHERE event_type = 'purchase') AS purchase_value FROM (
 SELECT user_id, event_type, value AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'purchase')) WHERE k = 1 GROUP BY user_id HAVING count(*) = 2""")
def stream_barrier(spark, sf_dir):
    path = folder(spark, "barrier")
    events = _event_stream(spark, sf_dir, path).select(F.col("user_id").alias("run"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    found = _drained(dataflow.barrier_stream(events, ["view", "purchase"]), path)
    return found.select(F.col("run").alias("user_id"), F.col("view").alias("view_value"), F.col("purchase").alias("purchase_value"))


@query("stream_deduplicated", "SELECT event_id FROM events")
def stream_deduplicated(spark, sf_dir):
    path = folder(spark, "dedupe")
    events = _event_stream(spark, sf_dir, path).select("event_id", F.lit(0).alias("reference_id"), F.col("event_id").alias("seq_id"))
    return _drained(dataflow.deduplicated(events.union(events)), path).select("event_id")


@query("stream_joined", "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view'")
def stream_joined(spark, sf_dir):
    path = folder(spark, "joined")
    events = _event_stream(spark, sf_dir, path).select("event_id", "user_id", "ts", "event_type")
    both = pubsub.joined(events.where("event_type = 'view'").drop("event_type"), events.where("event_type = 'purchase'").drop("event_type"), "user_id", "ts", "2 HOURS", lateness="3650 days")
    return _drained(both, path).select(F.col("event_id").alias("view_id"), F.col("right_event_id").alias("purchase_id"))


@query("pubsub_subscribed", "SELECT event_id AS seq FROM events WHERE event_type = 'click'")
def pubsub_subscribed(spark, sf_dir):
    path = folder(spark, "exchange")
    exchange = pubsub.Exchange(spark, path)
    exchange.publish("c", table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("source"), F.lit(None).cast("string").alias("path"), F.col("props").alias("data")))
    return _drained(exchange.subscribe("c", source="click"), f"{path}-out").select("seq")


@query("stream_replayed", "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS position FROM events")
def stream_replayed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stream_no"), F.col("event_id").alias("seq"))
    return pubsub.replayed(events).select("event_id", "position")


@query("graph_compiled", "SELECT n_name AS node, r_name AS from_node FROM nation JOIN region ON r_regionkey = n_regionkey")
def graph_compiled(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit("source").alias("type"))
    nations = table(spark, sf_dir, "nation")
    nodes = regions.union(nations.select("n_name", F.lit("sink")))
    edges = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("from_node"), F.lit("out").alias("from_key"), F.col("n_name").alias("to_node"), F.lit("in").alias("to_key"), F.lit(1).alias("edge_no"))
    return pubsub.compiled(nodes, edges, ["source", "sink"]).select("node", "from_node")
