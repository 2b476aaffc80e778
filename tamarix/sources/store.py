"""Tables as versions of a manifest over Parquet files, with DDL, constraints and transactions.

A version lists each table's columns, keys and files and never changes. A commit adds the next
version by a rename that fails if another session was first; then, if the tables that it wrote
are unchanged, the commit is tried again on top, and else it fails (first committer wins).
UPDATE and DELETE rewrite only the files that hold rows in question. Files are reached through
Hadoop's file systems, so the root can be any path that Spark reads; the rename must be atomic
there. Statements are written in Postgres's way (tamarix.dialect) and parsed by Spark's own
parser, but for DDL, whose types it doesn't know.

A statement that fails leaves no trace, in a transaction or outside. Every row has a ctid, a
number that rises from insert to insert and stays with the row; a statement sees it only if it
names it. An index orders the files by its columns, so that Parquet's statistics prune them.
"""

from __future__ import annotations

import copy
import datetime
import json
import re
import threading
import time
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarix import dialect, errors
from tamarix.acl import RowAcl, refuse_foreign_relations
from tamarix.dialect import to_spark as bind
from tamarix.functions import vector
from tamarix.plans import changes
from tamarix.privileges import Privilege, allowed

_TYPES = {"varchar": "string", "text": "string", "string": "string", "char": "string", "jsonb": "string", "json": "string", "file": "string", "integer": "int", "int": "int", "int2": "smallint", "int4": "int", "int8": "bigint", "smallint": "smallint", "bigint": "bigint", "real": "float", "float": "float", "float4": "float", "float8": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "timestamp": "timestamp_ntz", "timestamptz": "timestamp_ntz", "date": "date", "bytea": "binary"}
SCHEMA, SYSTEM = "public", "information_schema"
CTID = "ctid"
_STRING_OR_DOT = re.compile(r"'(?:[^'\\]|\\.)*'|(?:\b\w+\.)?\b(public|information_schema)\.(?=[\w`])", re.I | re.S)


def _kind(statement: str) -> str:
    words = re.sub(r"^\s*(--[^\n]*\n\s*)*", "", statement).lower().split()
    if not words:
        raise errors.SyntaxError_("empty statement")
    first = words[0].rstrip(";")
    if first in ("create", "drop", "alter"):
        return f"{first} {'index' if 'index' in words[1:3] else words[1] if len(words) > 1 else ''}"
    if first == "with":
        top = [x.lower() for x in dialect.parse(statement).items if isinstance(x, str)]
        return next((w for w in top if w in ("select", "values", "insert", "update", "delete", "merge")), "with")
    return {"values": "select", "start": "begin"}.get(first, first)


def _pieces(body: str) -> list[str]:
    """The parts of a list at its commas outside parentheses."""
    out, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _column(text: str) -> tuple[dict, bool]:
    """(column, whether it is a key) of a definition such as `id VARCHAR(50) NOT NULL UNIQUE`."""
    m = re.fullmatch(r'[`"]?(\w+)[`"]?\s+(\w+(?:\s+precision)?)\s*(?:\((\d+)(?:\s*,\s*(\d+))?\))?(.*)', text, re.I | re.S)
    if not m:
        raise errors.SyntaxError_(f"not a column: {text}")
    name, kind, rest = m[1], m[2].lower().split()[0], m[5].lower()
    if kind == "vector":
        if not m[3] or int(m[3]) % 4:
            raise errors.SyntaxError_("the length of a vector must be a multiple of 4")
        spark_type = "array<float>"
    elif kind in ("decimal", "numeric"):
        spark_type = f"decimal({m[3] or 38},{m[4] or 0})"
    elif kind in _TYPES:
        spark_type = _TYPES[kind]
    else:
        raise errors.SyntaxError_(f"unknown type {kind}")
    if name.lower() == CTID:
        raise errors.SyntaxError_(f"{CTID} is a column of every table")
    primary = "primary key" in rest
    column = {"name": name, "type": spark_type, "sql_type": kind, "nullable": not (primary or "not null" in rest)}
    if m[3] and kind in ("varchar", "char", "vector"):
        column["length"] = int(m[3])
    return column, primary or "unique" in rest


class Store:
    """The versions under a root folder."""

    def __init__(self, spark: SparkSession, root: str, catalog: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        #: The name of the catalog in three-part names.
        self.catalog = (catalog or self.root.rsplit("/", 1)[-1]).lower()
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def latest(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n)), default=0)

    def version(self, number: int) -> dict:
        """The tables of a version; version 0 is empty."""
        if not number:
            return {}
        stream = self.fs.open(self._path(f"versions/{number:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add_version(self, number: int, tables: dict) -> bool:
        """Whether this call, and no other one, made the version."""
        scratch = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(scratch, False)
        stream.write(json.dumps(tables).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(scratch, self._path(f"versions/{number:020d}.json"), none)
        except Exception as error:
            self.fs.delete(scratch, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def write(self, df: DataFrame) -> list[str]:
        """The names of the files that now hold df."""
        folder = f"data/{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.root}/{folder}")
        except BaseException:
            self.fs.delete(self._path(folder), True)
            raise
        return [f"{folder}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]

    def remove(self, files) -> None:
        for f in files:
            self.fs.delete(self._path(f), False)

    def read(self, table: dict, files: list[str] | None = None, ctid: bool = False) -> DataFrame:
        """Rows of a table; columns younger than a file are null in it."""
        schema = T.StructType.fromDDL(", ".join([f"`{c['name']}` {c['type']}" for c in table["columns"]] + [f"{CTID} bigint"] * ctid))
        files = table["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in files))

    def session(self, privileges: int = Privilege.SUPER_USER, user: str | None = None, acl: RowAcl | None = None, cluster=None, version: int | None = None) -> Session:
        """A session; with acl, the user's rules hold for every statement; with version, it reads the tables as they were then and changes nothing."""
        return Session(self, privileges, user, acl, cluster, version)

    # Versions

    def checkpoint(self, label: str | None = None) -> str:
        """Name the latest version, by the time if no label is given. Files never change, so nothing is copied; vacuum() spares what has a name."""
        label = label or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S%f")
        if not re.fullmatch(r"[\w.-]+", label):
            raise errors.SyntaxError_(f"not a label: {label}")
        stream = self.fs.create(self._path(f"checkpoints/{label}"), False)
        stream.write(str(self.latest()).encode())
        stream.close()
        return label

    def checkpoints(self) -> dict[str, int]:
        """Versions by label, the oldest label first."""
        if not self.fs.exists(self._path("checkpoints")):
            return {}
        found = sorted(self.fs.listStatus(self._path("checkpoints")), key=lambda s: (s.getModificationTime(), s.getPath().getName()))
        out = {}
        for status in found:
            stream = self.fs.open(status.getPath())
            out[status.getPath().getName()] = int(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return out

    def restore(self, label: str | None = None) -> int:
        """Make the tables of a checkpoint, the newest if no label is given, the latest version."""
        known = self.checkpoints()
        if not known or (label is not None and label not in known):
            raise errors.UndefinedTable(f"no checkpoint {label or ''}")
        tables = self.version(known[label] if label else list(known.values())[-1])
        while not self.add_version(number := self.latest() + 1, tables):
            pass
        return number

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> int:
        """Delete data files that neither the last `keep` versions nor a checkpoint names and that are older than so many seconds, since younger ones may belong to open transactions. Returns how many."""
        latest = self.latest()
        wanted = {*range(max(1, latest - keep + 1), latest + 1), *self.checkpoints().values()} - {0}
        used = {f for v in wanted for t in self.version(v).values() for f in t["files"]}
        removed, limit = 0, (time.time() - older_than) * 1000
        if not self.fs.exists(self._path("data")):
            return 0
        for folder in self.fs.listStatus(self._path("data")):
            for status in self.fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{status.getPath().getName()}"
                if name.endswith(".parquet") and name not in used and status.getModificationTime() <= limit:
                    removed += bool(self.fs.delete(status.getPath(), False))
        for v in range(1, latest - keep + 1):
            if v not in wanted:
                self.fs.delete(self._path(f"versions/{v:020d}.json"), False)
        return removed


#: Advisory locks of this process: (root, number) -> (lock, the session that holds it).
_LOCKS: dict[tuple[str, int], threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


class Session:
    """Runs statements; outside a transaction each one commits by itself. Changes return a DataFrame with their count, or what RETURNING names."""

    def __init__(self, store: Store, privileges: int, user: str | None = None, acl: RowAcl | None = None, cluster=None, version: int | None = None):
        self.store, self.privileges, self.open = store, privileges, False
        self.user, self.acl, self.cluster, self.fixed = user, acl, cluster, version
        self.locks: dict[int, threading.Lock] = {}
        self.functions: dict[str, tuple] = {}
        self.procedures: dict[str, object] = {}
        #: Tables of this session alone, held by no version: DataFrames by name.
        self.memory: dict[str, DataFrame] = {}
        #: Tried in turn before the engine's own statements: f(session, statement) gives a DataFrame, or None to pass.
        self.handlers: list = [advisory_lock]
        self._pin()

    def _pin(self) -> None:
        self.base = self.store.latest() if self.fixed is None else self.fixed
        self.before = self.store.version(self.base)
        self.tables, self.touched, self.written = copy.deepcopy(self.before), set(), []

    def execute(self, statement: str, positional=(), named=None) -> DataFrame | None:
        statement = bind(statement, positional, named).strip().rstrip(";").strip()
        for handler in self.handlers:
            if (found := handler(self, statement)) is not None:
                return found
        kind = _kind(statement)
        if not allowed(self.privileges, kind):
            raise errors.PrivilegeError(f"no privilege for {kind}")
        if kind == "begin":
            if self.open:
                raise errors.TransactionStateError("a transaction is open")
            self._pin()
            self.open = True
            return None
        if kind in ("commit", "rollback"):
            if not self.open:
                raise errors.TransactionStateError(f"{kind} without a transaction")
            self.open = False
            if kind == "commit":
                self._commit()
            else:
                self.store.remove(self.written)
                self._pin()
            return None
        if kind == "set":
            return None  # accepted, without effect
        if not self.open:
            self._pin()
        run = {
            "create table": self._create, "create external": self._create_external, "drop table": self._drop, "alter table": self._alter, "create index": self._index, "drop index": self._drop_index, "create database": self._create_database,
            "select": self._select, "explain": self._select, "insert": self._insert, "update": self._update, "delete": self._delete, "execute": self._execute, "copy": self._copy,
        }.get(kind)
        if run is None:
            raise errors.SyntaxError_(f"unsupported statement: {kind}")
        if self.fixed is not None and kind not in ("select", "explain"):
            raise errors.TransactionStateError("a session of an earlier version only reads")
        tables = {n: {**t, "columns": [dict(c) for c in t["columns"]], "indexes": dict(t["indexes"])} for n, t in self.tables.items()}
        touched, written = set(self.touched), len(self.written)
        try:
            result = run(statement)
            if not self.open and self.touched:
                self._commit()
            return result
        except BaseException:
            self.store.remove(self.written[written:])
            self.tables, self.touched, self.written = tables, touched, self.written[:written]
            raise

    def _commit(self) -> None:
        if not self.touched:
            return
        ours, seen, touched, written = self.tables, self.before, self.touched, self.written
        while not self.store.add_version(self.base + 1, self.tables):
            self._pin()
            for name in touched:
                if self.before.get(name) != seen.get(name):
                    self.store.remove(written)
                    raise errors.SerializationFailure(f"{name} was changed by another transaction")
                self.tables.pop(name, None)
                if name in ours:
                    self.tables[name] = ours[name]
            self.touched = touched
        self._pin()

    # Functions and procedures

    def register(self, name: str, f, returns: str) -> None:
        """A scalar function (a Python function of rows, or a pandas UDF) under a name in this session's statements."""
        self.functions[name.lower()] = (f, returns)

    def register_table_function(self, name: str, handler) -> None:
        """A table function (a class made by pyspark's udtf) under a name in this session's statements."""
        self.functions[name.lower()] = (handler, None)

    def _execute(self, statement: str) -> DataFrame:
        """EXECUTE name(args): a procedure, a Python callable that gives a DataFrame or a value, or a registered function; the value's column is named data."""
        m = re.fullmatch(r"execute\s+(\w+)\s*\((.*)\)", statement, re.I | re.S)
        if not m:
            raise errors.SyntaxError_(statement)
        own = self._own_session()
        if (procedure := self.procedures.get(m[1].lower())) is None:
            if m[1].lower() not in self.functions:
                raise errors.UndefinedTable(f"no procedure {m[1]}")
            return own.sql(f"SELECT {m[1]}({m[2]}) AS data")
        args = list(own.sql(f"SELECT {m[2]}").first()) if m[2].strip() else []
        made = procedure(*args)
        return made if isinstance(made, DataFrame) else self.store.spark.createDataFrame([(made,)], ["data"])

    def _create_database(self, statement: str) -> None:
        m = re.fullmatch(r"create\s+database\s+(if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?", statement, re.I)
        if not m or self.cluster is None:
            raise errors.SyntaxError_(statement if not m else "no cluster to create a database in")
        self.cluster.create(m[2], exists_ok=bool(m[1]))

    # Lookups

    def _name(self, name: str) -> str:
        """The table's name in the default schema; other schemas and catalogs are an error."""
        *schema, table = [p.strip('`"').lower() for p in re.findall(r'`[^`]+`|"[^"]+"|[^.]+', name)]
        if schema and schema[-1] != SCHEMA or len(schema) > 2 or len(schema) == 2 and schema[0] != self.store.catalog:
            raise errors.UndefinedTable(name)
        return table

    def _table(self, name: str) -> tuple[str, dict]:
        name = self._name(name)
        if name not in self.tables:
            raise errors.UndefinedTable(name)
        return name, self.tables[name]

    def table(self, name: str) -> DataFrame:
        name, table = self._table(name)
        found = self._rows(table)
        return found if self.acl is None else self.acl.visible(self.user, name, found)

    def _rows(self, table: dict, files: list[str] | None = None, ctid: bool = False) -> DataFrame:
        if "external" in table:
            return self.store.spark.read.format(table["external"]["format"]).options(**table["external"]["options"]).schema(", ".join(f"`{c['name']}` {c['type']}" for c in table["columns"])).load(table["external"]["path"])
        return self.store.read(table, files, ctid)

    def _own_session(self) -> SparkSession:
        """A session without the caller's views, in which files cannot be named as tables."""
        own = self.store.spark.newSession()
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, (f, returns) in self.functions.items():
            if returns is None:
                own.udtf.register(name, f)
            elif hasattr(f, "evalType"):
                own.udf.register(name, f)
            else:
                own.udf.register(name, f, returns)
        return own

    def _views(self, statement: str) -> tuple[SparkSession, str]:
        """A session that holds the tables which the statement names, and the statement without schema names."""
        own = self._own_session()
        of_rows = self.store.jvm.org.apache.spark.sql.classic.Dataset.ofRows
        ctid = bool(re.search(rf"\b{CTID}\b", statement, re.I))

        def view(name: str, df: DataFrame) -> None:
            of_rows(own._jsparkSession, df._jdf.queryExecution().logical()).createOrReplaceTempView(name)

        for name, table in self.tables.items():
            if re.search(rf"\b{name}\b", statement, re.I):
                df = self._rows(table, ctid=ctid)
                if self.acl is None:
                    view(name, df)
                elif self.acl.has_access(self.user, name, "select"):
                    view(name, self.acl.visible(self.user, name, df))
        for name, df in self.memory.items():
            if re.search(rf"\b{name}\b", statement, re.I):
                view(name, df)
        if re.search(rf"\b{SYSTEM}\b", statement, re.I):
            if not self.privileges & Privilege.READ_SYSTEM_SCHEMA:
                raise errors.PrivilegeError(f"no privilege for {SYSTEM}")
            for name, df in self.information_schema().items():
                view(f"__{SYSTEM}_{name}", df)

        def plain(m: re.Match) -> str:
            if not m[1]:
                return m[0]
            catalog = m[0].split(".")[0].lower()
            if m[0].count(".") == 2 and catalog != self.store.catalog:
                raise errors.UndefinedTable(m[0])
            return f"__{SYSTEM}_" if m[1].lower() == SYSTEM else ""

        return own, _STRING_OR_DOT.sub(plain, statement)

    def information_schema(self) -> dict[str, DataFrame]:
        """The system tables, from the manifest."""
        catalog, spark = self.store.catalog, self.store.spark
        tables = [(catalog, SCHEMA, n, "EXTERNAL TABLE" if "external" in t else "BASE TABLE") for n, t in sorted(self.tables.items())]
        columns = [(catalog, SCHEMA, n, c["name"], i + 1, "YES" if c["nullable"] else "NO", c.get("sql_type", c["type"]), c.get("length")) for n, t in sorted(self.tables.items()) for i, c in enumerate(t["columns"])]
        keys = [(catalog, SCHEMA, n, name, c, i + 1, x["unique"]) for n, t in sorted(self.tables.items()) for name, x in sorted(t["indexes"].items()) for i, c in enumerate(x["columns"])]
        first = "table_catalog string, table_schema string, table_name string, "
        return {
            "schemata": spark.createDataFrame([(catalog, SCHEMA), (catalog, SYSTEM)], "catalog_name string, schema_name string"),
            "tables": spark.createDataFrame(tables, first + "table_type string"),
            "columns": spark.createDataFrame(columns, first + "column_name string, ordinal_position int, is_nullable string, data_type string, character_maximum_length int"),
            "statistics": spark.createDataFrame(keys, first + "index_name string, column_name string, seq_in_index int, is_unique boolean"),
        }

    def _select(self, statement: str) -> DataFrame:
        own, plain = self._views(statement)
        try:
            found = own.sql(plain)
        except ParseException as error:
            raise errors.SyntaxError_(str(error)) from error
        except AnalysisException as error:
            if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                raise errors.UndefinedTable(str(error)) from error
            if error.getCondition() == "UNRESOLVED_COLUMN.WITH_SUGGESTION":
                raise errors.UndefinedColumn(str(error)) from error
            raise
        refuse_foreign_relations(found, plain)
        return found

    def nearest(self, name: str, query, k: int, column: str | None = None, namespace=None) -> DataFrame:
        """The k rows whose vectors are nearest to the query, with a score (greater is nearer), by the metric of the table's hnsw index on the column, else by the inner product. With namespace, among the rows of that value of the index's namespace column. Ties by ctid."""
        name, table = self._table(name)
        index = next((x for x in table["indexes"].values() if "metric" in x["options"] and column in (None, x["columns"][0])), None)
        if index is None and column is None:
            raise errors.UndefinedColumn(f"{name} has no hnsw index")
        column, options = column or index["columns"][0], index["options"] if index else {}
        rows = self._rows(table, ctid=True)
        if self.acl is not None:
            rows = self.acl.visible(self.user, name, rows)
        if namespace is not None:
            if "namespace" not in options:
                raise errors.UndefinedColumn(f"the index of {name} has no namespace")
            rows = rows.where(F.col(options["namespace"]) == F.lit(namespace))
        a, b = F.col(column), vector.vector(query)
        score = {"dot": vector.dot, "l2": lambda x, y: -vector.l2_distance(x, y), "cos": vector.cosine_similarity}[options.get("metric", "dot").lower()](a, b)
        return vector.top_k(rows.where(a.isNotNull()), score, k, CTID).drop(CTID)

    # Definitions

    def _create(self, statement: str) -> None:
        made = re.fullmatch(r"create\s+table\s+(if\s+not\s+exists\s+)?([\w.\"`]+)\s+as\s+(.*)", statement, re.I | re.S)
        m = made or re.fullmatch(r"create\s+table\s+(if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*)\)", statement, re.I | re.S)
        if not m:
            raise errors.SyntaxError_(statement)
        name = self._name(m[2])
        if name in self.tables:
            if m[1]:
                return
            raise errors.DuplicateTable(name)
        table = {"columns": [], "indexes": {}, "files": [], "next": 1}
        if made:
            rows = self._select(m[3])
            table["columns"] = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": True} for f in rows.schema]
            self._add(name, table, rows, [])
            self.tables[name] = table
            return
        keys = []
        for piece in _pieces(m[3]):
            if key := re.fullmatch(r"(primary\s+key|unique)\s*\((.*)\)", piece, re.I | re.S):
                keys.append(([c.strip('`"') for c in _pieces(key[2])], key[1].lower().startswith("primary")))
                continue
            column, unique = _column(piece)
            if any(c["name"].lower() == column["name"].lower() for c in table["columns"]):
                raise errors.SyntaxError_(f"column {column['name']} exists")
            table["columns"].append(column)
            if unique:
                keys.append(([column["name"]], False))
        for columns, primary in keys:
            for c in table["columns"]:
                c["nullable"] = c["nullable"] and not (primary and c["name"] in columns)
            self._add_index(table, self._free(f"{name}_{'_'.join(columns)}_key"), columns, True)
        self.tables[name] = table
        self.touched.add(name)

    def _create_external(self, statement: str) -> None:
        """CREATE EXTERNAL TABLE t (columns) STORED AS format LOCATION 'path' [OPTIONS ('key' 'value', ...)]: rows are read where they lie and cannot be changed."""
        m = re.fullmatch(r"create\s+external\s+table\s+([\w.\"`]+)\s*(?:\((.*?)\))?\s*stored\s+as\s+(\w+)\s+location\s+('(?:[^'\\]|\\.)*')(?:\s+options\s*\((.*)\))?", statement, re.I | re.S)
        if not m or m[3].lower() not in FORMATS:
            raise errors.SyntaxError_(statement)
        name = self._name(m[1])
        if name in self.tables:
            raise errors.DuplicateTable(name)
        options = _options(m[5])
        path = dialect.unquoted(m[4])
        if m[2]:
            columns = [_column(piece)[0] for piece in _pieces(m[2])]
        else:
            found = self.store.spark.read.format(m[3].lower()).options(**options).load(path).schema
            columns = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": True} for f in found]
        self.tables[name] = {"columns": columns, "indexes": {}, "files": [], "external": {"format": m[3].lower(), "path": path, "options": options}}
        self.touched.add(name)

    def _copy(self, statement: str) -> DataFrame:
        """COPY t FROM 'path' and COPY t | (query) TO 'path', WITH (FORMAT csv | json | parquet | orc, other options of the format). Returns the count."""
        m = re.fullmatch(r"copy\s+(\(.*\)|[\w.\"`]+)\s+(from|to)\s+('(?:[^'\\]|\\.)*')(?:\s+with\s*\((.*)\))?", statement, re.I | re.S)
        if not m:
            raise errors.SyntaxError_(statement)
        options = {k.lower(): v for k, v in _options(m[4]).items()}
        kind, path = options.pop("format", "csv").lower(), dialect.unquoted(m[3])
        if kind not in FORMATS:
            raise errors.SyntaxError_(f"unknown format {kind}")
        if m[2].lower() == "to":
            rows = self._select(m[1][1:-1] if m[1][0] == "(" else f"SELECT * FROM {m[1]}")
            rows.write.format(kind).options(**options).save(path)
            return self._count(self.store.spark.read.format(kind).options(**options).schema(rows.schema).load(path).count())
        if not allowed(self.privileges, "insert"):
            raise errors.PrivilegeError("no privilege for insert")
        name, table = self._table(m[1])
        self._may_insert(name)
        schema = ", ".join(f"`{c['name']}` {c['type']}" for c in table["columns"])
        rows = self.store.spark.read.format(kind).options(**options).schema(schema).load(path)
        return self._count(self._add(name, table, rows, table["files"]))

    def _free(self, name: str) -> str:
        taken = {i for t in self.tables.values() for i in t["indexes"]}
        return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n not in taken)

    def _add_index(self, table: dict, name: str, columns: list[str], unique: bool, options: dict | None = None) -> None:
        known = {c["name"] for c in table["columns"]}
        if missing := [c for c in columns if c not in known]:
            raise errors.UndefinedColumn(missing[0])
        table["indexes"][name] = {"columns": columns, "unique": unique, "options": options or {}}

    def _drop(self, statement: str) -> None:
        m = re.fullmatch(r"drop\s+table\s+(if\s+exists\s+)?([\w.\"`]+)", statement, re.I)
        if not m:
            raise errors.SyntaxError_(statement)
        if m[1] and self._name(m[2]) not in self.tables:
            return
        name, _ = self._table(m[2])
        del self.tables[name]
        self.touched.add(name)

    def _alter(self, statement: str) -> None:
        m = re.fullmatch(r"alter\s+table\s+([\w.\"`]+)\s+(add\s+.*)", statement, re.I | re.S)
        if not m:
            raise errors.SyntaxError_("only ADD COLUMN is supported")
        name, table = self._table(m[1])
        for piece in _pieces(m[2]):
            column, unique = _column(re.sub(r"^add\s+(column\s+)?", "", piece, flags=re.I))
            if any(c["name"].lower() == column["name"].lower() for c in table["columns"]):
                raise errors.SyntaxError_(f"column {column['name']} exists")
            if not column["nullable"] and table["files"]:
                raise errors.NotNullViolation(column["name"])
            table["columns"].append(column)
            if unique:
                self._add_index(table, self._free(f"{name}_{column['name']}_key"), [column["name"]], True)
        self.touched.add(name)

    def _index(self, statement: str) -> None:
        m = re.fullmatch(r"create\s+(unique\s+)?index\s+(if\s+not\s+exists\s+)?(?:(\w+)\s+)?on\s+([\w.\"`]+)\s*(?:using\s+(\w+)\s*)?\(([^)]*)\)(?:\s*with\s*\((.*)\))?", statement, re.I | re.S)
        if not m or (m[5] or "hnsw").lower() != "hnsw":
            raise errors.SyntaxError_(statement)
        name, table = self._table(m[4])
        columns = [c.strip('`"') for c in _pieces(m[6])]
        index = m[3] or self._free(f"{name}_{'_'.join(columns)}_idx")
        if any(index in t["indexes"] for t in self.tables.values()):
            if m[2]:
                return
            raise errors.DuplicateTable(index)
        options = {k.strip().lower(): v.strip().strip("'") for k, v in (p.split("=", 1) for p in _pieces(m[7]))} if m[7] else {}
        if m[5] and (lacking := {"metric", "m", "ef_construction", "ef", "dim"} - set(options)):
            raise errors.SyntaxError_(f"missing options: {sorted(lacking)}")
        self._add_index(table, index, columns, bool(m[1]), options)
        if m[1]:
            self._check_unique(self.store.read(table), None, columns)
        if not m[5] and table["files"]:  # the rows that are there, in the index's order
            rows = self.store.read(table, ctid=True).repartitionByRange(*columns).sortWithinPartitions(*columns)
            table["files"] = self._written(rows)
        self.touched.add(name)

    def _written(self, rows: DataFrame) -> list[str]:
        """The files that now hold the rows; removed again if the statement or its transaction fails."""
        files = self.store.write(rows)
        self.written += files
        return files

    @staticmethod
    def _ordered(table: dict, rows: DataFrame) -> DataFrame:
        """The rows of each file in the order of the table's first index, which lets Parquet's statistics prune row groups."""
        index = next((x for x in table["indexes"].values() if "metric" not in x["options"]), None)
        return rows.sortWithinPartitions(*index["columns"]) if index else rows

    def _drop_index(self, statement: str) -> None:
        m = re.fullmatch(r"drop\s+index\s+(if\s+exists\s+)?([\w.\"`]+)", statement, re.I)
        index = self._name(m[2]) if m else ""
        for name, table in self.tables.items():
            if index in table["indexes"]:
                del table["indexes"][index]
                self.touched.add(name)
                return
        if not (m and m[1]):
            raise errors.UndefinedTable(index)

    # Changes

    def _may_insert(self, name: str) -> None:
        if self.acl is not None and not self.acl.has_access(self.user, name, "insert"):
            raise errors.PrivilegeError(f"{self.user} may not insert into {name}")

    def _within(self, name: str, condition: str, command: str) -> str:
        """The condition, narrowed to the rows that the user may change."""
        return condition if self.acl is None else f"({condition}) AND ({self.acl.text(self.user, name, command)})"

    def _check_unique(self, new: DataFrame, old: DataFrame | None, columns: list[str]) -> None:
        """Rows with a null in the key are exempt. Of the old rows only those between the least and the greatest new key are read."""
        keys = new.select(*columns).dropna(subset=columns)
        twice = keys.groupBy(*columns).count().where("count > 1").select(*columns)
        if old is not None:
            least, most = keys.agg(F.min(columns[0]), F.max(columns[0])).first()
            if least is not None:
                near = old.select(*columns).where(F.col(columns[0]).between(F.lit(least), F.lit(most)))
                twice = twice.unionByName(keys.join(near, columns, "left_semi"))
        if not twice.isEmpty():
            raise errors.UniqueViolation(f"({', '.join(columns)})")

    def _add(self, name: str, table: dict, rows: DataFrame, kept: list[str]) -> int:
        """Give the table the kept files and new ones with the rows, once these meet its constraints; how many rows were new.

        Rows without a ctid get the next ones: not without gaps, but rising from insert to insert."""
        if "external" in table:
            raise errors.SyntaxError_(f"{name} is an external table")
        if CTID not in rows.columns:
            rows = rows.withColumn(CTID, F.lit(table.get("next", 1)) + F.monotonically_increasing_id())
        files = self._written(self._ordered(table, rows))
        new, old = self.store.read(table, files, ctid=True), self.store.read(table, kept)
        strict = [c["name"] for c in table["columns"] if not c["nullable"]]
        bounded = {c["name"]: c["length"] for c in table["columns"] if "length" in c and c["type"] == "string"}
        sized = {c["name"]: c["length"] for c in table["columns"] if "length" in c and c["type"] != "string"}
        checks = [F.bool_or(F.col(c).isNull()).alias(f"null {c}") for c in strict]
        checks += [F.bool_or(F.char_length(F.col(c)) > n).alias(f"long {c}") for c, n in bounded.items()]
        checks += [F.bool_or(F.size(F.col(c)) != n).alias(f"size {c}") for c, n in sized.items()]
        checks += [F.bool_or(F.col(c["name"]).isNotNull() & F.try_parse_json(F.col(c["name"])).isNull()).alias(f"json {c['name']}") for c in table["columns"] if c.get("sql_type") in ("json", "jsonb", "file")]
        found = new.agg(F.count("*").alias("n"), F.max(CTID).alias("last"), *checks).first()
        for check in found.asDict():
            kind, _, column = check.partition(" ")
            if column and found[check]:
                raise {"null": errors.NotNullViolation, "long": errors.TooLong, "size": errors.TooLong, "json": errors.InvalidText}[kind](column)
        for index in table["indexes"].values():
            if index["unique"]:
                self._check_unique(new, old, index["columns"])
        table["next"] = max(table.get("next", 1), (found.last or 0) + 1)
        table["files"] = [*kept, *files]
        self.touched.add(name)
        return found.n

    def _count(self, n: int) -> DataFrame:
        return self.store.spark.createDataFrame([(n,)], "count long")

    def _parse(self, own: SparkSession, statement: str):
        try:
            return own._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        except Exception as error:
            raise errors.SyntaxError_(str(error)) from error

    @staticmethod
    def _tail(statement: str, *words: str) -> tuple[str, str | None]:
        """(the statement before a clause outside brackets, what follows its words)."""
        tree = dialect.parse(statement)
        at = dialect._find(tree.items, *words)
        if at < 0:
            return statement, None
        head, rest = dialect.Group(""), dialect.Group("")
        head.items, rest.items = tree.items[:at], tree.items[at:]
        return dialect.render(head), re.sub(r"\s+".join(words), "", dialect.render(rest), count=1, flags=re.I)

    def _cast(self, table: dict, rows: DataFrame, targets: list[str]) -> DataFrame:
        """The rows with all columns of the table, in its types; columns that are not targets are null."""
        columns = []
        for c in table["columns"]:
            column = F.col(c["name"]) if c["name"] in targets else F.lit(None)
            if c["name"] in targets and c["type"].startswith("array") and rows.schema[c["name"]].dataType == T.StringType():
                column = F.from_json(column, c["type"])
            columns.append(column.cast(c["type"]).alias(c["name"]))
        return rows.select(*columns)

    def _insert(self, statement: str) -> DataFrame:
        statement, returning = self._tail(statement, "returning")
        statement, conflict = self._tail(statement, "on", "conflict")
        own, plain = self._views(statement)
        plan = self._parse(own, plain)
        name, table = self._table(plan.table().multipartIdentifier().mkString("."))
        self._may_insert(name)
        listed = plan.userSpecifiedCols()
        targets = [listed.apply(i) for i in range(listed.size())] or [c["name"] for c in table["columns"]]
        rows = DataFrame(self.store.jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan.query()), own)
        refuse_foreign_relations(rows, plain)
        if len(rows.columns) != len(targets):
            raise errors.SyntaxError_(f"{len(targets)} columns, but {len(rows.columns)} values")
        if unknown := set(targets) - {c["name"] for c in table["columns"]}:
            raise errors.UndefinedColumn(sorted(unknown)[0])
        rows = self._cast(table, rows.toDF(*targets), targets)
        if conflict is not None:
            n, changed = self._upsert(name, table, rows, conflict)
        else:
            before = [] if plan.overwrite() else table["files"]
            n = self._add(name, table, rows, before)
            changed = self.store.read(table, [f for f in table["files"] if f not in set(before)], ctid=True)
        return self._count(n) if returning is None else changed.alias(name).selectExpr(*_pieces(returning))

    def _upsert(self, name: str, table: dict, rows: DataFrame, conflict: str) -> tuple[int, DataFrame]:
        """ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET column = expression, .... in which the new row is named excluded."""
        m = re.fullmatch(r"\s*\(([^)]*)\)\s*do\s+(nothing|update\s+set\s+(.*))", conflict, re.I | re.S)
        if not m:
            raise errors.SyntaxError_(f"ON CONFLICT{conflict}")
        keys = [k.strip('`"') for k in _pieces(m[1])]
        if not any(x["unique"] and sorted(x["columns"]) == sorted(keys) for x in table["indexes"].values()):
            raise errors.UndefinedColumn(f"no unique index on ({', '.join(keys)})")
        # Kept in files, so that rows that a table does not fix (random values, say) stay the same for what follows.
        rows = self.store.read(table, self._written(rows))
        old = self.store.read(table, ctid=True)
        if not m[3]:
            whole = rows.dropna(subset=keys).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
            fresh = whole.select(*rows.columns).unionByName(rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys)))
            before = table["files"]
            n = self._add(name, table, fresh, before)
            return n, self.store.read(table, [f for f in table["files"] if f not in set(before)], ctid=True)
        self._check_unique(rows, None, keys)
        hit = old.select(*keys, F.col("_metadata.file_path").alias("__file")).join(rows.select(*keys), keys, "left_semi").select("__file").distinct().collect() if table["files"] else []
        names = {"/".join(r["__file"].split("/")[-3:]) for r in hit}
        files, kept = [f for f in table["files"] if f in names], [f for f in table["files"] if f not in names]
        same = " AND ".join(f"`{name}`.`{k}` = excluded.`{k}`" for k in keys)
        values = {}
        for pair in _pieces(m[3]):
            column, _, value = pair.partition("=")
            values[self._name(column.strip())] = value.strip()
        if unknown := set(values) - {c["name"] for c in table["columns"]}:
            raise errors.UndefinedColumn(sorted(unknown)[0])
        found = f"excluded.`{keys[0]}` IS NOT NULL"
        if self.acl is not None:
            found = self._within(name, found, "update")
        both = self.store.read(table, files, ctid=True).alias(name).join(rows.alias("excluded"), F.expr(same), "left")
        marked = both.select(*(F.when(F.expr(found), F.expr(values[c["name"]]).cast(c["type"])).otherwise(F.col(f"{name}.{c['name']}")).alias(c["name"]) if c["name"] in values else F.col(f"{name}.{c['name']}") for c in table["columns"]), F.col(f"{name}.{CTID}"))
        changed = both.where(F.expr(found)).select(F.col(f"{name}.{CTID}").alias("__ctid"))
        start = table.get("next", 1)
        fresh = rows.join(old.select(*keys), keys, "left_anti").select(*rows.columns).withColumn(CTID, F.lit(start) + F.monotonically_increasing_id())
        touched = changed.count()
        before = set(kept)
        self._add(name, table, marked.unionByName(fresh), kept)
        now = self.store.read(table, [f for f in table["files"] if f not in before], ctid=True)
        done = now.where(F.col(CTID) >= start).unionByName(now.join(changed, F.col(CTID) == F.col("__ctid"), "left_semi"))
        return touched + now.where(F.col(CTID) >= start).count(), done

    def _hit(self, name: str, table: dict, condition: str) -> tuple[int, list[str], list[str]]:
        """(rows where the condition holds, files with such rows, other files)."""
        if "external" in table:
            raise errors.SyntaxError_(f"{name} is an external table")
        found = changes.affected(self.store.read(table, ctid=True).alias(name), condition).groupBy("_metadata.file_path").count().collect() if table["files"] else []
        names = {"/".join(r["file_path"].split("/")[-3:]) for r in found}
        return sum(r["count"] for r in found), [f for f in table["files"] if f in names], [f for f in table["files"] if f not in names]

    def _update(self, statement: str) -> DataFrame:
        statement, returning = self._tail(statement, "returning")
        own, plain = self._views(statement)
        plan = self._parse(own, plain)
        name, table = self._table(plan.table().multipartIdentifier().mkString("."))
        condition = self._within(name, plan.condition().get().sql() if plan.condition().isDefined() else "true", "update")
        pairs = [plan.assignments().apply(i) for i in range(plan.assignments().size())]
        values = {p.key().sql().replace("`", "").split(".")[-1]: p.value().sql() for p in pairs}
        if unknown := set(values) - {c["name"] for c in table["columns"]}:
            raise errors.UndefinedColumn(sorted(unknown)[0])
        n, files, kept = self._hit(name, table, condition)
        old = self.store.read(table, files, ctid=True).alias(name)
        if n:
            self._add(name, table, changes.updated(old, condition, values), kept)
        if returning is None:
            return self._count(n)
        return changes.updated(changes.affected(old, condition), "true", values).alias(name).selectExpr(*_pieces(returning))

    def _delete(self, statement: str) -> DataFrame:
        statement, returning = self._tail(statement, "returning")
        own, plain = self._views(statement)
        plan = self._parse(own, plain)
        name, table = self._table(plan.table().multipartIdentifier().mkString("."))
        condition = self._within(name, plan.condition().sql(), "delete")
        n, files, kept = self._hit(name, table, condition)
        old = self.store.read(table, files, ctid=True).alias(name)
        if n:
            table["files"] = [*kept, *self._written(self._ordered(table, changes.remaining(old, condition)))]
            self.touched.add(name)
        return self._count(n) if returning is None else changes.affected(old, condition).selectExpr(*_pieces(returning))


FORMATS = ("csv", "json", "parquet", "orc", "text")


def _options(text: str | None) -> dict[str, str]:
    """Options written key value, 'key' 'value' or key = value, at commas."""
    out = {}
    for piece in _pieces(text) if text and text.strip() else []:
        m = re.fullmatch(r"('(?:[^'\\]|\\.)*'|\w+)\s*=?\s*('(?:[^'\\]|\\.)*'|\S+)", piece, re.S)
        if not m:
            raise errors.SyntaxError_(f"not an option: {piece}")
        key, value = (dialect.unquoted(x) if x[0] == "'" else x for x in m.groups())
        out[key] = value
    return out


def advisory_lock(session: Session, statement: str) -> DataFrame | None:
    """SELECT pg_advisory_lock(n) waits for the lock n of this process, SELECT pg_advisory_unlock(n) gives it back; both give no rows. A session holds one lock at a time."""
    m = re.fullmatch(r"select\s+pg_advisory_(un)?lock\s*\(\s*(-?\d+)L?\s*\)(?:\s+as\s+\w+)?", statement, re.I)
    if not m:
        return None
    number = int(m[2])
    if m[1]:
        if number not in session.locks:
            raise errors.TransactionStateError(f"lock {number} is not held")
        session.locks.pop(number).release()
    else:
        if session.locks:
            raise errors.TransactionStateError("a lock is held")
        with _LOCKS_GUARD:
            lock = _LOCKS.setdefault((session.store.root, number), threading.Lock())
        lock.acquire()
        session.locks[number] = lock
    return session.store.spark.createDataFrame([], "data string")
