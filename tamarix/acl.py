"""Row-level access: every base table that a statement can name is a filtered view of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarix.errors import PrivilegeError

COMMANDS = ("select", "insert", "update", "delete")


class RowAcl:
    """Rules (user, table, command, filter). '*' as the table means all, as the filter no restriction; as the command all four. A user named public stands for everyone."""

    def __init__(self, rules=()):
        self.rules: dict[tuple[str, str, str], list[str]] = {}
        for user, table, command, condition in rules:
            for c in COMMANDS if command == "*" else (command.lower(),):
                self.rules.setdefault((user, table, c), []).append(condition)

    def filters(self, user: str, table: str, command: str) -> list[str]:
        return [f for u in {user, "public"} for t in {table, "*"} for f in self.rules.get((u, t, command.lower()), [])]

    def has_access(self, user: str, table: str, command: str) -> bool:
        return bool(self.filters(user, table, command))

    def text(self, user: str, table: str, command: str) -> str:
        """The rules of a table joined by OR, as SQL; an error without any."""
        filters = self.filters(user, table, command)
        if not filters:
            raise PrivilegeError(f"{user} may not {command} on {table}")
        return "true" if "*" in filters else " OR ".join(f"({f})" for f in sorted(set(filters)))

    def condition(self, user: str, table: str, command: str):
        """The rules of a table joined by OR, as one Column; an error without any."""
        return F.expr(self.text(user, table, command))

    def has_any_access(self, user: str, command: str) -> bool:
        """Whether there is a table that the user may use so."""
        return any(u in (user, "public") and c == command.lower() for u, _, c in self.rules)

    def visible(self, user: str, name: str, df: DataFrame, command: str = "select") -> DataFrame:
        return df.where(self.condition(user, name, command))

    def query(self, spark: SparkSession, user: str, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
        """Run a SELECT in a session of its own that holds nothing but the user's views, so that joins, subqueries and CTEs see only those. A table without a rule is not there, and neither are files, global views and the catalog's tables."""
        own = spark.newSession()
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
        for name, df in tables.items():
            if self.has_access(user, name, "select"):
                seen = self.visible(user, name, df)
                of_rows(own._jsparkSession, seen._jdf.queryExecution().logical()).createOrReplaceTempView(name)
        refuse_commands(own, statement)
        found = own.sql(statement)
        refuse_foreign_relations(found, statement)
        return found

    def bound(self, spark: SparkSession, user: str, tables: dict[str, DataFrame]):
        """A function from a SELECT to its result as this user sees it: the only way in for code that is handed the function."""
        return lambda statement: self.query(spark, user, statement, tables)

    @classmethod
    def load(cls, rows: DataFrame) -> RowAcl:
        """The rules of a table (user_id, metadata): metadata is JSON {"filters": [{"command", "table", "condition"}, ...]}, condition * or absent for no restriction. A few rows a user."""
        shape = "struct<filters:array<struct<command:string,table:string,condition:string>>>"
        each = rows.select("user_id", F.explode(F.from_json("metadata", shape)["filters"]).alias("f")).select("user_id", "f.*")
        return cls((r.user_id, r.table, r.command or "*", r.condition or "*") for r in each.where("table IS NOT NULL").toLocalIterator())


def refuse_commands(own: SparkSession, statement: str) -> None:
    """An error for statements that do more than read."""
    plan = own._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    kinds = plan.getClass().getName().rsplit(".", 1)[-1]
    if re.search(r"Command|Statement|InsertInto|CreateTable|CreateView|Drop|Merge|Update|Delete|Replace|Set|Describe|Show", kinds) and kinds not in ("UnresolvedSubqueryColumnAliases",):
        raise PrivilegeError(f"not a query: {kinds}")


def refuse_foreign_relations(found: DataFrame, statement: str) -> None:
    """An error where a query reads what is no view of its session: tables of a catalog and global views."""
    if re.search(r"(?i)\bglobal_temp\b", re.sub(r"'(?:[^'\\]|\\.)*'", "", statement)):
        raise PrivilegeError("global views cannot be read")
    plan = found._jdf.queryExecution().analyzed()
    plans = [plan]
    inner = plan.subqueriesAll()
    plans += [inner.apply(i) for i in range(inner.size())]
    for p in plans:
        leaves = p.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.getClass().getSimpleName()
            if kind == "HiveTableRelation" or (kind == "LogicalRelation" and leaf.catalogTable().isDefined()) or (kind == "DataSourceV2Relation" and leaf.identifier().isDefined()):
                raise PrivilegeError("tables of the catalog cannot be read")
