"""A tree of files in a table (id, name, parent_id, is_directory, file, archived_at, ...): a node, its children, contents, removal of subtrees.

file is JSON, {"content": base64 text, ...} for contents held in the table. Archived nodes (archived_at set) are not there for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable


def present(files: DataFrame) -> DataFrame:
    return files.where(F.col("archived_at").isNull())


def node(files: DataFrame, node_id) -> DataFrame:
    return present(files).where(F.col("id") == F.lit(node_id))


def children(files: DataFrame, parent_id) -> DataFrame:
    """The nodes right below a directory; below None, those at the top."""
    parent = F.col("parent_id")
    return present(files).where(parent.isNull() if parent_id is None else parent == F.lit(parent_id))


def content(file: Column) -> Column:
    """The bytes that the JSON of a file holds; null where they lie elsewhere."""
    return F.unbase64(F.get_json_object(file, "$.content"))


def read_file(files: DataFrame, node_id) -> DataFrame:
    """(id, content) of a file; no row for a directory."""
    return node(files, node_id).where(~F.coalesce(F.col("is_directory"), F.lit(False))).select("id", content(F.col("file")).alias("content"))


def written(files: DataFrame, new: DataFrame) -> DataFrame:
    """files with new ones (id, name, parent_id, content as bytes); a file of the same id is replaced."""
    made = new.select("id", "name", "parent_id", F.lit(False).alias("is_directory"), F.to_json(F.struct(F.base64("content").alias("content"))).alias("file"))
    return files.join(new.select("id"), "id", "left_anti").unionByName(made, allowMissingColumns=True)


def below(prefix: str) -> Column:
    """Whether an id is a node or lies below it: ids of children begin with their parent's and a dash."""
    return (F.col("id") == F.lit(prefix)) | F.lower("id").startswith(F.lower(F.lit(prefix + "-")))


def soft_deleted(files: DataFrame, embeddings: DataFrame, prefix: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(files with the subtree archived, embeddings without those of its files)."""
    hit = below(prefix) & F.col("archived_at").isNull()
    kept = embeddings.join(files.where(below(prefix)).select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return files.withColumn("archived_at", F.when(hit, now).otherwise(F.col("archived_at"))), kept


def tree(nodes: DataFrame, start, up: bool) -> DataFrame:
    """(id, depth) of the ancestors (up) or descendants of a node (id, parent_id), itself at depth 0.

    One join a level of the frontier with all nodes, each level made durable; it ends where a level is empty, so missing
    parents end a line, and nodes met before are not entered again, so circles end too. Neither the depth nor the number
    of nodes is bounded. Nothing for an unknown start."""
    nodes = nodes.select("id", "parent_id")
    seen = level = durable(nodes.where(F.col("id") == F.lit(start)).select("id", "parent_id", F.lit(0).alias("depth")))
    depth = 0
    while not level.isEmpty():
        depth += 1
        step = nodes.join(level.select(F.col("parent_id" if up else "id").alias("__key")).distinct(), F.col("id" if up else "parent_id") == F.col("__key"), "left_semi")
        level = durable(step.join(seen.select("id"), "id", "left_anti").select("id", "parent_id", F.lit(depth).alias("depth")).distinct())
        seen = seen.unionByName(level)
    return seen.select("id", "depth")


def breadcrumb(files: DataFrame, node_id) -> DataFrame:
    """(id, name, depth) of a node and its ancestors, the topmost first; an archived ancestor ends the line."""
    found = present(files)
    return tree(found, node_id, True).join(found.select("id", "name"), "id").orderBy(F.desc("depth"))


def sub_directories(files: DataFrame, node_id) -> DataFrame:
    """(id, depth) of all directories below a node, and itself if it is one; archived ones and what lies below them are passed over."""
    return tree(present(files).where("is_directory"), node_id, False)
