"""Semantic search over chunks of files, as one declarative pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarix.functions import vector
from tamarix.functions.text import with_context

from .relational import keep_first


def in_scope(directories: list | None, files: list | None):
    """(directory in scope, or any if none named) or (file in scope, with a directory)."""
    by_directory = F.col("directory_id").isin(directories) if directories else F.col("directory_id").isNotNull()
    by_file = (F.col("file_id").isin(files) & F.col("directory_id").isNotNull()) if files else F.lit(False)
    return by_directory | by_file


def search(chunks: DataFrame, files: DataFrame, query, limit: int = 20, least: float = 0.1, around: int = 300, scope=None) -> DataFrame:
    """The best chunks of distinct contents with their context, the best first.

    chunks: file_id, directory_id, chunk_start, chunk_end, embedding; files: file_id, content and, if there are such,
    parent_id and is_directory. A file below another file (not a directory) was made from that one, its original;
    original_id is the file itself elsewhere. The limit comes before the threshold and before copies of a content are
    dropped, and only the chunks within it are joined."""
    found = chunks if scope is None else chunks.where(scope)
    best = vector.top_k(found, vector.dot(F.col("embedding"), vector.vector(query)), limit, "file_id", "chunk_start").where(F.col("score") > least)
    joined = best.join(files, "file_id").withColumn("content_hash", F.sha2("content", 256))
    first = keep_first(joined, ["content_hash", "chunk_start"], F.col("file_id"))
    original = []
    if "parent_id" in files.columns:
        parents = files.where(~F.coalesce(F.col("is_directory"), F.lit(False))).select(F.col("file_id").alias("__original"))
        first = first.join(parents, F.col("parent_id") == F.col("__original"), "left")
        original = [F.coalesce("__original", "file_id").alias("original_id")]
    shown = first.select("file_id", "chunk_start", "score", F.substring("content", F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start")).alias("chunk"), with_context(F.col("content"), F.col("chunk_start"), F.col("chunk_end"), around).alias("context"), *original)
    return shown.orderBy(F.desc("score"), "file_id", "chunk_start")


def federated(results: dict[str, DataFrame]) -> DataFrame:
    """The results of several apps as one, each row with its app; columns that one of them lacks are null."""
    out = None
    for app, df in results.items():
        named = df.withColumn("app", F.lit(app))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def grouped(found: DataFrame) -> DataFrame:
    """Search results by file: file_id, score of the best chunk, and the chunks in their order in the file."""
    part = F.struct("chunk_start", "score", "chunk")
    return found.groupBy("file_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(part)).alias("chunks"))


def prompt(found: DataFrame) -> DataFrame:
    """(file_id, prompt): each file's chunks as a text of nested sections, for a language model."""
    section = F.transform("chunks", lambda c: F.concat(F.lit("<section>"), c["chunk"], F.lit("</section>")))
    text = F.concat(F.lit('<file id="'), F.col("file_id").cast("string"), F.lit('"><sections>'), F.array_join(section, ""), F.lit("</sections></file>"))
    return grouped(found).select("file_id", text.alias("prompt"))


def embedded(df: DataFrame, column: str = "text", size: int = 64, out: str = "embedding") -> DataFrame:
    """df with a stand-in for a model's vectors: each word adds 1 to the dimension that its hash names and the sum is put at unit length. It knows no meaning; null texts get null."""
    words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.transform(vector.normalize(counts), lambda x: x.cast("float"))))
