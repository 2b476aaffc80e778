"""Collections of documents with vectors of their parts: search with a least score, contexts, and upkeep.

documents: collection, doc_id, content. parts: collection, doc_id, start, end (offsets of bytes in the
content, as UTF-8), embedding. Both are plain DataFrames; what changes them returns new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarix.functions import vector

METRICS = {"dot": vector.dot, "cos": vector.cosine_similarity, "l2": lambda a, b: -vector.l2_distance(a, b)}


def collections(documents: DataFrame) -> DataFrame:
    return documents.groupBy("collection").agg(F.count("*").alias("documents"))


def add_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents with new ones; those of the same collection and id are replaced."""
    return documents.join(new.select("collection", "doc_id"), ["collection", "doc_id"], "left_anti").unionByName(new)


def delete_documents(documents: DataFrame, parts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents (collection, doc_id) of gone."""
    keys = ["collection", "doc_id"]
    return documents.join(gone.select(*keys), keys, "left_anti"), parts.join(gone.select(*keys), keys, "left_anti")


def set_embeddings(parts: DataFrame, new: DataFrame) -> DataFrame:
    """parts with the parts of new in place of all parts of the same documents."""
    keys = ["collection", "doc_id"]
    return parts.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def bytes_between(content: Column, start: Column, end: Column) -> Column:
    """The text of the bytes from start to end, within the content's bounds; bytes of a character that is cut through are replaced."""
    raw = content.cast("binary")
    begin, stop = F.greatest(start, F.lit(0)), F.least(end, F.octet_length(content))
    return F.make_valid_utf8(F.substring(raw, begin + 1, F.greatest(stop - begin, F.lit(0))).cast("string"))


def top_k(documents: DataFrame, parts: DataFrame, collection: str, query, k: int, min_score: float | None = None, metric: str = "dot", with_content: bool = True, before: int = 0, after: int = 0) -> DataFrame:
    """The k best parts of a collection: doc_id, start, end, score, and their content with so many bytes of context before and after. Ties by doc_id and start. The k parts are chosen before any document is read."""
    score = METRICS[metric](F.col("embedding"), vector.vector(query))
    best = vector.top_k(parts.where(F.col("collection") == collection), score, k, "doc_id", "start")
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    best = best.select("doc_id", "start", "end", "score")
    if not with_content:
        return best
    found = best.join(documents.where(F.col("collection") == collection).select("doc_id", "content"), "doc_id")
    inside = bytes_between(F.col("content"), F.col("start"), F.col("end"))
    around = [bytes_between(F.col("content"), F.col("start") - before, F.col("start")).alias("before_context"), bytes_between(F.col("content"), F.col("end"), F.col("end") + after).alias("after_context")]
    return found.select("doc_id", "start", "end", "score", inside.alias("content"), *around)
