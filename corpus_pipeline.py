"""A training-data pipeline over documents: toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between
stages the documents are written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarix.llm import jaccard, packing, pii, toxicity
from tamarix.session import shared_folder

REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts stay. The grammar learns from the labels of this stage's documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < REJECT).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies: runs of 5 words, a similarity of 0.8 or more, found by SimHash and completed by an exact join. Rows without an id stay. Of a group's rows with its least id, the one whose text has the least hash stays, once."""
    found = jaccard.near_copies(docs.where("doc_id is not null"))
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("k")).select("k.*")
    kept = found.join(kept, ["doc_id", "h"]).groupBy("doc_id", F.col("h").alias("__h")).agg(F.count("*").alias("__rows"))
    named = docs.withColumn("__h", jaccard.text_hash())
    rows = named.join(kept.where("__rows = 1"), ["doc_id", "__h"], "left_semi")
    repeated = named.join(kept.where("__rows > 1"), ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    columns = [f"`{c}`" for c in docs.columns]
    return rows.select(*columns).unionByName(repeated.select(*columns)).unionByName(docs.where("doc_id is null").select(*columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds, and n_chars counted anew."""
    redacted = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("personal_data", redact_personal_data), ("best_fit_packing", pack_sequences)]

#: No stage but the last could be said in SQL without repeating a learned model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the stage has read is not needed any more
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
