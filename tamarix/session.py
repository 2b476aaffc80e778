"""Session set-up and durable lineage cuts shared by every part of the engine."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the engine assumes: UTC, AQE and Arrow."""
    builder = SparkSession.builder.master(master).appName("tamarix")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder, and cut its lineage there.

    The folder is spark.checkpoint.dir of the session. Only on one machine, as in tests, may that
    be unset: then a temporary folder is used.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        context.setCheckpointDir(local_folder(df.sparkSession))
    return df.checkpoint()


def local_folder(spark: SparkSession) -> str:
    """A temporary folder, which only a session on one machine may use; an error on a cluster, where executors could not see it."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tamarix-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine where that is unset, a temporary one."""
    return (spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)).rstrip("/")


#: Whether Spark removes the shuffle files of a statement when it ends, not when the driver's garbage happens to be collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables held as Parquet in the shared folder until they are dropped, or at the latest until the block ends.

    Within the block the shuffle files of a statement go when it ends. Tables that are read after
    the block must not depend on held ones.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __enter__(self) -> Scratch:
        self.folder, self.before = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}", self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        return self

    def __exit__(self, *_) -> None:
        with contextlib.suppress(Exception):
            self.spark.conf.set(CLEAN_UP, self.before)
        self._delete(self.folder)

    def hold(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.held)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(next(path for held, path in self.held if held is df))

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)
