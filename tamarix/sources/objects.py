"""Objects of a store that Hadoop's file systems reach: listing, reading, writing.

Listings and heads come from the store's metadata alone, so no content is read and empty objects are
there too. Many objects' contents are read by Spark's tasks (contents()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarix import errors

_SHAPE = "key string, size long, modified timestamp, is_prefix boolean"


class Bucket:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self) -> None:
        self.fs.mkdirs(self.path(self.root))

    def _key(self, status) -> str:
        base = self.fs.makeQualified(self.path(self.root)).toUri().getPath()
        return status.getPath().toUri().getPath()[len(base) :].lstrip("/")

    def _row(self, status, folder: bool = False):
        import datetime

        when = datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.UTC)
        return (self._key(status) + ("/" if folder else ""), status.getLen(), when, folder)

    def list(self, prefix: str = "", delimiter: str | None = None) -> DataFrame:
        """(key, size, modified, is_prefix) of the objects whose keys begin with the prefix. With the delimiter "/", keys that go on
        beyond the next one are shown once, as prefixes. The folders that cannot hold such keys are not entered."""
        if delimiter not in (None, "/"):
            raise errors.SyntaxError_("the delimiter is / or none")
        folder, _, _ = prefix.rpartition("/")
        top = self.path(f"{self.root}/{folder}" if folder else self.root)
        rows = []
        if self.fs.exists(top):
            if delimiter:
                rows = [self._row(s, s.isDirectory()) for s in self.fs.listStatus(top)]
            else:
                found = self.fs.listFiles(top, True)
                while found.hasNext():
                    rows.append(self._row(found.next()))
        rows = [r for r in rows if r[0].startswith(prefix) and not r[0].rsplit("/", 1)[-1].startswith(".")]
        return self.spark.createDataFrame(sorted(rows), _SHAPE)

    def head(self, key: str) -> dict:
        """size and modified of an object."""
        at = self.path(f"{self.root}/{key}")
        if not self.fs.exists(at) or self.fs.getFileStatus(at).isDirectory():
            raise errors.UndefinedTable(key)
        _, size, modified, _ = self._row(self.fs.getFileStatus(at))
        return {"size": size, "modified": modified}

    def get(self, key: str) -> bytes:
        self.head(key)
        stream = self.fs.open(self.path(f"{self.root}/{key}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, key: str, content: bytes) -> None:
        """Write an object; one that is there is replaced."""
        stream = self.fs.create(self.path(f"{self.root}/{key}"), True)
        stream.write(content)
        stream.close()

    def contents(self, prefix: str = "") -> DataFrame:
        """(key, content) of the objects under a folder or glob, read by tasks; empty objects have no row, as Spark's scan passes over them."""
        base = self.fs.makeQualified(self.path(self.root)).toUri().getPath()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}")
        key = F.ltrim(F.element_at(F.split(F.col("path"), rf"\Q{base}\E", 2), 2), F.lit("/"))
        return files.select(key.alias("key"), "content")
