"""Small files on any file system that Spark reaches: everything goes through the Hadoop client of the driver's JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """Makes the file with all of its content at once; raises if there is one of this name."""
        folder, _, last = name.rpartition("/")
        temp = self.path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        stream = self.fs.create(temp, False)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()
        none = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(temp, self.path(name), none)
        except Exception:
            self.fs.delete(temp, False)
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self.path(name)).getLength())
