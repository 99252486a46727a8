"""Probes of the key filters in Parquet footers, with the Parquet reader of the driver's JVM; no data pages are read."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stratalog.sources.files import Files


def might_hold(spark: SparkSession, files: Files, folder: str, key: bytes, column: str = "key") -> bool:
    """False only if no file of the folder holds the key; True where a file has no filter."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    binary = jvm.org.apache.parquet.io.api.Binary.fromConstantByteArray(key)
    for name in files.names(folder):
        if not name.endswith(".parquet"):
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(files.path(f"{folder}/{name}"), conf))
        try:
            for block in reader.getRowGroups():
                for chunk in block.getColumns():
                    if chunk.getPath().toDotString() == column:
                        bloom = reader.getBloomFilterDataReader(block).readBloomFilter(chunk)
                        if bloom is None or bloom.findHash(bloom.hash(binary)):
                            return True
        finally:
            reader.close()
    return False
