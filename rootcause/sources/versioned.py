"""Tables that are replaced as a whole without a moment in which they are missing.

A version is written into a hidden folder and appears by one rename, as
``version=<n>``; readers take the greatest version there is. A reader that
holds an older one keeps reading it: the last ``keep`` versions stay. A writer
that dies leaves a hidden folder behind and the table as it was.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"version=(\d+)$")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of any path that Spark can write to."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    fs, folder = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(m.group(1)) for m in map(_VERSION.match, names) if m)


def publish(df: DataFrame, path: str, version: int | None = None, keep: int = 2) -> int:
    """Write ``df`` as the next version (or the given one) of the table at ``path``.

    A version that is already there is left as it is, so that a replayed
    streaming batch publishes nothing twice. One writer at a time.
    """
    spark = df.sparkSession
    there = versions(spark, path)
    version = (there[-1] + 1 if there else 0) if version is None else version
    if version not in there:
        fs, folder = file_system(spark, path)
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        hidden = path_of(folder, f"_writing-{uuid.uuid4().hex}")
        df.write.parquet(hidden.toString())
        if not fs.rename(hidden, path_of(folder, f"version={version}")):
            raise OSError(f"version {version} of {path} could not be published")
        for old in versions(spark, path)[:-max(1, keep)]:
            fs.delete(path_of(folder, f"version={old}"), True)
    return version


def read_current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The newest version; without any, an empty table of ``schema``."""
    there = versions(spark, path)
    if not there:
        if schema is None:
            raise FileNotFoundError(f"no version of {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path.rstrip('/')}/version={there[-1]}")
