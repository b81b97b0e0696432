"""Review files: CSV with a header, as landed by the acquisition step (ops A1, A2).

Review text holds newlines, quotes and backslashes, so CSV needs both
``multiLine`` and ``escape='"'`` (RFC 4180 doubling) to read back exactly.
An empty text is written as ``""`` and a missing one as nothing, and both read
back as they were. A header that does not name the schema's columns in order, or
a row that does not parse, is an error rather than a silent null. A multi-line
CSV file is read by one task, since a line break may be inside a text, so a file
larger than ``MAX_CSV_BYTES`` is refused: at scale the feed lands as many files,
or as parquet (``fmt='parquet'``), which splits freely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rootcause.schemas import CATEGORISED_REVIEW_SCHEMA, REVIEW_SCHEMA
from rootcause.sources.versioned import file_system

# nullValue is a text that no review holds: with the default, an empty text
# would be null.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "enforceSchema": "false",
               "mode": "FAILFAST", "nullValue": "\\N"}
#: Bytes of one CSV file, which one task reads (a minute or so).
MAX_CSV_BYTES = 4 << 30


def largest_file(spark: SparkSession, path: str) -> tuple[int, str]:
    """(bytes, name) of the largest file below a path or matching a glob."""
    fs, pattern = file_system(spark, path)
    largest = (0, "")
    for found in fs.globStatus(pattern) or ():
        files = fs.listFiles(found.getPath(), True)
        while files.hasNext():
            f = files.next()
            largest = max(largest, (f.getLen(), f.getPath().toString()))
    return largest


def read_reviews(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str = "csv", max_file_bytes: int = MAX_CSV_BYTES) -> DataFrame:
    """Read a review file or folder with a fixed schema, never inferred (op A1).

    A CSV file of more than ``max_file_bytes`` is an error (see above).
    """
    schema = schema or REVIEW_SCHEMA
    reader = spark.read.schema(schema)
    if fmt == "csv":
        size, name = largest_file(spark, path)
        if size > max_file_bytes:
            raise ValueError(f"{name} has {size} bytes and one task would read it: split it or land it as parquet")
        return reader.options(**CSV_OPTIONS).csv(path)
    return reader.format(fmt).load(path)


def read_categorised(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_reviews(spark, path, CATEGORISED_REVIEW_SCHEMA, fmt)


def write_reviews(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    """Write reviews with a header and no index column (op A2)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header="true", quote='"', escape='"').csv(path)
    else:
        w.format(fmt).save(path)
