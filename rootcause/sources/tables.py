"""Telemetry table storage (ops A3, A4, A5).

Tables are parquet folders. Loading applies the fixed schema (``df.to``) and
registers a temp view per table so SQL can name them. Saving refuses to
overwrite: a second bulk load of the same table fails, as re-inserting
explicit primary keys would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rootcause.schemas import TABLE_SCHEMAS, conform


def save_table(df: DataFrame, path: str, name: str | None = None,
               partition_by: list[str] | None = None) -> None:
    """Bulk-load a table into a new parquet folder (op A4)."""
    if name:
        df = conform(df, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one stored table with its fixed schema (ops A3, A5)."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path).to(TABLE_SCHEMAS[name])


def load_table_dir(spark: SparkSession, root: str, register: bool = True) -> dict[str, DataFrame]:
    """Read all five tables from ``root/<name>`` and expose them to SQL (op A3)."""
    tables = {n: read_table(spark, f"{root.rstrip('/')}/{n}", n) for n in TABLE_SCHEMAS}
    if register:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
    return tables
