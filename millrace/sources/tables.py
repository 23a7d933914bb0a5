"""Parquet tables as named relations of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def model_session(spark: SparkSession) -> SparkSession:
    """A session of its own for model SQL: double quotes name columns, temp views are private."""
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def bind_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = DRIVER_TABLES) -> None:
    """Registers the named tables as temporary views."""
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)
