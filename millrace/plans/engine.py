"""Runs model SQL over bound tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import DRIVER_TABLES, model_session, read_table

from .antijoin import to_anti_joins
from .dialect import to_spark
from .sqltext import solid, tokenize


def mentioned(sql: str, names: tuple[str, ...] = DRIVER_TABLES) -> list[str]:
    """The known tables whose names occur in a statement."""
    words = {t.name().lower() for t in solid(tokenize(sql)) if t.kind in ("word", "quoted")}
    return [n for n in names if n in words]


def query(session: SparkSession, sql: str) -> DataFrame:
    """The result of model SQL whose tables are bound in the session."""
    plain = to_spark(sql)
    joined = to_anti_joins(plain)
    if joined != plain:
        try:
            return session.sql(joined)
        except AnalysisException:  # a subquery that refers to the outer query: Spark joins it on what it refers to
            pass
    return session.sql(plain)


def run_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The result of one statement of model SQL over the parquet tables of a folder."""
    own = model_session(spark)
    for name in mentioned(sql):
        read_table(own, folder, name).createOrReplaceTempView(name)
    return query(own, sql)
