"""How new rows change a table: append, merge by key, replace partitions, time windows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

_UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400}


class DuplicateKeys(ValueError):
    """The rows to merge hold a key more than once."""


def overlap_seconds(text: str | None) -> int | None:
    """``15m``, ``2 hours`` and the like as seconds; None if it isn't one."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", text or "")
    return int(m[1]) * _UNITS[m[2].lower()] if m and m[2].lower() in _UNITS else None


def appended(target: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of both; columns count by position."""
    return target.union(rows.toDF(*target.columns))


def duplicate_keys(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys without nulls that occur more than once, with their count."""
    keys = list(keys)
    some = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def check_keys(rows: DataFrame, keys: Iterable[str]) -> None:
    """Raises ``DuplicateKeys`` if a key without nulls occurs twice."""
    keys = list(keys)
    if twice := duplicate_keys(rows, keys).limit(1).collect():
        raise DuplicateKeys(f"key {dict(zip(keys, twice[0]))} occurs {twice[0]['cnt']} times in the rows to merge")


def merged(target: DataFrame, rows: DataFrame, keys: Iterable[str], check: bool = True) -> DataFrame:
    """``rows`` in place of the target's rows with equal keys, and appended elsewhere.

    Rows with a null in their key replace nothing and are appended.  Without
    keys all rows are appended.  A key that occurs twice in ``rows`` has no
    defined winner and raises ``DuplicateKeys``.  The target is filtered by an
    anti join on the distinct keys only.
    """
    keys = list(keys)
    if not keys:
        return appended(target, rows)
    if check:
        check_keys(rows, keys)
    kept = target.join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.columns)
    return kept.unionByName(rows.select(*target.columns))


def partitions_replaced(target: DataFrame, rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``rows`` in place of all target rows whose partition occurs among them (null partitions too)."""
    columns = list(columns)
    names = {c: f"__p{i}" for i, c in enumerate(columns)}
    fresh = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).distinct()
    same = None
    for c, n in names.items():
        one = target[c].eqNullSafe(fresh[n])
        same = one if same is None else same & one
    kept = target.join(fresh, same, "left_anti").select(*target.columns)
    return kept.unionByName(rows.select(*target.columns))


def watermark(table: DataFrame, column: str) -> Any:
    """The largest value of the window column; None for no rows."""
    return table.agg(F.max(F.col(f"`{column}`")).alias("high")).first()["high"]


def window_rows(rows: DataFrame, column: str, high: Any, overlap: int | None = None) -> DataFrame:
    """The rows beyond the high-water mark, or beyond it less ``overlap`` seconds.

    Without a mark all rows are new.  The bound is a literal of the column's
    type, so that the filter reaches the scan.  Rows with a null in the column
    are never beyond a mark.  The overlap holds for time columns only.
    """
    if high is None:
        return rows
    kind: DataType = rows.schema[column].dataType
    bound = F.lit(high).cast(kind)
    if overlap and isinstance(kind, (TimestampType, TimestampNTZType)):
        bound = (bound - F.expr(f"INTERVAL '{overlap}' SECOND")).cast(kind)
    elif overlap and isinstance(kind, DateType):
        bound = F.date_sub(bound, -(-overlap // 86400))
    elif overlap and not isinstance(kind, NumericType):
        bound = F.lit(high).cast(kind)
    return rows.where(F.col(f"`{column}`") > bound)
