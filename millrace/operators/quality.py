"""Data-quality tests: every test is a query for the rows that violate it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.col(f"`{column}`").isNull())


def unique(table: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with cnt."""
    return table.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def accepted_values(table: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows with another value; nulls pass."""
    return table.where(~F.col(f"`{column}`").isin(list(values)))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows whose value has no parent; nulls pass."""
    keys = parent.select(F.col(f"`{field}`").alias("__key")).distinct()
    return child.where(F.col(f"`{column}`").isNotNull()).join(keys, child[column] == keys["__key"], "left_anti")


def expression_is_true(table: DataFrame, expression: str | Column) -> DataFrame:
    """Rows for which the expression is false; null passes."""
    condition = F.expr(expression) if isinstance(expression, str) else expression
    return table.where(~condition)


def accepted_range(table: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    value, wrong = F.col(f"`{column}`"), F.lit(False)
    if low is not None:
        wrong = wrong | ((value < low) if inclusive else (value <= low))
    if high is not None:
        wrong = wrong | ((value > high) if inclusive else (value >= high))
    return table.where(wrong)


def not_constant(table: DataFrame, column: str, group_by: Iterable[str] = ()) -> DataFrame:
    """Groups (or the table) in which the column has one distinct value."""
    return table.groupBy(*[F.col(f"`{c}`") for c in group_by]).agg(F.countDistinct(F.col(f"`{column}`")).alias("n_values")).where("n_values = 1")


def not_empty_string(table: DataFrame, column: str, trim: bool = True) -> DataFrame:
    value = F.col(f"`{column}`")
    return table.where((F.trim(value) if trim else value) == "")


def equality(a: DataFrame, b: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows that one side has more often than the other, from both sides.

    One aggregation of signed counts instead of two EXCEPT ALL: both tables are
    shuffled once, and equal rows cancel before the shuffle.
    """
    names = list(columns or a.columns)
    signed = a.select(*names).withColumn("__n", F.lit(1)).unionByName(b.select(*names).withColumn("__n", F.lit(-1)))
    left = signed.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return left.withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int")))).select(*names)


def equal_rowcount(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts if they differ."""
    counts = a.agg(F.count(F.lit(1)).alias("count_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("count_b")))
    return counts.where("count_a <> count_b")


@dataclass(frozen=True)
class TestOutcome:
    name: str
    status: str  # passed, failed, error, blocked
    violations: int = 0
    message: str = ""

    __test__ = False


def run_test(name: str, violations: DataFrame, where: str | None = None) -> TestOutcome:
    """Passes if no row violates the test; all violations are counted.

    ``where`` filters the violations, not the tested rows.
    """
    try:
        found = (violations.where(where) if where else violations).count()
    except Exception as e:  # a test that can't run has failed
        return TestOutcome(name, "error", 0, str(e).split("\n")[0][:500])
    return TestOutcome(name, "failed" if found else "passed", found)


def profile(table: DataFrame, not_nulls: Iterable[str], keys: Iterable[Iterable[str]] = ()) -> dict[str, int]:
    """Violation counts of many null checks in one scan; each key takes one aggregation more."""
    columns = list(not_nulls)
    out: dict[str, int] = {}
    if columns:
        row = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
        out |= {f"not_null:{c}": row[c] for c in columns}
    for key in keys:
        names = list(key)
        out[f"unique:{','.join(names)}"] = unique(table, names).count()
    return out
