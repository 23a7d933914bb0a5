"""As-of joins: each left row gets the last right row at or before its time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _cuts(times: DataFrame, slices: int) -> list:
    """The times that part all rows into about equal slices, without repeats; few, as many as asked for."""
    if slices < 2:
        return []
    share = [k / slices for k in range(1, slices)]
    kind = times.schema["__t"].dataType
    number = F.col("__t") if isinstance(kind, NumericType) else F.col("__t").cast("timestamp").cast("double")
    # The smallest time at or above each quantile of its number stands for it, so that no cast loses digits.
    points = times.agg(F.percentile_approx(number, share, 10000).alias("q")).first()["q"] or []
    found = times.agg(*[F.min(F.when(number >= F.lit(p), F.col("__t"))).alias(str(k)) for k, p in enumerate(points)]).first() if points else ()
    return sorted({c for c in found if c is not None})


def asof_join(left: DataFrame, right: DataFrame, by: Iterable[str], left_time: str, right_time: str, right_columns: Iterable[str], strict: bool = False, slices: int = 1) -> DataFrame:
    """``left`` with the named right columns of the latest match (null without one).

    Both sides are laid in one sequence per key and ordered by time; the last
    right row seen is carried forward.  That is one shuffle and one sort of
    each side, without the pairs that an inequality join makes.  Right rows at
    the same time as a left row match unless ``strict``.  Rows with a null key
    or time match nothing and stay.

    A key that holds a large share of all rows would be one task: with
    ``slices`` the time axis is cut at its quantiles, a key's slices are
    ordered apart, and each starts with the last right row of the slices before
    it, which takes one row for each key and slice.
    """
    by, wanted = list(by), list(right_columns)
    held = F.struct(*[F.col(f"`{c}`") for c in wanted])
    l = left.select(*by, F.col(f"`{left_time}`").alias("__t"), F.lit(0 if strict else 1).alias("__o"), F.struct("*").alias("__l"))
    r = right.where(F.col(f"`{right_time}`").isNotNull()).select(*by, F.col(f"`{right_time}`").alias("__t"), F.lit(1 if strict else 0).alias("__o"), held.alias("__r"))
    cuts = _cuts(l.select("__t").unionAll(r.select("__t")), slices)
    place = sum((F.when(F.col("__t") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    l, r = l.withColumn("__s", place), r.withColumn("__s", place)
    rows = l.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).unionByName(r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)))
    seen = Window.partitionBy(*by, "__s").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("__t").isNotNull()
    for k in by:
        known = known & F.col(f"`{k}`").isNotNull()
    carried = F.when(known, F.last("__r", ignorenulls=True).over(seen))
    out = rows.withColumn("__r", carried).where("__l is not null")
    if cuts:
        ends = r.groupBy(*by, "__s").agg(F.max_by("__r", F.col("__t")).alias("__before"))
        until = F.coalesce(F.lead("__s").over(Window.partitionBy(*by).orderBy("__s")), F.lit(len(cuts)))
        ends = ends.withColumn("__until", until).where("__until > __s")
        ends = ends.select(*by, F.explode(F.sequence(F.col("__s") + 1, F.col("__until"))).alias("__s"), "__before")
        out = out.join(ends, [*by, "__s"], "left").withColumn("__r", F.when(known, F.coalesce("__r", "__before")))
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in wanted])
