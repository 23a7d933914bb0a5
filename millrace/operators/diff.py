"""Data diffs between two versions of a table, and policies over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from millrace.sources.store import partition_label


@dataclass(frozen=True)
class Tolerance:
    """Numbers within either bound count as unchanged."""

    absolute: float | None = None
    relative: float | None = None


def changed(base: Column, candidate: Column, tolerance: Tolerance | None = None) -> Column:
    """Whether two values differ; nulls equal each other only."""
    if tolerance is None or (tolerance.absolute is None and tolerance.relative is None):
        return ~base.eqNullSafe(candidate)
    near = base == candidate
    gap = F.abs(base - candidate)
    if tolerance.absolute is not None:
        near = near | (gap <= F.lit(tolerance.absolute))
    if tolerance.relative is not None:
        near = near | (gap <= F.lit(tolerance.relative) * F.greatest(F.abs(base), F.abs(candidate)))
    return (base.isNull() != candidate.isNull()) | F.coalesce(~near, F.lit(False))


def _pairs(base: DataFrame, candidate: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Base and candidate rows side by side; null keys match, each side carries a flag of its presence."""
    b = base.select(*[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(keys + columns)], F.lit(True).alias("in_base"))
    c = candidate.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keys + columns)], F.lit(True).alias("in_candidate"))
    on = None
    for i in range(len(keys)):
        one = F.col(f"b{i}").eqNullSafe(F.col(f"c{i}"))
        on = one if on is None else on & one
    return b.join(c, on, "full")


def keyed_diff(base: DataFrame, candidate: DataFrame, keys: Iterable[str], columns: Iterable[str] | None = None, tolerances: dict[str, Tolerance] | None = None, compat: bool = False) -> DataFrame:
    """One row: base_rows, candidate_rows, added, removed, modified, unchanged, and changed_<column> for each column.

    Everything comes from one full join and one aggregation.  Absence is told
    by a flag; with ``compat`` by the first key being null, so that matched
    rows with a null key count as added and removed.
    """
    keys = list(keys)
    columns = [c for c in (columns or base.columns) if c not in keys]
    pairs = _pairs(base, candidate, keys, columns)
    if compat:
        in_b, in_c = F.col("b0").isNotNull(), F.col("c0").isNotNull()
    else:
        in_b, in_c = F.col("in_base").isNotNull(), F.col("in_candidate").isNotNull()
    both = in_b & in_c
    diffs = [changed(F.col(f"b{i}"), F.col(f"c{i}"), (tolerances or {}).get(c)) for i, c in enumerate(columns, len(keys))]
    any_change = F.lit(False)
    for d in diffs:
        any_change = any_change | d
    return pairs.agg(
        F.count("in_base").alias("base_rows"),
        F.count("in_candidate").alias("candidate_rows"),
        F.count_if(~in_b).alias("added"),
        F.count_if(~in_c).alias("removed"),
        F.count_if(both & any_change).alias("modified"),
        F.count_if(both & ~any_change).alias("unchanged"),
        *[F.count_if(both & d).alias(f"changed_{c}") for c, d in zip(columns, diffs)],
    )


def column_changes(report: DataFrame) -> DataFrame:
    """The changed_<column> counts of a keyed diff as rows (column_name, changed), without zeros."""
    names = [c for c in report.columns if c.startswith("changed_")]
    rows = F.explode(F.array(*[F.struct(F.lit(c[8:]).alias("column_name"), F.col(f"`{c}`").alias("changed")) for c in names]))
    return report.select(rows.alias("r")).select("r.column_name", "r.changed").where("changed > 0")


def aggregate_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Row counts only, for tables without a key."""
    return base.agg(F.count(F.lit(1)).alias("base_rows")).crossJoin(candidate.agg(F.count(F.lit(1)).alias("candidate_rows")))


def key_sample(table: DataFrame, keys: Iterable[str], percent: float) -> DataFrame:
    """The rows whose key's hash falls into a share: the same keys in any table."""
    return table.where(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(10000)) < int(percent * 100))


def rows_digest(columns: list[str]) -> Column:
    """An aggregate that tells multisets of rows apart in any order.

    Sums of two 64-bit hashes, as decimals: equal rows add up, where an
    exclusive or would cancel them in pairs.  Which values are null is hashed
    too, as the hash itself passes nulls over.
    """
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(v.isNull(), F.lit("1")).otherwise(F.lit("0")) for v in values])
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), nulls, *values).cast("decimal(38,0)"))
    return F.concat_ws(":", total(1).cast("string"), total(2).cast("string"))


def partition_diff(base: DataFrame, candidate: DataFrame, columns: Iterable[str], content: bool = False) -> DataFrame:
    """(partition, status, base_rows, candidate_rows) for partitions that were added, removed or changed.

    A partition has changed if its row count differs, or, with ``content``, the
    order-free digest of its rows.  Partitions are named as ``partition_label``
    says: null is told from every value, and values from their neighbours'.
    """
    value = partition_label(list(columns))

    def summary(table: DataFrame, side: str) -> DataFrame:
        digest = rows_digest(sorted(base.columns)) if content else F.lit(0)
        return table.groupBy(value.alias(f"p_{side}")).agg(F.count(F.lit(1)).alias(f"n_{side}"), digest.alias(f"d_{side}"))

    both = summary(base, "b").join(summary(candidate, "c"), F.col("p_b") == F.col("p_c"), "full")
    status = F.when(F.col("p_b").isNull(), "added").when(F.col("p_c").isNull(), "removed").when((F.col("n_b") != F.col("n_c")) | (F.col("d_b") != F.col("d_c")), "changed")
    return both.select(F.coalesce("p_b", "p_c").alias("partition"), status.alias("status"), F.coalesce("n_b", F.lit(0)).alias("base_rows"), F.coalesce("n_c", F.lit(0)).alias("candidate_rows")).where("status is not null")


# ---------------------------------------------------------------- schemas and policies

SAFE, REVIEW, FULL_REBUILD, ERROR = "safe", "review", "full_rebuild_required", "error"
SEVERITY = {SAFE: 0, REVIEW: 1, FULL_REBUILD: 2, ERROR: 3}


@dataclass(frozen=True)
class SchemaChange:
    kind: str  # added, removed, renamed, rename_ambiguous, type_changed, nullability_changed
    column: str
    safety: str
    detail: str = ""


def schema_changes(base: StructType, candidate: StructType, renames: dict[str, str] | None = None) -> list[SchemaChange]:
    """Changes between two schemas; names compare without case, ``renames`` maps new names to old ones."""
    old = {f.name.lower(): f for f in base}
    new = {f.name.lower(): f for f in candidate}
    out: list[SchemaChange] = []
    for to, source in sorted((renames or {}).items()):
        to, source = to.lower(), source.lower()
        if to in new and source in old and to not in old and source not in new:
            out.append(SchemaChange("renamed", to, REVIEW, f"from {source}"))
            moved = old.pop(source)
            old[to] = moved
        elif source in old and source in new:
            out.append(SchemaChange("rename_ambiguous", to, REVIEW, f"{source} is still there"))
    for name in [f.name.lower() for f in base if f.name.lower() in old and f.name.lower() not in new]:
        out.append(SchemaChange("removed", name, FULL_REBUILD))
    for f in candidate:
        name = f.name.lower()
        if name not in old:
            out.append(SchemaChange("added", name, SAFE if f.nullable else REVIEW))
            continue
        was = old[name]
        if was.dataType != f.dataType:
            numeric = isinstance(was.dataType, NumericType) and isinstance(f.dataType, NumericType)
            out.append(SchemaChange("type_changed", name, REVIEW if numeric else ERROR, f"{was.dataType.simpleString()} to {f.dataType.simpleString()}"))
        elif was.nullable != f.nullable:
            out.append(SchemaChange("nullability_changed", name, SAFE if f.nullable else REVIEW))
    return out


def safety(changes: Iterable[SchemaChange]) -> str:
    """The gravest safety of some changes."""
    return max((c.safety for c in changes), key=SEVERITY.__getitem__, default=SAFE)


@dataclass(frozen=True)
class Policy:
    max_added_rows: int | None = None
    max_removed_rows: int | None = None
    max_modified_rows: int | None = None
    max_changed_fraction: float | None = None
    require_keyed_diff: bool = False
    require_full_diff: bool = False


@dataclass(frozen=True)
class Verdict:
    passed: bool
    failures: tuple[str, ...] = field(default_factory=tuple)


def evaluate(policy: Policy, summary: dict, strategy: str = "keyed") -> Verdict:
    """Holds a diff's counts against a policy; a bound whose count wasn't measured fails."""
    bad: list[str] = []
    for name in ("added", "removed", "modified"):
        most = getattr(policy, f"max_{name}_rows")
        if most is not None:
            got = summary.get(name)
            if got is None:
                bad.append(f"{name} rows were not measured")
            elif got > most:
                bad.append(f"{got} rows {name}, at most {most} allowed")
    if policy.max_changed_fraction is not None:
        parts = [summary.get(n) for n in ("added", "removed", "modified")]
        if any(p is None for p in parts) or summary.get("base_rows") is None:
            bad.append("the changed fraction was not measured")
        elif (share := sum(parts) / max(summary["base_rows"], 1)) > policy.max_changed_fraction:
            bad.append(f"a fraction of {share:.6g} changed, at most {policy.max_changed_fraction:g} allowed")
    if policy.require_keyed_diff and strategy not in ("keyed", "full"):
        bad.append(f"a keyed diff is required, this is {strategy}")
    if policy.require_full_diff and strategy != "full":
        bad.append(f"a full diff is required, this is {strategy}")
    return Verdict(not bad, tuple(bad))
