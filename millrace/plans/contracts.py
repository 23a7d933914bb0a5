"""Schema contracts: checks against a schema, and differences between two contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DataType, DecimalType, NumericType, StructType, _parse_datatype_string

from .compiler import CompiledModel
from .diagnostics import Diagnostic, error, warning
from .dialect import spark_type

SAFE, REVIEW, BREAKING = "safe", "review", "breaking"
_RANK = {SAFE: 0, REVIEW: 1, BREAKING: 2}


def parse_type(name: str) -> DataType | None:
    """A declared type as Spark's; None if it is none."""
    try:
        return _parse_datatype_string(spark_type(name.lower()))
    except Exception:  # the parser raises several kinds
        return None


def same_type(a: DataType, b: DataType) -> bool:
    """Equal types; decimals compare without precision."""
    return a == b or isinstance(a, DecimalType) and isinstance(b, DecimalType)


def validate(model: CompiledModel, schema: StructType | None) -> list[Diagnostic]:
    """Where a model's output breaks its contract: errors if enforced, else warnings."""
    contract = model.model.contract
    if not contract.columns:
        return []
    say = error if contract.enforced else warning
    if schema is None:
        return [warning("TYPE005", "the output's schema is unknown, so the contract can't be checked", model.id)]
    fields = {f.name.lower(): f for f in schema}
    out = []
    for name, (kind, nullable) in sorted(contract.columns.items()):
        f = fields.get(name.lower())
        if f is None:
            out.append(say("TYPE005", f"column {name} is missing", model.id))
            continue
        wanted = parse_type(kind) if kind else None
        if wanted is not None and not same_type(wanted, f.dataType):
            out.append(say("TYPE005", f"column {name} is {f.dataType.simpleString()}, the contract says {wanted.simpleString()}", model.id))
        if nullable is False and f.nullable and not any(a.kind == "not_null" and name in a.columns for a in model.assertions):
            out.append(say("TYPE005", f"column {name} may be null", model.id))
    return out


@dataclass(frozen=True)
class ContractChange:
    kind: str
    column: str
    severity: str
    detail: str = ""


def diff_contracts(old: dict | None, new: dict | None) -> list[ContractChange]:
    """Changes from one recorded contract to another.

    A recorded contract is {"enforced": bool, "columns": {name: [type, nullable]}, "renames": {new: old}}.
    """
    if not old and not new:
        return []
    if not old:
        return [ContractChange("contract_added", "", SAFE)]
    if not new:
        return [ContractChange("contract_removed", "", BREAKING if old["enforced"] else REVIEW)]
    out = []
    before, after = dict(old["columns"]), dict(new["columns"])
    for to, source in sorted(new.get("renames", {}).items()):
        if to in after and source in before and to not in before:
            if source in after:
                out.append(ContractChange("rename_ambiguous", to, REVIEW, f"{source} is still declared"))
                continue
            out.append(ContractChange("renamed", to, REVIEW, f"from {source}"))
            before[to] = before.pop(source)
    out += [ContractChange("removed", c, BREAKING) for c in sorted(before.keys() - after.keys())]
    out += [ContractChange("added", c, SAFE) for c in sorted(after.keys() - before.keys())]
    for c in sorted(before.keys() & after.keys()):
        (t0, n0), (t1, n1) = before[c], after[c]
        if t0 != t1:
            a, b = (parse_type(t) if t else None for t in (t0, t1))
            numeric = isinstance(a, NumericType) and isinstance(b, NumericType)
            out.append(ContractChange("type_changed", c, REVIEW if numeric or a is None or b is None else BREAKING, f"{t0} to {t1}"))
        if n0 != n1:
            out.append(ContractChange("nullability_changed", c, BREAKING if n0 is False else REVIEW, f"{n0} to {n1}"))
    if old["enforced"] != new["enforced"]:
        out.append(ContractChange("enforcement_changed", "", REVIEW, f"{old['enforced']} to {new['enforced']}"))
    return out


def diff_keys(old: tuple[str, ...] | None, new: tuple[str, ...] | None) -> list[ContractChange]:
    """Changes of the declared key; an unknown side makes it unverifiable."""
    if old is None or new is None:
        return [ContractChange("key_unverifiable", "", BREAKING)] if old != new else []
    if tuple(old) == tuple(new):
        return []
    if not old:
        return [ContractChange("key_added", ",".join(new), REVIEW)]
    if not new:
        return [ContractChange("key_removed", ",".join(old), BREAKING)]
    return [ContractChange("key_changed", ",".join(new), BREAKING, f"from {','.join(old)}")]


def gravest(changes: list[ContractChange]) -> str:
    return max((c.severity for c in changes), key=_RANK.__getitem__, default=SAFE)


def recorded(model: CompiledModel) -> dict:
    c = model.model.contract
    return {"enforced": c.enforced, "columns": {k: list(v) for k, v in sorted(c.columns.items())}, "renames": dict(sorted(c.renames.items()))} if c else {}
