"""Comment directives: ``-- @name value`` lines that configure a model."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .diagnostics import Diagnostic, error, warning
from .identity import ModelId

MATERIALIZATIONS = ("view", "table", "ephemeral", "incremental")
_LINE = re.compile(r"^\s*--\s*@([A-Za-z][\w-]*)\s*(.*?)\s*$")


@dataclass(frozen=True)
class Incremental:
    """How an incremental model takes up new rows."""

    strategy: str  # append, key, partition, window
    columns: tuple[str, ...] = ()
    overlap: str | None = None


@dataclass
class Directives:
    id: ModelId | None = None
    materialization: str | None = None
    incremental: Incremental | None = None
    tags: tuple[str, ...] = ()
    owner: str | None = None
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    diagnostics: list[Diagnostic] = field(default_factory=list)


def _names(value: str) -> tuple[str, ...]:
    return tuple(p.strip().strip('"') for p in value.split(",") if p.strip())


def _merge(old: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({*old, *more}))


def incremental_of(value: str) -> Incremental | None:
    """``append``, ``key=a,b``, ``partition=a`` or ``window=c``; None if it is none of them."""
    if value == "append":
        return Incremental("append")
    strategy, _, rest = value.partition("=")
    columns = _names(rest)
    if strategy.strip() in ("key", "partition", "window") and columns and (strategy.strip() != "window" or len(columns) == 1):
        return Incremental(strategy.strip(), columns)
    return None


def parse_directives(sql: str, where: object = "") -> Directives:
    """All directives of a model file; lists are sorted and freed of repeats."""
    out = Directives()

    def materialize(kind: str) -> None:
        if out.materialization not in (None, kind):
            out.diagnostics.append(error("PARSE002", f"@{kind} conflicts with @{out.materialization}", where))
        else:
            out.materialization = kind

    for line in sql.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        name, value = m[1].lower(), m[2]
        bad = error("PARSE002", f"@{name} has an invalid value {value!r}", where)
        if name in ("view", "table", "ephemeral"):
            out.diagnostics += [bad] if value else []
            materialize(name)
        elif name == "materialized":
            if value in MATERIALIZATIONS:
                materialize(value)
            else:
                out.diagnostics.append(bad)
        elif name == "incremental":
            found = incremental_of(value)
            if found is None:
                out.diagnostics.append(bad)
                continue
            materialize("incremental")
            out.incremental = found
            if found.strategy == "key":
                out.key = _merge(out.key, found.columns)
        elif name == "id":
            try:
                out.id = ModelId.parse(value)
            except ValueError:
                out.diagnostics.append(bad)
        elif name == "owner":
            if value:
                out.owner = value
            else:
                out.diagnostics.append(bad)
        elif name in ("tags", "key", "not-null"):
            names = _names(value)
            if not names:
                out.diagnostics.append(bad)
            field_name = name.replace("-", "_")
            setattr(out, field_name, _merge(getattr(out, field_name), names))
        else:
            out.diagnostics.append(warning("PARSE003", f"unknown directive @{name}", where))
    return out
