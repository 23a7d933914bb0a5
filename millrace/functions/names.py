"""How functions of the model dialect are written in Spark SQL.

Each entry takes the argument texts and returns Spark SQL.
"""

from __future__ import annotations

from collections.abc import Callable


class UnsupportedSql(ValueError):
    """SQL that Spark would misread or reject, refused before it runs."""


def _renamed(name: str) -> Callable[[list[str]], str]:
    return lambda args: f"{name}({', '.join(args)})"


def _unit(text: str) -> str:
    return text.strip().strip("'").lower()


def _date_diff(args: list[str]) -> str:
    """Counts the unit's boundaries between two times, not elapsed units."""
    unit, a, b = _unit(args[0]), args[1], args[2]
    return f"CAST(timestampdiff({unit.upper()}, date_trunc('{unit}', {a}), date_trunc('{unit}', {b})) AS BIGINT)"


def _json_path(args: list[str]) -> str:
    return f"get_json_object({', '.join(args)})"


def _row(args: list[str]) -> str:
    return "named_struct(" + ", ".join(f"'field{i}', {a}" for i, a in enumerate(args)) + ")"


def _map(args: list[str]) -> str:
    if len(args) == 2 and all(a.strip().lower().startswith("array(") for a in args):
        return f"map_from_arrays({args[0]}, {args[1]})"
    return f"map({', '.join(args)})"


def _format(args: list[str]) -> str:
    return f"format_string({', '.join(args)})"


def _unless_null(name: str) -> Callable[[list[str]], str]:
    """Spark passes nulls over; the model dialect returns null if any argument is."""
    return lambda args: f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in args)} THEN NULL ELSE {name}({', '.join(args)}) END"


REWRITES: dict[str, Callable[[list[str]], str]] = {
    "approx_distinct": lambda a: f"approx_count_distinct({a[0]})",
    "approx_percentile": lambda a: f"CAST(percentile_approx({', '.join(a)}) AS DOUBLE)",
    "approx_set": _renamed("hll_sketch_agg"),
    "arbitrary": _renamed("any_value"),
    "cardinality": lambda a: f"hll_sketch_estimate({a[0]})" if a[0].startswith("hll_") else f"cardinality({', '.join(a)})",
    # A sum and not an exclusive or, which equal values would cancel in pairs.
    "checksum": lambda a: f"sum(CAST(xxhash64({a[0]}) AS DECIMAL(38, 0)))",
    "date_diff": _date_diff,
    "date_trunc": lambda a: f"CAST(date_trunc({', '.join(a)}) AS TIMESTAMP_NTZ)",
    "format": _format,
    "format_datetime": _renamed("date_format"),
    "greatest": _unless_null("greatest"),
    "is_nan": _renamed("isnan"),
    "json_extract": _json_path,
    "json_extract_scalar": _json_path,
    "least": _unless_null("least"),
    "map": _map,
    "merge": _renamed("hll_union_agg"),
    "row": _row,
    "strpos": lambda a: f"CAST(instr({', '.join(a)}) AS BIGINT)",
    "truncate": lambda a: f"(sign({a[0]}) * floor(abs({a[0]})))" if len(a) == 1 else _truncated(a),
}


def _truncated(args: list[str]) -> str:
    x, n = args
    return f"(sign({x}) * floor(abs({x}) * power(10, {n})) / power(10, {n}))"


#: Type names of the model dialect; anything else is left as it is.
TYPES = {
    "bytea": "binary",
    "char": "string",
    "double precision": "double",
    "hugeint": "decimal(38,0)",
    "json": "string",
    "real": "float",
    "text": "string",
    "timestamp": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "timestamptz": "timestamp",
    "uuid": "string",
    "varbinary": "binary",
    "varchar": "string",
}
