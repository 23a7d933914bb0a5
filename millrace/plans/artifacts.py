"""JSON artifacts: what a command found, as files that other tools read."""

from __future__ import annotations

import json
import os
from typing import Any

SCHEMA_VERSION = 1
KINDS = ("manifest", "graph", "lineage", "openlineage", "plan", "run", "promotion", "diff", "branch_diff", "environment", "lineage_diff")


def write_artifact(folder: str, kind: str, value: Any) -> str:
    """Writes one artifact beside the last one and renames it into place; returns its path."""
    if kind not in KINDS:
        raise ValueError(f"no artifact is called {kind}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{kind}.json")
    with open(path + ".new", "w") as f:
        json.dump({"schema_version": SCHEMA_VERSION, "kind": kind, "data": value}, f, indent=1, sort_keys=True, default=str)
    os.replace(path + ".new", path)
    return path


def read_artifact(folder: str, kind: str) -> Any:
    """The last artifact of a kind; None if there is none, an error if it has another version."""
    path = os.path.join(folder, f"{kind}.json")
    if not os.path.exists(path):
        return None
    with open(path) as f:
        value = json.load(f)
    if value.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{path} has version {value.get('schema_version')}")
    return value["data"]
