"""Names of models and of the relations that they are built into."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SEGMENT = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True, order=True)
class ModelId:
    """A namespace and a path below it."""

    namespace: str
    path: tuple[str, ...]

    @staticmethod
    def parse(text: str) -> "ModelId":
        parts = text.split(".")
        if len(parts) < 2 or not all(_SEGMENT.fullmatch(p) for p in parts):
            raise ValueError(f"not a model id: {text!r}")
        return ModelId(parts[0], tuple(parts[1:]))

    @property
    def name(self) -> str:
        return ".".join((self.namespace, *self.path))

    @property
    def last(self) -> str:
        return self.path[-1]

    @property
    def uri(self) -> str:
        return "model://" + "/".join((self.namespace, *self.path))

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, order=True)
class Relation:
    """Where a table or view lives: optional catalog, schema and table."""

    schema: str
    table: str
    catalog: str | None = None

    @staticmethod
    def parse(parts: tuple[str, ...]) -> "Relation":
        if len(parts) > 3:
            raise ValueError(f"a relation has at most three parts: {'.'.join(parts)}")
        padded = ("",) * (3 - len(parts)) + tuple(parts)
        return Relation(padded[1], padded[2], padded[0] or None)

    @property
    def name(self) -> str:
        return ".".join(p for p in (self.catalog, self.schema, self.table) if p)

    @property
    def key(self) -> str:
        """schema.table, as the snapshot store names it."""
        return ".".join(p for p in (self.schema, self.table) if p)

    def quoted(self) -> str:
        return ".".join("`" + p.replace("`", "``") + "`" for p in (self.catalog, self.schema, self.table) if p)


def target_of(model: ModelId, schema: str) -> Relation:
    """A model's relation: its path joined by ``__``, with the namespace in front unless the schema is named like it."""
    table = "__".join(model.path)
    return Relation(schema, table if schema == model.namespace else f"{model.namespace}__{table}")
