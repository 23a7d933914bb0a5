"""Selecting models by terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from .compiler import Compiled
from .identity import ModelId


class SelectionError(ValueError):
    """Terms that select nothing, or not one thing."""


@dataclass(frozen=True)
class Term:
    body: str
    up: bool
    down: bool

    @staticmethod
    def parse(text: str) -> "Term":
        up, down = text.startswith("+"), text.endswith("+") and len(text) > 1
        body = text[up : len(text) - down]
        if not body or "+" in body:
            raise SelectionError(f"malformed term {text!r}")
        return Term(body, up, down)


def _base(compiled: Compiled, body: str, changed: Callable[[], set[ModelId]] | None) -> set[ModelId]:
    models = compiled.models
    kind, sep, value = body.partition(":")
    if sep:
        if kind == "tag":
            found = {i for i, m in models.items() if value in m.model.tags}
        elif kind == "namespace":
            found = {i for i in models if i.namespace == value}
        elif kind == "workflow":
            found = {i for i, m in models.items() if m.model.workflow == value}
        elif kind == "owner":
            found = {i for i, m in models.items() if m.model.owner == value}
        elif kind == "source":
            found = {i for i, m in models.items() if any(s.name.lower() == value.lower() or s.name.lower().endswith("." + value.lower()) for s in m.sources)}
        else:
            raise SelectionError(f"unknown kind of term {kind!r}")
    elif body == "all":
        return set(models)
    elif body == "changed":
        if changed is None:
            raise SelectionError("nothing tells here what has changed")
        return changed()
    elif body.endswith(".*"):
        stem = body[:-2]
        found = {i for i in models if i.name.startswith(stem + ".")}
    else:
        exact = [i for i in models if i.name == body]
        if exact:
            return set(exact)
        named = [i for i in models if i.last == body or ".".join(i.path) == body]
        if len(named) > 1:
            raise SelectionError(f"{body} may be {', '.join(map(str, sorted(named)))}")
        found = set(named)
    if not found:
        raise SelectionError(f"{body} selects no model")
    return found


def select(
    compiled: Compiled,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    tags: Iterable[str] = (),
    workflows: Iterable[str] = (),
    upstream: bool = False,
    downstream: bool = False,
    changed: Callable[[], set[ModelId]] | None = None,
) -> list[ModelId]:
    """The selected models in topological order.

    Includes are united (none: all) and expanded by their plus signs; filters
    intersect the result; upstream and downstream then widen it; excludes,
    expanded as well, have the last word.
    """
    chosen = _union(compiled, include, changed) if include else set(compiled.models)
    for t in tags:
        chosen &= {i for i, m in compiled.models.items() if t in m.model.tags}
    wanted = list(workflows)
    if wanted:
        chosen &= {i for i, m in compiled.models.items() if m.model.workflow in wanted or i.namespace in wanted}
    base = set(chosen)
    if upstream:
        chosen |= compiled.graph.upstream(base)
    if downstream:
        chosen |= compiled.graph.downstream(base)
    chosen -= _union(compiled, exclude, changed)
    return [i for i in compiled.order if i in chosen]


def _union(compiled: Compiled, terms: Iterable[str], changed: Callable[[], set[ModelId]] | None) -> set[ModelId]:
    out: set[ModelId] = set()
    for raw in terms:
        term = Term.parse(raw)
        found = _base(compiled, term.body, changed)
        out |= found
        if term.up:
            out |= compiled.graph.upstream(found)
        if term.down:
            out |= compiled.graph.downstream(found)
    return out
