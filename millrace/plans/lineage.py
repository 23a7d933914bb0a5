"""The lineage graph: datasets, columns, models and tests, and how they derive."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .analysis import DIRECT, Analysis, Input
from .compiler import Compiled
from .identity import ModelId

INPUT, OUTPUT, DERIVES, CONTAINS, TESTS = "input", "output", "derives", "contains", "tests"


@dataclass(frozen=True, order=True)
class Node:
    kind: str  # model, dataset, column, test
    name: str


@dataclass(frozen=True, order=True)
class Edge:
    kind: str
    source: Node
    target: Node
    detail: str = ""


@dataclass
class LineageGraph:
    nodes: set[Node] = field(default_factory=set)
    edges: set[Edge] = field(default_factory=set)

    @staticmethod
    def build(compiled: Compiled, analyses: dict[ModelId, Analysis]) -> "LineageGraph":
        g = LineageGraph()

        def add(kind: str, a: Node, b: Node, detail: str = "") -> None:
            g.nodes |= {a, b}
            g.edges.add(Edge(kind, a, b, detail))

        for i, m in compiled.models.items():
            model, dataset = Node("model", i.name), Node("dataset", i.name)
            add(OUTPUT, model, dataset)
            for d in m.depends:
                add(INPUT, Node("dataset", d.name), model)
                add(DERIVES, Node("model", d.name), model)
                add(DERIVES, Node("dataset", d.name), dataset)
            for s in m.sources:
                add(INPUT, Node("dataset", s.name), model)
                add(DERIVES, Node("dataset", s.name), dataset)
            found = analyses.get(i)
            for f in (found.schema if found and found.schema else ()):
                add(CONTAINS, dataset, Node("column", f"{i.name}.{f.name}"))
            for column, inputs in (found.inputs if found else {}).items():
                for x in inputs:
                    source = Node("column", f"{x.relation}.{x.column}")
                    add(CONTAINS, Node("dataset", x.relation), source)
                    add(DERIVES, source, Node("column", f"{i.name}.{column}"), f"{x.directness}:{x.transformation}")
        for t in compiled.tests.values():
            for target in t.targets:
                add(TESTS, Node("dataset", target.name), Node("test", t.name))
        return g

    def _step(self, node: Node, forward: bool, kinds: Iterable[str], direct_only: bool) -> list[Node]:
        if not hasattr(self, "_out"):
            self._out, self._in = {}, {}
            for e in self.edges:
                self._out.setdefault(e.source, []).append(e)
                self._in.setdefault(e.target, []).append(e)
        edges = (self._out if forward else self._in).get(node, ())
        return [e.target if forward else e.source for e in edges if e.kind in kinds and not (direct_only and e.detail and not e.detail.startswith(DIRECT))]

    def reach(self, start: Node, forward: bool = True, direct_only: bool = False) -> list[Node]:
        """Everything downstream (or upstream) of a node along derivations."""
        kinds = (DERIVES,)
        seen: set[Node] = set()
        stack = [start]
        while stack:
            for n in self._step(stack.pop(), forward, kinds, direct_only):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return sorted(seen)

    def impact(self, start: Node) -> dict[str, list[str]]:
        """Columns, models and tests downstream of a column, model or dataset."""
        starts = [start]
        if start.kind in ("model", "dataset"):
            starts = [Node("dataset", start.name), *self._step(Node("dataset", start.name), True, (CONTAINS,), False)]
        found = {n for s in starts for n in self.reach(s)}
        datasets = {n.name for n in found if n.kind == "dataset"} | {n.name.rsplit(".", 1)[0] for n in found if n.kind == "column"}
        own = start.name.rsplit(".", 1)[0] if start.kind == "column" else start.name
        tests = {t.name for d in datasets | {own} for t in self._step(Node("dataset", d), True, (TESTS,), False)}
        return {"columns": sorted(n.name for n in found if n.kind == "column"), "models": sorted(datasets - {own}), "tests": sorted(tests)}

    def subgraph(self, around: Node) -> "LineageGraph":
        keep = {around, *self.reach(around), *self.reach(around, False)}
        return LineageGraph(keep, {e for e in self.edges if e.source in keep and e.target in keep})

    def fingerprint(self) -> str:
        lines = sorted(f"{e.kind}|{e.source.kind}:{e.source.name}|{e.target.kind}:{e.target.name}|{e.detail}" for e in self.edges)
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"nodes": [[n.kind, n.name] for n in sorted(self.nodes)], "edges": [[e.kind, e.source.kind, e.source.name, e.target.kind, e.target.name, e.detail] for e in sorted(self.edges)]}, sort_keys=True)

    @staticmethod
    def from_json(value: str) -> "LineageGraph":
        raw = json.loads(value)
        return LineageGraph({Node(*n) for n in raw["nodes"]}, {Edge(k, Node(a, b), Node(c, d), x) for k, a, b, c, d, x in raw["edges"]})

    def edges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.kind, e.source.kind, e.source.name, e.target.kind, e.target.name, e.detail) for e in sorted(self.edges)]
        return spark.createDataFrame(rows, "kind string, source_kind string, source string, target_kind string, target string, detail string")


@dataclass
class LineageDiff:
    nodes_added: list[Node]
    nodes_removed: list[Node]
    edges_added: list[Edge]
    edges_removed: list[Edge]
    edges_changed: list[tuple[Node, Node, tuple[str, ...], tuple[str, ...]]]
    orphaned: list[str]

    @property
    def empty(self) -> bool:
        return not (self.nodes_added or self.nodes_removed or self.edges_added or self.edges_removed or self.edges_changed)


def lineage_diff(base: LineageGraph, candidate: LineageGraph) -> LineageDiff:
    """Differences of two graphs; edges between the same nodes compare as multisets of their details.

    ``orphaned`` names the consumers, on the base side, of nodes that are gone.
    """

    def grouped(g: LineageGraph) -> dict:
        out: dict = {}
        for e in g.edges:
            out.setdefault((e.kind, e.source, e.target), Counter())[e.detail] += 1
        return out

    a, b = grouped(base), grouped(candidate)
    gone = sorted(base.nodes - candidate.nodes)
    changed = [(s, t, tuple(sorted(a[k].elements())), tuple(sorted(b[k].elements()))) for k in sorted(a.keys() & b.keys()) if a[k] != b[k] for _, s, t in [k]]
    edge = lambda g, keys: sorted(e for e in g.edges if (e.kind, e.source, e.target) in keys)
    orphans = {n.name for g in gone for n in base.reach(g)} - {n.name for n in gone}
    return LineageDiff(sorted(candidate.nodes - base.nodes), gone, edge(candidate, b.keys() - a.keys()), edge(base, a.keys() - b.keys()), changed, sorted(orphans))


def open_lineage(compiled: Compiled, analyses: dict[ModelId, Analysis], namespace: str, producer: str, when: str) -> list[dict]:
    """OpenLineage events: one for each model's job and one for each dataset."""
    events: list[dict] = []
    base = {"producer": producer, "eventTime": when}
    facet = lambda name: {"_producer": producer, "_schemaURL": f"https://openlineage.io/spec/facets/1-0-0/{name}.json"}

    def schema(i: ModelId) -> dict:
        found = analyses.get(i)
        fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in found.schema] if found and found.schema else []
        return facet("SchemaDatasetFacet") | {"fields": fields}

    def column_lineage(inputs: dict[str, tuple[Input, ...]]) -> dict:
        return facet("ColumnLineageDatasetFacet") | {
            "fields": {c: {"inputFields": [{"namespace": namespace, "name": x.relation, "field": x.column, "transformations": [{"type": x.directness, "subtype": x.transformation}]} for x in found]} for c, found in inputs.items()}
        }

    kinds = {"view": ("VIEW", None), "table": ("TABLE", None), "incremental": ("TABLE", None), "ephemeral": ("JOB_OUTPUT", "TEMPORARY")}
    sources: set[str] = set()
    for i in compiled.order:
        m = compiled.models[i]
        kind, sub = kinds[m.materialization]
        found = analyses.get(i)
        facets = {"schema": schema(i), "datasetType": facet("DatasetTypeDatasetFacet") | {"datasetType": kind} | ({"subType": sub} if sub else {})}
        if m.materialization != "ephemeral":
            facets["symlinks"] = facet("SymlinksDatasetFacet") | {"identifiers": [{"namespace": namespace, "name": m.target.name, "type": kind}]}
        if found and found.inputs:
            facets["columnLineage"] = column_lineage(found.inputs)
        inputs = [{"namespace": namespace, "name": n} for n in [*(d.name for d in m.depends), *(s.name for s in m.sources)]]
        sources |= {s.name for s in m.sources}
        events.append(base | {"schemaURL": "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/JobEvent", "job": {"namespace": namespace, "name": i.name, "facets": {"sql": facet("SQLJobFacet") | {"query": m.sql}}}, "inputs": inputs, "outputs": [{"namespace": namespace, "name": i.name, "facets": facets}]})
        events.append(base | {"schemaURL": "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/DatasetEvent", "dataset": {"namespace": namespace, "name": i.name, "facets": facets}})
    for s in sorted(sources):
        events.append(base | {"schemaURL": "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/DatasetEvent", "dataset": {"namespace": namespace, "name": s, "facets": {"datasetType": facet("DatasetTypeDatasetFacet") | {"datasetType": "TABLE", "subType": "EXTERNAL"}}}})
    return events
