"""Branch diffs, promotion gates, promotion and rollback."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import StructType

from millrace.operators import diff
from millrace.sources.store import MAIN, Commit, Conflict, Version

from . import contracts
from .compiler import CompiledModel
from .project import Project
from .runner import RunError
from .state import Record

GATES = ("run", "tests", "blocked", "schema", "data_diff", "base", "conflicts")


@dataclass
class DatasetDiff:
    model: str
    status: str  # added, removed, changed, unchanged, absent
    base_rows: int | None = None
    candidate_rows: int | None = None
    schema: list[str] = field(default_factory=list)
    safety: str = diff.SAFE
    contract: str = contracts.SAFE
    report: dict | None = None
    passed: bool | None = None
    failures: tuple[str, ...] = ()


@dataclass
class BranchDiff:
    base: str
    candidate: str
    base_head: str
    candidate_head: str
    deep: bool
    datasets: list[DatasetDiff]
    #: Changed model -> the models downstream of it, in order.
    impacts: dict[str, list[str]] = field(default_factory=dict)

    def of(self, status: str) -> list[str]:
        return [d.model for d in self.datasets if d.status == status]


def _schema(v: Version | None) -> StructType | None:
    return StructType.fromJson(json.loads(v.schema)) if v is not None and v.schema else None


def branch_diff(project: Project, candidate: str, base: str = MAIN, deep: bool = False, rows: bool = False) -> BranchDiff:
    """How every model's dataset differs between two branches.

    Statuses come from the heads and the recorded versions alone.  With
    ``rows`` the rows of changed tables are counted; ``deep`` runs keyed diffs
    of changed tables that have a key or a policy; several tables at a time.
    """
    a, b = project.store.head(base), project.store.head(candidate)
    old = {r.model: r for r in project.state.records(base)}
    new = {r.model: r for r in project.state.records(candidate)}
    out, changed = [], []
    for i in project.compiled.order:
        m = project.compiled.models[i]
        if m.materialization == "ephemeral":
            continue
        x, y = a.tables.get(m.target.key), b.tables.get(m.target.key)
        if x is None or y is None:
            status = "absent" if x is None and y is None else "added" if x is None else "removed"
            out.append(DatasetDiff(i.name, status))
            continue
        if x.id == y.id:
            status = "unchanged"
        elif i.name in new:
            status = "changed" if i.name not in old or old[i.name].version != new[i.name].version or x.id != y.id else "unchanged"
        else:
            status = "changed"
        d = DatasetDiff(i.name, status)
        out.append(d)
        if status == "changed" and x.kind == "table" and y.kind == "table":
            changed.append((d, m, x, y))

    def compare(item: tuple[DatasetDiff, CompiledModel, Version, Version]) -> None:
        d, m, x, y = item
        name = m.id.name
        changes = diff.schema_changes(_schema(x), _schema(y), m.model.contract.renames)
        d.schema, d.safety = [f"{c.kind} {c.column} {c.detail}".strip() for c in changes], diff.safety(changes)
        moved = contracts.diff_contracts(old[name].contract if name in old else None, new[name].contract if name in new else None)
        d.contract = contracts.gravest(moved)
        if deep and (m.key or m.model.policy):
            strategy, report, verdict = project.diff(name, base, candidate)
            d.report = report.first().asDict()
            d.base_rows, d.candidate_rows = d.report["base_rows"], d.report["candidate_rows"]
            d.passed, d.failures = (verdict.passed, verdict.failures) if verdict else (True, ())
        elif rows or deep:
            d.base_rows, d.candidate_rows = project.store.read(x).count(), project.store.read(y).count()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(compare, changed))
    graph = project.compiled.graph
    ids = {i.name: i for i in project.compiled.order}
    impacts = {d.model: [i.name for i in project.compiled.order if i in graph.downstream({ids[d.model]}) - {ids[d.model]}] for d in out if d.status in ("added", "removed", "changed")}
    found = BranchDiff(base, candidate, a.id, b.id, deep, out, impacts)
    project.state.evidence("branch_diff", f"{base}..{candidate}", {"base_head": a.id, "candidate_head": b.id, "deep": deep, "datasets": [asdict(d) for d in out]})
    return found


@dataclass(frozen=True)
class Gate:
    name: str
    passed: bool
    detail: str = ""


def _id(commit: Commit, key: str) -> str | None:
    return commit.tables[key].id if key in commit.tables else None


def evaluate_gates(project: Project, candidate: str, target: str = MAIN, require_diff: bool = False, allow_breaking: bool = False) -> list[Gate]:
    """All gates in their fixed order; what can't be shown to hold has failed."""
    head, goal = project.store.head(candidate), project.store.head(target)
    runs = [r for r in project.state.runs(candidate) if r["status"] in ("passed", "failed")]
    last = next((r for r in runs if r["head"] == head.id), None)
    out = [Gate("run", last is not None and last["status"] == "passed", "the candidate's head was validated by a passed run" if last else "no run validated the candidate's head")]
    tests = project.state.test_runs(last["id"]) if last else {}
    bad = sorted(t for t, r in tests.items() if r["status"] in ("failed", "error"))
    out.append(Gate("tests", last is not None and not bad, ", ".join(bad)))
    blocked = sorted([m for m, r in (project.state.model_runs(last["id"]) if last else {}).items() if r["status"] == "blocked"] + [t for t, r in tests.items() if r["status"] == "blocked"])
    out.append(Gate("blocked", last is not None and not blocked, ", ".join(blocked)))
    audit = next((e["detail"] for e in project.state.evidences("branch_diff", f"{target}..{candidate}") if (e["detail"]["base_head"], e["detail"]["candidate_head"]) == (goal.id, head.id)), None)
    # What differs between the heads has to be in the diff: models may have come since it was made.
    differ = {i.name for i, m in project.compiled.models.items() if m.materialization != "ephemeral" and _id(head, m.target.key) != _id(goal, m.target.key)}
    uncovered = sorted(differ - {d["model"] for d in audit["datasets"]}) if audit else []
    if candidate == target:
        out.append(Gate("schema", False, "a branch can't be promoted to itself"))
    elif audit is None:
        out.append(Gate("schema", False, "no branch diff of these heads"))
    elif uncovered:
        out.append(Gate("schema", False, f"the branch diff doesn't cover {', '.join(uncovered)}"))
    else:
        grave = [d["model"] for d in audit["datasets"] if diff.SEVERITY[d["safety"]] >= diff.SEVERITY[diff.FULL_REBUILD] or d["contract"] == contracts.BREAKING]
        out.append(Gate("schema", allow_breaking or not grave, ", ".join(grave)))
    if require_diff:
        deep = next((e["detail"] for e in project.state.evidences("branch_diff", f"{target}..{candidate}") if e["detail"]["deep"] and (e["detail"]["base_head"], e["detail"]["candidate_head"]) == (goal.id, head.id)), None)
        failed = [d["model"] for d in deep["datasets"] if d["passed"] is False] if deep else []
        out.append(Gate("data_diff", deep is not None and not failed, ", ".join(failed) if deep else "no deep diff of these heads"))
    else:
        out.append(Gate("data_diff", True, "not required"))
    made = project.store.provenance(candidate)
    moved = made is None or made[0] != target or made[1] != goal.id
    out.append(Gate("base", not moved, "the candidate's origin is unknown" if made is None else f"{target} has moved since the candidate was made" if moved else ""))
    clash = project.store.conflicts(candidate, target)
    out.append(Gate("conflicts", not clash, ", ".join(clash)))
    return out


def promote(project: Project, candidate: str, target: str = MAIN, require_diff: bool = False, allow_breaking: bool = False, cleanup: bool = False) -> Commit:
    """Merges a candidate whose gates all pass; the records of what it built move along."""
    goal = project.store.head(target)
    failed = [g for g in evaluate_gates(project, candidate, target, require_diff, allow_breaking) if not g.passed]
    if failed:
        raise RunError("promotion refused: " + "; ".join(f"{g.name} ({g.detail})" for g in failed))
    made = project.store.merge(candidate, target, goal.id)
    for r in project.state.records(candidate):
        live = made.tables.get(r.target)
        if live is not None and live.id == r.output_identity:
            project.state.record(Record(r.model, target, r.version, r.components, r.target, r.strategy, r.key, r.output_identity, r.contract, r.adapter, run=r.run))
    project.state.promotion(candidate, target, made.id, {"from": goal.id})
    if cleanup:
        project.store.delete_branch(candidate)
    return made


def rollback(project: Project, commit: str, branch: str = MAIN) -> Commit:
    """Points a branch at an earlier commit of its own history."""
    if commit not in project.store.ancestors(project.store.head(branch).id):
        raise Conflict(f"{commit} is not in the history of {branch}")
    return project.store.reset(branch, commit, project.store.head(branch).id)


def changed_models(diffs: Iterable[DatasetDiff]) -> list[str]:
    return [d.model for d in diffs if d.status in ("added", "removed", "changed")]
