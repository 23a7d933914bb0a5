"""The command line: ``python -m millrace.cli <command>``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from dataclasses import asdict, is_dataclass
from typing import Any

from millrace.plans.artifacts import write_artifact
from millrace.plans.compiler import Compiled, compile_workspace
from millrace.plans.diagnostics import CODES
from millrace.plans.gitdiff import GitError, changed_since
from millrace.plans.identity import ModelId
from millrace.plans.selection import SelectionError, select
from millrace.plans.workspace import CONFIG, Workspace

STATE_DIR = ".millrace"
#: Commands whose result is kept as an artifact, by the artifact's name.
ARTIFACTS = {"manifest": "manifest", "graph": "graph", "plan": "plan", "apply": "run", "run": "run", "promote": "promotion"}


def plain(value: Any) -> Any:
    """A value as JSON has it."""
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


class App:
    """One invocation: the parsed arguments, the workspace, and Spark once it is needed."""

    def __init__(self, args: argparse.Namespace, spark: Any = None) -> None:
        self.args, self._spark, self._project = args, spark, None

    # -- parts

    @property
    def compiled(self) -> Compiled:
        return self.project.compiled if self._project else compile_workspace(Workspace.load(self.args.root))

    @property
    def spark(self) -> Any:
        if self._spark is None:
            from pyspark.sql import SparkSession

            self._spark = SparkSession.builder.appName("millrace").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            self._spark.sparkContext.setLogLevel("ERROR")
        return self._spark

    @property
    def project(self) -> Any:
        if self._project is None:
            from millrace.plans.project import Project, catalog_sources, folder_sources, folder_states
            from millrace.plans.state import State

            folder = os.path.join(self.args.root, STATE_DIR)
            os.makedirs(folder, exist_ok=True)
            if not self.args.warehouse and not self.spark.sparkContext.master.startswith("local"):
                raise SelectionError("--warehouse names no folder: executors can't write to this machine's")
            warehouse = self.args.warehouse or "file://" + os.path.abspath(os.path.join(folder, "warehouse"))
            sources = folder_sources(self.spark, self.args.sources) if self.args.sources else catalog_sources(self.spark)
            states = folder_states(self.spark, self.args.sources) if self.args.sources else None
            self._project = Project(self.spark, self.args.root, warehouse, sources, State(os.path.join(folder, "state.db")), states)
        return self._project

    def selected(self) -> list[ModelId]:
        a = self.args
        return select(self.compiled, a.terms, a.exclude, a.tag, a.workflow, a.upstream, a.downstream, self.changes)

    def changes(self) -> set[ModelId]:
        if self.args.since:
            return changed_since(self.compiled, self.args.since)
        from millrace.plans.planner import BUILD, Planner

        p = self.project
        return set(Planner(p.compiled, p.store, p.state, self.args.environment).plan().of(BUILD))

    # -- commands

    def check(self) -> tuple[Any, bool]:
        """Types are checked too: every query against its inputs' columns, as far as sources are known."""
        notes = self.compiled.diagnostics if not self.compiled.ok else self.project.check()
        ok = not any(d.severity == "error" for d in notes)
        return {"models": len(self.compiled.models), "diagnostics": [asdict(d) | {"meaning": CODES[d.code]} for d in notes]}, ok

    def list(self) -> Any:
        return [{"id": i.name, "materialization": m.materialization, "target": m.target.name, "tags": m.model.tags, "owner": m.model.owner} for i in self.selected() for m in [self.compiled.models[i]]]

    def inspect(self) -> Any:
        m = self.compiled.models[select(self.compiled, [self.args.model])[0]]
        return {"id": m.id.name, "uri": m.id.uri, "file": m.model.file, "materialization": m.materialization, "target": m.target.name, "depends": [d.name for d in m.depends], "sources": [s.name for s in m.sources], "key": m.key, "assertions": m.assertions, "version": m.version, "components": m.components, "sql": m.sql}

    def graph(self) -> Any:
        return {"order": [i.name for i in self.compiled.order], "depends": {i.name: [d.name for d in m.depends] for i, m in self.compiled.models.items()}}

    def _plan(self) -> Any:
        a = self.args
        if a.environment != "main":
            self.project.ensure(a.environment, a.source)
        banned = select(self.compiled, a.exclude) if a.exclude else ()
        errors = [d for d in self.compiled.diagnostics if d.severity == "error"]
        if errors:
            raise SelectionError("; ".join(map(str, errors[:5])))
        chosen = self.selected()
        plain = select(self.compiled, [t.strip("+") for t in a.terms], a.exclude, a.tag, a.workflow, False, False, self.changes) if a.terms or a.upstream or a.downstream else chosen
        return self.project.plan_of(chosen, banned, a.environment, a.force, expanded=set(chosen) - set(plain), changed=changed_since(self.compiled, a.since) if getattr(a, "since", None) else ())

    def plan(self) -> Any:
        plan = self._plan()
        return {"environment": plan.environment, "summary": plan.summary(), "seeds": plan.seeds, "tests": plan.tests, "warnings": plan.warnings, "actions": [{"model": m.name, "action": x.kind, "reasons": x.reasons, "membership": x.membership} for m, x in plan.actions.items()]}

    def explain(self) -> Any:
        wanted = select(self.compiled, [self.args.model])[0]
        self.args.terms = [wanted.name]
        action = self._plan().actions[wanted]
        return {"model": wanted.name, "action": action.kind, "reasons": action.reasons, "version": action.version}

    def run(self) -> tuple[Any, bool]:
        a, options = self.args, {"jobs": self.args.jobs, "retries": self.args.retries, "fail_fast": self.args.fail_fast, "timeout": self.args.model_timeout}
        if a.resume:
            result = self.project.resume(a.resume, **options)
        elif a.retry_failed:
            result = self.project.retry_failed(a.retry_failed, **options)
        else:
            result = self.project.apply(self._plan(), **options)
        models = {m.name: {"status": o.status, "message": o.message, "attempts": o.attempts} for m, o in result.models.items()}
        return {"run": result.run, "status": result.status, "models": models, "tests": result.tests, "seeds": result.seeds}, result.status == "passed"

    apply = run

    def test(self) -> tuple[Any, bool]:
        found = self.project.test(self.args.terms, self.args.environment)
        return found, all(t.status == "passed" for t in found.values())

    def _lineage(self) -> Any:
        from millrace.plans.analysis import Analyzer
        from millrace.plans.lineage import LineageGraph

        def schema(relation: Any) -> Any:
            try:
                df = self.project.sources(relation)
            except Exception:  # an unknown source has no schema
                return None
            return df.schema if df is not None else None

        analyzer = Analyzer(self.spark, self.project.compiled, schema)
        return analyzer.run(), LineageGraph, analyzer

    def lineage(self) -> Any:
        from millrace.plans.lineage import Node, open_lineage

        if self.args.diff:
            return self._lineage_diff(*self.args.diff)
        analyses, graph, _ = self._lineage()
        if self.args.format == "openlineage":
            return open_lineage(self.compiled, analyses, "millrace", "https://example.org/millrace", dt.datetime.now(dt.timezone.utc).isoformat())
        built = graph.build(self.compiled, analyses)
        if self.args.target:
            kind = "column" if self.args.target not in {i.name for i in self.compiled.models} else "dataset"
            node = Node(kind, self.args.target)
            return {"upstream": built.reach(node, False), "downstream": built.reach(node)}
        return json.loads(built.to_json())

    def _lineage_diff(self, base: str, candidate: str | None = None) -> Any:
        """Two exported graphs, or an exported one and the workspace's present one."""
        from millrace.plans.lineage import LineageGraph, lineage_diff

        def load(path: str) -> Any:
            with open(path) as f:
                return LineageGraph.from_json(f.read())

        if candidate:
            new = load(candidate)
        else:
            analyses, graph, _ = self._lineage()
            new = graph.build(self.compiled, analyses)
        return lineage_diff(load(base), new)

    def translate(self) -> tuple[Any, bool]:
        from millrace.translate.project import translate

        done = translate(self.args.project)
        written = done.write(self.args.out, self.args.overwrite) if self.args.out and not self.args.check else []
        found = [{"kind": o.kind, "name": o.name, "classification": o.classification, "findings": o.findings} for o in done.outcomes]
        return {"summary": done.summary(), "resources": found, "written": written}, not done.summary()["UNSUPPORTED"]

    def daemon(self) -> Any:
        from millrace.service import Service, server

        a = self.args
        server(Service(a.root, self.spark, a.sources, a.warehouse, a.token), "127.0.0.1", a.port).serve_forever()

    def impact(self) -> Any:
        from millrace.plans.lineage import Node

        analyses, graph, _ = self._lineage()
        kind = "dataset" if self.args.target in {i.name for i in self.compiled.models} else "column"
        return graph.build(self.compiled, analyses).impact(Node(kind, self.args.target))

    def diff(self) -> tuple[Any, bool]:
        a = self.args
        if not a.model:
            from millrace.plans.promotion import branch_diff

            found = branch_diff(self.project, a.to or a.environment, a.source, a.deep)
            return found, all(d.passed is not False for d in found.datasets)
        strategy, report, verdict = self.project.diff(a.model, a.source, a.to or a.environment, a.base_commit, [c for c in (a.partition or "").split(",") if c], a.sample, a.full)
        rows = [r.asDict() for r in report.orderBy(*report.columns).collect()]
        return {"strategy": strategy, "report": rows, "policy": verdict}, verdict is None or verdict.passed

    def ref(self) -> Any:
        a, store = self.args, self.project.store
        if a.action == "list":
            return store.branches()
        if a.action == "show":
            head = store.head(a.name)
            return {"name": a.name, "commit": head.id, "parent": head.parent, "tables": {k: v.id for k, v in head.tables.items()}}
        if a.action == "create":
            return {"name": a.name, "commit": store.create_branch(a.name, a.source).id}
        store.delete_branch(a.name)
        return {"deleted": a.name}

    def promote(self) -> tuple[Any, bool]:
        from millrace.plans.promotion import evaluate_gates, promote

        a = self.args
        if a.check:
            gates = evaluate_gates(self.project, a.candidate, a.to, a.require_diff, a.allow_breaking_schema)
            return gates, all(g.passed for g in gates)
        return {"commit": promote(self.project, a.candidate, a.to, a.require_diff, a.allow_breaking_schema, a.cleanup).id}, True

    def rollback(self) -> Any:
        from millrace.plans.promotion import rollback

        return {"commit": rollback(self.project, self.args.to).id}

    def state(self) -> Any:
        a, state = self.args, self.project.state
        if a.action == "runs":
            return state.runs()
        if a.action == "show":
            return {"run": state.run(a.name), "models": state.model_runs(a.name), "tests": state.test_runs(a.name)}
        if a.action == "model":
            return [r for r in state.records() if r.model == a.name]
        return state.promotions() if a.action == "promotions" else state.evidences()

    def manifest(self) -> Any:
        c = self.compiled
        return {"schema_version": 1, "models": {i.name: {"target": m.target.name, "version": m.version, "depends": [d.name for d in m.depends], "materialization": m.materialization} for i, m in c.models.items()}, "tests": sorted(c.tests), "seeds": sorted(s.name for s in c.seeds.values())}

    def init(self) -> Any:
        root = self.args.root
        os.makedirs(os.path.join(root, "workflows", "main", "transforms"), exist_ok=True)
        made = []
        for name, content in ((CONFIG, '[transform]\ndefault_schema = "analytics"\n'), ("workflows/main/transforms/example.sql", "-- @view\nSELECT 1 AS id\n")):
            path = os.path.join(root, name)
            if not os.path.exists(path):
                with open(path, "w") as f:
                    f.write(content)
                made.append(name)
        return {"created": made}

    def doctor(self) -> tuple[Any, bool]:
        found = {"config": os.path.exists(os.path.join(self.args.root, CONFIG)), "compiles": self.compiled.ok, "spark": self.spark.version, "branches": len(self.project.store.branches())}
        return found, bool(found["compiles"])


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--root", default=".")
    shared.add_argument("--warehouse")
    shared.add_argument("--sources", help="folder of parquet files named like the source tables")
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--environment", "--ref", default="main")
    shared.add_argument("--from", dest="source", default="main")
    shared.add_argument("--since")
    shared.add_argument("--exclude", action="append", default=[])
    shared.add_argument("--tag", action="append", default=[])
    shared.add_argument("--workflow", action="append", default=[])
    shared.add_argument("--upstream", action="store_true")
    shared.add_argument("--downstream", action="store_true")
    shared.add_argument("--force", action="store_true")
    shared.add_argument("--jobs", type=int, default=4)
    shared.add_argument("--retries", type=int, default=0)
    shared.add_argument("--fail-fast", action="store_true")
    shared.add_argument("--model-timeout", type=float)
    shared.add_argument("--resume")
    shared.add_argument("--retry-failed")
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, parents=[shared])
    for name in ("check", "graph", "manifest", "init", "doctor"):
        add(name).set_defaults(terms=[])
    for name in ("list", "plan", "apply", "run", "test"):
        add(name).add_argument("terms", nargs="*", default=[])
    for name in ("inspect", "explain"):
        add(name).add_argument("model")
    p = add("lineage")
    p.add_argument("target", nargs="?")
    p.add_argument("--diff", nargs="+", metavar="GRAPH", help="an exported graph, and another (else the present one)")
    p.add_argument("--format", choices=("graph", "openlineage"), default="graph")
    add("impact").add_argument("target")
    p = add("diff")
    p.add_argument("model", nargs="?")
    p.add_argument("--to")
    p.add_argument("--base-commit")
    p.add_argument("--partition")
    p.add_argument("--sample", type=float)
    p.add_argument("--full", action="store_true")
    p.add_argument("--deep", action="store_true")
    p = add("ref")
    p.add_argument("action", choices=("list", "show", "create", "delete"))
    p.add_argument("name", nargs="?", default="main")
    p = add("promote")
    p.add_argument("candidate")
    p.add_argument("--to", default="main")
    for flag in ("--check", "--require-diff", "--allow-breaking-schema", "--cleanup"):
        p.add_argument(flag, action="store_true")
    add("rollback").add_argument("--to", required=True)
    p = add("translate")
    p.add_argument("project")
    p.add_argument("--out")
    p.add_argument("--check", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = add("daemon")
    p.add_argument("--port", type=int, default=8390)
    p.add_argument("--token")
    p = add("state")
    p.add_argument("action", choices=("runs", "show", "model", "promotions", "evidence"))
    p.add_argument("name", nargs="?", default="")
    return top


def main(argv: list[str] | None = None, spark: Any = None, out: Any = None) -> int:
    """Runs one command; 0 if all is well, 1 if a check, run, test or gate failed, 2 on misuse."""
    args = parser().parse_args(argv)
    out = out or sys.stdout
    try:
        found = getattr(App(args, spark), args.command)()
    except (SelectionError, GitError, RuntimeError, ValueError) as e:
        print(json.dumps({"error": str(e)}) if args.json else f"error: {e}", file=out)
        return 2
    value, good = found if isinstance(found, tuple) and len(found) == 2 and isinstance(found[1], bool) else (found, True)
    if args.command in ARTIFACTS:
        write_artifact(os.path.join(args.root, STATE_DIR), ARTIFACTS[args.command], plain(value))
    print(json.dumps(plain(value), indent=None if args.json else 2, default=str), file=out)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
