"""The library's front door: load a workspace, plan it, run it, compare it."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.operators import diff, quality
from millrace.sources.store import MAIN, Store

from .analysis import Analyzer, type_diagnostics
from .compiler import Compiled, SourceStates, compile_workspace
from .diagnostics import Diagnostic
from .identity import ModelId, Relation
from .planner import Plan, Planner
from .runner import FAILED, BLOCKED, CANCELLED, Runner, RunError, RunResult
from .selection import select
from .state import State
from .workspace import Workspace


def catalog_sources(spark: SparkSession) -> Callable[[Relation], DataFrame | None]:
    """Sources from the session's catalog and temporary views."""

    def find(relation: Relation) -> DataFrame | None:
        return spark.table(relation.quoted()) if spark.catalog.tableExists(relation.name) else None

    def state(relation: Relation) -> str | None:
        table = find(relation)
        return _files_state(spark, table.inputFiles()) if table is not None else None

    find.states = state
    return find


def folder_sources(spark: SparkSession, folder: str) -> Callable[[Relation], DataFrame | None]:
    """Sources that are parquet files named like the relation's table, in one folder."""

    def find(relation: Relation) -> DataFrame | None:
        return spark.read.parquet(f"{folder}/{relation.table}.parquet")

    find.states = folder_states(spark, folder)
    return find


def _files_state(spark: SparkSession, files: Iterable[str]) -> str | None:
    """A digest of the names, sizes and times of files; None for a table without any (a view of no files)."""
    path, conf, lines = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf(), []
    for f in files:
        status = path(f).getFileSystem(conf).getFileStatus(path(f))
        lines.append(f"{status.getPath().getName()}|{status.getLen()}|{status.getModificationTime()}")
    return "files:" + hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest() if lines else None


def folder_states(spark: SparkSession, folder: str) -> Callable[[Relation], str | None]:
    """A digest of names, sizes and times of the files behind each of ``folder_sources``, from the file system alone."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path

    def state(relation: Relation) -> str | None:
        at = path(f"{folder}/{relation.table}.parquet")
        fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return None
        files = [at] if fs.getFileStatus(at).isFile() else [s.getPath() for s in fs.listStatus(at)]
        lines = sorted(f"{f.getName()}|{s.getLen()}|{s.getModificationTime()}" for f in files for s in [fs.getFileStatus(f)])
        return "files:" + hashlib.sha256("\n".join(lines).encode()).hexdigest()

    return state


class Project:
    """A workspace with its store, state and sources.

    Without ``source_states`` the sources' own are taken (``folder_sources`` and
    ``catalog_sources`` have them: their files' names, sizes and times), so that
    models are built again when their sources' files change.
    """

    def __init__(self, spark: SparkSession, root: str | os.PathLike, warehouse: str, sources: Callable[[Relation], DataFrame | None] | None = None, state: State | None = None, source_states: SourceStates = None) -> None:
        self.spark, self.root = spark, str(root)
        self.store = Store(spark, warehouse)
        self.state = state or State()
        self.sources = sources or catalog_sources(spark)
        self.source_states = source_states or getattr(self.sources, "states", None)
        self._compiled: Compiled | None = None
        self._analyzer: Analyzer | None = None

    @property
    def compiled(self) -> Compiled:
        if self._compiled is None:
            self._compiled = compile_workspace(Workspace.load(self.root), self.source_states)
        return self._compiled

    def reload(self) -> Compiled:
        self._compiled = self._analyzer = None
        return self.compiled

    def analyse(self, models: Iterable[ModelId] | None = None) -> Analyzer:
        """Types of the models (None: all) and what they need, kept until the next reload.

        What a branch holds in the version still wanted has its types on record.
        """
        if self._analyzer is None:
            known: dict[str, StructType | None] = {}

            def schema(relation: Relation) -> StructType | None:
                if relation.key not in known:
                    try:
                        df = self.sources(relation)
                    except Exception:  # an unknown source has no schema; a run says why
                        df = None
                    known[relation.key] = df.schema if df is not None else None
                return known[relation.key]

            self._analyzer = Analyzer(self.spark, self.compiled, schema, lineage=False, known=self._built())
        self._analyzer.run(models)
        return self._analyzer

    def _built(self) -> dict[ModelId, StructType]:
        heads: dict[str, dict] = {}
        out = {}
        wanted = {i.name: i for i in self.compiled.models}
        for r in self.state.records():
            i = wanted.get(r.model)
            if i is None or i in out or self.compiled.models[i].version != r.version:
                continue
            if r.environment not in heads:
                heads[r.environment] = self.store.head(r.environment).tables if self.store.has_branch(r.environment) else {}
            live = heads[r.environment].get(r.target)
            if live is not None and live.id == r.output_identity and live.schema:
                out[i] = StructType.fromJson(json.loads(live.schema))
        return out

    def check(self) -> list[Diagnostic]:
        """All diagnostics: the compilation's, and if it has no errors those of types and contracts."""
        found = list(self.compiled.diagnostics)
        return found if any(d.severity == "error" for d in found) else found + type_diagnostics(self.analyse())

    def ensure(self, environment: str, source: str = MAIN) -> bool:
        """Creates the environment's branch if there is none; True if it did."""
        if self.store.has_branch(environment):
            return False
        self.store.create_branch(environment, source)
        return True

    def select(self, include: Iterable[str] = (), **options) -> list[ModelId]:
        return select(self.compiled, include, **options)

    def plan(self, include: Iterable[str] = (), exclude: Iterable[str] = (), environment: str = MAIN, force: bool = False, changed: Callable[[], set[ModelId]] | None = None) -> Plan:
        """A plan of the selected models; errors of theirs, types included, end it before anything is built."""
        self._check()
        include = list(include)
        chosen = select(self.compiled, include, exclude, changed=changed)
        banned = select(self.compiled, exclude, changed=changed) if exclude else ()
        named = select(self.compiled, [t.strip("+") for t in include], changed=changed) if include else chosen
        return self.plan_of(chosen, banned, environment, force, expanded=set(chosen) - set(named), changed=changed() if changed else ())

    def plan_of(self, chosen: Iterable[ModelId], banned: Iterable[ModelId] = (), environment: str = MAIN, force: bool = False, **why) -> Plan:
        """A plan of given models, with their types checked."""
        chosen = list(chosen)
        analyzer = self.analyse(chosen)
        wanted = {str(i) for i in self.compiled.graph.upstream(chosen)}
        self._refuse([d for d in type_diagnostics(analyzer) if d.where in wanted])
        schemas = {i: a.schema for i, a in analyzer.results.items() if a.schema is not None}
        return Planner(self.compiled, self.store, self.state, environment, schemas).plan(chosen, force, excluded=banned, **why)

    def runner(self, environment: str = MAIN, **options) -> Runner:
        return Runner(self.spark, self.compiled, self.store, self.state, self.sources, environment, **options)

    def apply(self, plan: Plan, **options) -> RunResult:
        return self.runner(plan.environment, **options).apply(plan)

    def run(self, include: Iterable[str] = (), exclude: Iterable[str] = (), environment: str = MAIN, force: bool = False, **options) -> RunResult:
        return self.apply(self.plan(include, exclude, environment, force), **options)

    def resume(self, run: str, **options) -> RunResult:
        """Goes on with a run that didn't finish: what passed at the version still wanted is kept."""
        old = self.state.run(run)
        if old is None or old["status"] not in ("running", "cancelled", "failed"):
            raise RunError(f"run {run} can't be resumed")
        done = self.state.model_runs(run)
        plan = self.plan([m for m in done if m in {i.name for i in self.compiled.models}], environment=old["environment"]).because("resumed_run")
        return self.runner(old["environment"], **options).apply(plan, run, done)

    def retry_failed(self, run: str, **options) -> RunResult:
        """A new run of what failed, was blocked or cancelled, and of the targets of failed tests."""
        old = self.state.run(run)
        if old is None:
            raise RunError(f"no run {run}")
        names = {m for m, r in self.state.model_runs(run).items() if r["status"] in (FAILED, BLOCKED, CANCELLED)}
        for t, r in self.state.test_runs(run).items():
            if r["status"] != "passed" and t in self.compiled.tests:
                names |= {x.name for x in self.compiled.tests[t].targets}
        if not names:
            raise RunError(f"nothing failed in run {run}")
        return self.apply(self.plan(sorted(names), environment=old["environment"]).because("resumed_run"), **options)

    def test(self, include: Iterable[str] = (), environment: str = MAIN) -> dict[str, quality.TestOutcome]:
        """Tests alone; with a selection, those that have targets, all of them selected."""
        runner = self.runner(environment)
        chosen = set(self.select(include)) if include else None
        names = [t.name for t in self.compiled.tests.values() if chosen is None or (t.targets and set(t.targets) <= chosen)]
        return {n: runner.test(n) for n in sorted(names)}

    def diff(self, model: str, base: str = MAIN, candidate: str = MAIN, base_commit: str | None = None, partitions: Iterable[str] = (), sample: float | None = None, full: bool = False) -> tuple[str, DataFrame, diff.Verdict | None]:
        """Compares a model's rows on two branches, or with an older commit of the base.

        Strategy: partitions, else full, else sample, else keyed if there is a
        key, else row counts.  Equal snapshots are refused.
        """
        m = self.compiled.models[select(self.compiled, [model])[0]]
        old_head = self.store.commit(base_commit) if base_commit else self.store.head(base)
        old, new = old_head.tables.get(m.target.key), self.store.head(candidate).tables.get(m.target.key)
        if old is None or new is None or old.kind != "table" or new.kind != "table":
            raise RunError(f"{m.id} has no table on both sides")
        if old.id == new.id:
            raise RunError("both sides are the same snapshot")
        a, b = self.store.read(old), self.store.read(new)
        key = list(m.key)
        if list(partitions):
            return "partition", diff.partition_diff(a, b, partitions), None
        if not key:
            return "aggregate", diff.aggregate_diff(a, b), None
        strategy = "full" if full else "sampled" if sample is not None else "keyed"
        if strategy == "sampled":
            a, b = diff.key_sample(a, key, sample), diff.key_sample(b, key, sample)
        common = [c for c in a.columns if c in b.columns]
        report = diff.keyed_diff(a, b, key, common, m.model.tolerances)
        if m.model.policy is None:
            return strategy, report, None
        return strategy, report, diff.evaluate(m.model.policy, report.first().asDict(), strategy)

    def _check(self) -> None:
        self._refuse(self.compiled.diagnostics)

    @staticmethod
    def _refuse(found: Iterable[Diagnostic]) -> None:
        errors = [d for d in found if d.severity == "error"]
        if errors:
            raise RunError("; ".join(map(str, errors[:5])) + (f"; and {len(errors) - 5} more" if len(errors) > 5 else ""))
