"""Runs plans: seeds, models in dependency order and in parallel, tests."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.operators import diff, materialize, quality
from millrace.sources.seeds import read_seed
from millrace.sources.store import Store, Version
from millrace.sources.tables import model_session

from . import contracts
from .compiler import Compiled, CompiledModel
from .engine import query
from .identity import ModelId, Relation
from .planner import CACHED, INLINE, SKIP, Action, Plan, staleness
from .relations import references, rewrite
from .sqltext import tokenize
from .state import Record, State

PASSED, FAILED, BLOCKED, CANCELLED, SKIPPED = "passed", "failed", "blocked", "cancelled", "skipped"
REUSED = "cached"


class RunError(RuntimeError):
    pass


def failure_kind(e: BaseException) -> str:
    """A coarse class of failure: only ``transient`` ones are worth another try."""
    if isinstance(e, ParseException):
        return "syntax"
    if isinstance(e, AnalysisException):
        return "analysis"
    if isinstance(e, materialize.DuplicateKeys):
        return "data"
    if isinstance(e, TimeoutError):
        return "timeout"
    if isinstance(e, PySparkException):
        kind = e.getCondition() or ""
        return "data" if any(k in kind for k in ("DIVIDE_BY_ZERO", "CAST_INVALID", "OVERFLOW", "INVALID_ARRAY_INDEX", "FAILED_READ")) else "execution"
    if any(w in str(e) for w in ("ExecutorLost", "FetchFailed", "Connection refused", "Connection reset", "timed out")):
        return "transient"
    return "internal"


@dataclass
class Outcome:
    status: str
    version: Version | None = None
    rows: int | None = None
    message: str = ""
    attempts: int = 1
    kind: str = ""


@dataclass
class RunResult:
    run: str
    status: str
    models: dict[ModelId, Outcome]
    tests: dict[str, quality.TestOutcome]
    seeds: dict[str, str] = field(default_factory=dict)


class Binder:
    """Gives relations of a run their DataFrames as uniquely named temporary views of one session."""

    def __init__(self, spark: SparkSession, store: Store, sources: Callable[[Relation], DataFrame | None]) -> None:
        self.session = model_session(spark)
        self.store, self.sources = store, sources
        self.views: dict[str, str] = {}
        self._lock = threading.RLock()

    def bind(self, relation: Relation, versions: dict[str, Version]) -> str:
        """The view that stands for a relation: bound once per table version; a stored view anew, as what it reads may move."""
        with self._lock:
            version = versions.get(relation.key)
            key = f"{relation.name}@{version.id if version else 'source'}"
            if version is not None and version.kind == "view":
                key += f"@{len(self.views)}"
            if key not in self.views:
                name = f"r{len(self.views)}_" + "".join(c if c.isalnum() else "_" for c in relation.name)
                if version is None:
                    df = self.sources(relation)
                    if df is None:
                        raise RunError(f"source {relation.name} not found")
                elif version.kind == "view":
                    df = self.query(version.sql, versions)
                else:
                    df = self.store.read(version)
                if df.sparkSession is not self.session:
                    df = self._adopt(df)
                df.createOrReplaceTempView(name)
                self.views[key] = name
            return self.views[key]

    def _adopt(self, df: DataFrame) -> DataFrame:
        """The same plan in the binder's session."""
        jvm = self.session._jvm
        plan = df._jdf.queryExecution().logical()
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, plan), self.session)

    def query(self, sql: str, versions: dict[str, Version]) -> DataFrame:
        """A physical query with each relation bound to a version, or to a source."""
        tokens = tokenize(sql)
        refs = references(tokens)
        bound = rewrite(tokens, refs, lambda r: "`" + self.bind(Relation.parse(r.parts), versions) + "`")
        return query(self.session, bound)


class Runner:
    """Carries out plans on one branch of a store."""

    def __init__(self, spark: SparkSession, compiled: Compiled, store: Store, state: State, sources: Callable[[Relation], DataFrame | None], environment: str = "main", jobs: int = 4, retries: int = 0, fail_fast: bool = False, timeout: float | None = None) -> None:
        self.spark, self.compiled, self.store, self.state = spark, compiled, store, state
        self.environment, self.jobs, self.retries, self.fail_fast, self.timeout = environment, jobs, retries, fail_fast, timeout
        self.binder = Binder(spark, store, sources)
        self.live: dict[str, Version] = {}
        self._commit = threading.Lock()

    def apply(self, plan: Plan, run: str | None = None, earlier: dict[str, dict] | None = None) -> RunResult:
        """Seeds, then models as their dependencies finish, then tests.

        A failure blocks what depends on it and nothing else; with
        ``fail_fast`` no new model starts after one.
        """
        if why := staleness(plan, self.store, self.compiled):
            raise RunError(why)
        started = time.time()
        self.live = dict(self.store.head(self.environment).tables)
        run = self.state.start_run(self.environment, plan.head, run)
        outcomes: dict[ModelId, Outcome] = {}
        seeds = {s: self._seed(run, s) for s in plan.seeds}
        self._models(plan, run, started, outcomes, seeds, earlier or {})
        tests = self._tests(plan, run, outcomes, seeds)
        bad = any(o.status in (FAILED, BLOCKED, CANCELLED) for o in outcomes.values()) or any(s == FAILED for s in seeds.values()) or any(t.status != "passed" for t in tests.values())
        status = FAILED if bad else PASSED
        self.state.finish_run(run, status, self.store.head(self.environment).id, {"models": {str(m): o.status for m, o in outcomes.items()}, "tests": {t: o.status for t, o in tests.items()}})
        return RunResult(run, status, outcomes, tests, seeds)

    # -- seeds

    def _seed(self, run: str, name: str) -> str:
        seed = self.compiled.workspace.seeds[name]
        try:
            live = self.live.get(seed.relation.key)
            if live is not None and self.state.seed_load(name, self.environment) == (seed.digest, live.id):
                self.state.seed_run(run, name, SKIPPED)
                return SKIPPED
            path = "file://" + os.path.abspath(os.path.join(self.compiled.workspace.root, seed.file))
            version = self.store.write(seed.relation.key, read_seed(self.spark, path))
            self._record(seed.relation.key, version)
            self.state.set_seed_load(name, self.environment, seed.digest, version.id)
            self.state.seed_run(run, name, PASSED)
            return PASSED
        except Exception as e:  # a failed seed blocks its readers only
            self.state.seed_run(run, name, FAILED, str(e)[:500])
            return FAILED

    def _record(self, key: str, version: Version) -> None:
        with self._commit:
            self.store.record(self.environment, {key: version}, f"build {key}")
            self.live[key] = version

    # -- models

    def _models(self, plan: Plan, run: str, started: float, outcomes: dict, seeds: dict, earlier: dict[str, dict]) -> None:
        graph = self.compiled.graph
        members = list(plan.actions)
        waiting = {m: {d for d in graph.needs[m] if d in plan.actions} for m in members}
        failed = False
        with ThreadPoolExecutor(max_workers=self.jobs) as pool:
            running: dict[Future, ModelId] = {}
            pending = list(members)
            while pending or running:
                for m in list(pending):
                    if waiting[m] - outcomes.keys():
                        continue
                    pending.remove(m)
                    bad = [d for d in waiting[m] if outcomes[d].status in (FAILED, BLOCKED, CANCELLED)]
                    no_seed = [s for x in self.compiled.models[m].sources if (s := self.compiled.seeds.get(x)) and seeds.get(s.name) == FAILED]
                    if bad or no_seed:
                        outcomes[m] = Outcome(BLOCKED, message=f"waits for {', '.join(map(str, bad)) or 'a failed seed'}")
                    elif failed and self.fail_fast:
                        outcomes[m] = Outcome(CANCELLED, message="stopped after a failure")
                    else:
                        running[pool.submit(self._model, plan.actions[m], run, started, earlier.get(m.name))] = m
                        continue
                    self.state.model_run(run, m.name, outcomes[m].status, message=outcomes[m].message)
                if not running:
                    continue
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in done:
                    m = running.pop(f)
                    outcomes[m] = f.result()
                    failed = failed or outcomes[m].status == FAILED

    def _model(self, action: Action, run: str, started: float, earlier: dict | None) -> Outcome:
        m = self.compiled.models[action.model]
        began = time.time()
        if action.kind in (INLINE, SKIP):
            out = Outcome(SKIPPED)
        elif earlier and earlier["status"] == PASSED and earlier["version"] == action.version and m.target.key in self.live:
            out = Outcome(REUSED, self.live[m.target.key])
        elif action.kind == CACHED and (version := self._cached(action, m)) is not None:
            out = Outcome(REUSED, version)
            self._record(m.target.key, version)
            self._save(m, action, version, run)
        else:
            out = self._try(m, action, run, started)
        self.state.model_run(run, m.id.name, out.status, action.version, began, out.attempts, out.message)
        return out

    def _cached(self, action: Action, m: CompiledModel) -> Version | None:
        """The other environment's version, if it is still what was planned."""
        environment, identity = action.reuse
        version = self.store.head(environment).tables.get(m.target.key)
        return version if version is not None and version.id == identity else None

    def _try(self, m: CompiledModel, action: Action, run: str, started: float) -> Outcome:
        pause = 0.2
        for attempt in range(1, self.retries + 2):
            tag = f"{run}:{m.id.name}".replace(",", "_")
            self.spark.sparkContext.addJobTag(tag)
            late, done = threading.Event(), threading.Event()

            def watch() -> None:
                """Once the time is up, whatever jobs the model still starts are cancelled."""
                if done.wait(self.timeout):
                    return
                late.set()
                while not done.wait(0.25):
                    self.spark.sparkContext.cancelJobsWithTag(tag)  # a session knows only its own thread's tags

            try:
                if self.timeout:
                    threading.Thread(target=watch, daemon=True).start()
                version = self._build(m, action)
                self._record(m.target.key, version)
                self._save(m, action, version, run)
                return Outcome(PASSED, version, attempts=attempt)
            except Exception as e:  # reported as the model's outcome
                kind = "timeout" if late.is_set() else failure_kind(e)
                if kind != "transient" or attempt > self.retries:
                    return Outcome(FAILED, message=(f"stopped after {self.timeout:g} s: " if late.is_set() else "") + str(e).split("\n")[0][:800], attempts=attempt, kind=kind)
                time.sleep(pause)
                pause = min(5.0, pause * 2)
            finally:
                done.set()
                self.spark.sparkContext.removeJobTag(tag)
        raise AssertionError("unreachable")

    def _build(self, m: CompiledModel, action: Action) -> Version:
        name = m.target.key
        rows = self.binder.query(m.sql, self.live)
        for d in contracts.validate(m, rows.schema):
            if d.severity == "error":
                raise RunError(str(d))
        if m.materialization == "view":
            return self.store.view(m.sql, rows.schema)
        inc = m.model.incremental if m.materialization == "incremental" else None
        partitions = inc.columns if inc and inc.strategy == "partition" else ()
        before = None
        old = self.live.get(name)
        full = inc is None or old is None or old.kind != "table" or action.full_rebuild
        if not full:
            changes = diff.schema_changes(StructType.fromJson(json.loads(old.schema)), rows.schema, m.model.contract.renames)
            verdict = diff.safety([c for c in changes if c.kind != "nullability_changed"])
            if verdict == diff.ERROR:
                raise RunError("incompatible schema change: " + "; ".join(f"{c.kind} {c.column} {c.detail}" for c in changes))
            full = bool([c for c in changes if c.kind != "nullability_changed"])
        if full:
            version = self.store.write(name, rows, partitions)
        elif inc.strategy == "append":
            version = self.store.appended(name, old, rows)
        elif inc.strategy == "key":
            version = self.store.merged(name, old, rows, inc.columns)
        elif inc.strategy == "partition":
            version = self.store.with_partitions(name, old, rows)
        else:
            high = _revive(old.watermark or self.state.watermark(m.id.name, self.environment))
            fresh = materialize.window_rows(rows, inc.columns[0], high, materialize.overlap_seconds(inc.overlap))
            if high is None:
                version = self.store.write(name, rows)
            elif m.model.key:  # with a key, overlapping rows replace themselves
                version = self.store.merged(name, old, fresh, m.model.key)
            else:
                version = self.store.appended(name, old, fresh)
            before = high
        if inc and inc.strategy == "window":
            # The mark is part of the version: it counts when the rows do.  Only new folders are read for it.
            known = {f for f in old.folders} if before is not None else set()
            new = self.store.read(replace(version, folders=tuple(f for f in version.folders if f not in known)))
            marks = [x for x in (before, materialize.watermark(new, inc.columns[0])) if x is not None]
            version = replace(version, watermark=_plain(max(marks)) if marks else None)
        return version

    def _save(self, m: CompiledModel, action: Action, version: Version, run: str) -> None:
        inc = m.model.incremental if m.materialization == "incremental" else None
        if version.watermark is not None:
            self.state.set_watermark(m.id.name, self.environment, version.watermark, time.time())
        self.state.record(Record(m.id.name, self.environment, action.version, m.components, m.target.key, inc.strategy if inc else m.materialization, inc.columns if inc else (), version.id, contracts.recorded(m), run=run))

    # -- tests

    def _tests(self, plan: Plan, run: str, outcomes: dict[ModelId, Outcome], seeds: dict[str, str]) -> dict[str, quality.TestOutcome]:
        out = {}
        for name in plan.tests:
            t = self.compiled.tests[name]
            bad = [d for d in t.targets if d in outcomes and outcomes[d].status in (FAILED, BLOCKED, CANCELLED)]
            bad += [s.name for x in t.sources if (s := self.compiled.seeds.get(x)) and seeds.get(s.name) == FAILED]
            out[name] = quality.TestOutcome(name, "blocked", 0, f"waits for {', '.join(map(str, bad))}") if bad else self.test(name)
            self.state.test_run(run, name, out[name].status, out[name].violations, out[name].message)
        return out

    def test(self, name: str) -> quality.TestOutcome:
        """One test against the branch's present tables."""
        if not self.live:
            self.live = dict(self.store.head(self.environment).tables)
        try:
            violations = self.query(self.compiled.tests[name].sql)
        except Exception as e:
            return quality.TestOutcome(name, "error", 0, str(e).split("\n")[0][:500])
        return quality.run_test(name, violations)

    def query(self, sql: str) -> DataFrame:
        """A physical query over the branch's present tables."""
        return self.binder.query(sql, self.live)

    def table(self, model: ModelId) -> DataFrame:
        """A model's present rows; views are evaluated, ephemeral models inlined."""
        if not self.live:
            self.live = dict(self.store.head(self.environment).tables)
        m = self.compiled.models[model]
        version = self.live.get(m.target.key)
        return self.query(m.sql) if version is None or version.kind == "view" else self.store.read(version)


def _plain(value: Any) -> Any:
    """A watermark as JSON keeps it, with its type."""
    if isinstance(value, dt.datetime):
        return {"timestamp": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    return {"value": value}


def _revive(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    if "timestamp" in value:
        return dt.datetime.fromisoformat(value["timestamp"])
    if "date" in value:
        return dt.date.fromisoformat(value["date"])
    return value.get("value")
