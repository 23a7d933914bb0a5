"""The state store: what was built, when, as which version and with what result."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

_TABLES = """
CREATE TABLE IF NOT EXISTS runs (id TEXT PRIMARY KEY, environment TEXT, status TEXT, started REAL, finished REAL, head TEXT, detail TEXT);
CREATE TABLE IF NOT EXISTS model_runs (run TEXT, model TEXT, status TEXT, version TEXT, started REAL, finished REAL, attempts INTEGER, message TEXT, PRIMARY KEY (run, model));
CREATE TABLE IF NOT EXISTS seed_runs (run TEXT, seed TEXT, status TEXT, message TEXT, PRIMARY KEY (run, seed));
CREATE TABLE IF NOT EXISTS test_runs (run TEXT, test TEXT, status TEXT, violations INTEGER, message TEXT, PRIMARY KEY (run, test));
CREATE TABLE IF NOT EXISTS model_versions (model TEXT, environment TEXT, version TEXT, components TEXT, target TEXT, strategy TEXT, key TEXT, adapter TEXT, output_identity TEXT, contract TEXT, built REAL, run TEXT, PRIMARY KEY (model, environment));
CREATE TABLE IF NOT EXISTS incremental_state (model TEXT, environment TEXT, watermark TEXT, run_started REAL, PRIMARY KEY (model, environment));
CREATE TABLE IF NOT EXISTS seed_loads (seed TEXT, environment TEXT, digest TEXT, output_identity TEXT, PRIMARY KEY (seed, environment));
CREATE TABLE IF NOT EXISTS promotions (id TEXT PRIMARY KEY, source TEXT, target TEXT, commit_id TEXT, at REAL, detail TEXT);
CREATE TABLE IF NOT EXISTS evidence (id TEXT PRIMARY KEY, kind TEXT, subject TEXT, at REAL, detail TEXT);
"""


@dataclass
class Record:
    """A model as it was last built in an environment."""

    model: str
    environment: str
    version: str
    components: dict[str, str]
    target: str
    strategy: str
    key: tuple[str, ...]
    output_identity: str
    contract: dict[str, Any] = field(default_factory=dict)
    adapter: str = "spark"
    built: float = 0.0
    run: str = ""


class State:
    def __init__(self, path: str = ":memory:") -> None:
        self._lock = threading.Lock()
        #: Whether records outlive this object.
        self.lasting = path != ":memory:"
        self._db = sqlite3.connect(path, check_same_thread=False)
        self._db.row_factory = sqlite3.Row
        self._db.executescript(_TABLES)

    def _do(self, sql: str, *values: Any) -> list[sqlite3.Row]:
        with self._lock, self._db:
            return self._db.execute(sql, values).fetchall()

    # -- runs

    def start_run(self, environment: str, head: str = "", run: str | None = None) -> str:
        run = run or uuid.uuid4().hex
        self._do("INSERT INTO runs VALUES (?,?,?,?,NULL,?,'') ON CONFLICT (id) DO UPDATE SET status = 'running', finished = NULL", run, environment, "running", time.time(), head)
        return run

    def finish_run(self, run: str, status: str, head: str = "", detail: dict | None = None) -> None:
        self._do("UPDATE runs SET status = ?, finished = ?, head = ?, detail = ? WHERE id = ?", status, time.time(), head, json.dumps(detail or {}), run)

    def run(self, run: str) -> dict | None:
        rows = self._do("SELECT * FROM runs WHERE id = ?", run)
        return dict(rows[0]) if rows else None

    def runs(self, environment: str | None = None) -> list[dict]:
        where = "WHERE environment = ?" if environment else ""
        return [dict(r) for r in self._do(f"SELECT * FROM runs {where} ORDER BY started DESC, id", *([environment] if environment else []))]

    def model_run(self, run: str, model: str, status: str, version: str = "", started: float | None = None, attempts: int = 1, message: str = "") -> None:
        self._do("INSERT OR REPLACE INTO model_runs VALUES (?,?,?,?,?,?,?,?)", run, model, status, version, started or time.time(), time.time(), attempts, message)

    def model_runs(self, run: str) -> dict[str, dict]:
        return {r["model"]: dict(r) for r in self._do("SELECT * FROM model_runs WHERE run = ?", run)}

    def test_run(self, run: str, test: str, status: str, violations: int = 0, message: str = "") -> None:
        self._do("INSERT OR REPLACE INTO test_runs VALUES (?,?,?,?,?)", run, test, status, violations, message)

    def test_runs(self, run: str) -> dict[str, dict]:
        return {r["test"]: dict(r) for r in self._do("SELECT * FROM test_runs WHERE run = ?", run)}

    def seed_run(self, run: str, seed: str, status: str, message: str = "") -> None:
        self._do("INSERT OR REPLACE INTO seed_runs VALUES (?,?,?,?)", run, seed, status, message)

    def seed_runs(self, run: str) -> dict[str, dict]:
        return {r["seed"]: dict(r) for r in self._do("SELECT * FROM seed_runs WHERE run = ?", run)}

    # -- versions: an older build never overwrites a newer one

    def record(self, r: Record) -> None:
        r.built = r.built or time.time()
        self._do(
            "INSERT INTO model_versions VALUES (?,?,?,?,?,?,?,?,?,?,?,?) ON CONFLICT (model, environment) DO UPDATE SET version = excluded.version, components = excluded.components, target = excluded.target, "
            "strategy = excluded.strategy, key = excluded.key, adapter = excluded.adapter, output_identity = excluded.output_identity, contract = excluded.contract, built = excluded.built, run = excluded.run WHERE excluded.built >= built",
            r.model, r.environment, r.version, json.dumps(r.components), r.target, r.strategy, json.dumps(r.key), r.adapter, r.output_identity, json.dumps(r.contract), r.built, r.run,
        )

    @staticmethod
    def _record(row: sqlite3.Row) -> Record:
        return Record(row["model"], row["environment"], row["version"], json.loads(row["components"]), row["target"], row["strategy"], tuple(json.loads(row["key"])), row["output_identity"], json.loads(row["contract"]), row["adapter"], row["built"], row["run"])

    def records(self, environment: str | None = None) -> list[Record]:
        where = "WHERE environment = ?" if environment else ""
        return [self._record(r) for r in self._do(f"SELECT * FROM model_versions {where}", *([environment] if environment else []))]

    def watermark(self, model: str, environment: str) -> Any:
        rows = self._do("SELECT watermark FROM incremental_state WHERE model = ? AND environment = ?", model, environment)
        return json.loads(rows[0]["watermark"]) if rows else None

    def set_watermark(self, model: str, environment: str, value: Any, run_started: float) -> None:
        """Ordered by the start of the run that read the value."""
        self._do(
            "INSERT INTO incremental_state VALUES (?,?,?,?) ON CONFLICT (model, environment) DO UPDATE SET watermark = excluded.watermark, run_started = excluded.run_started WHERE excluded.run_started >= run_started",
            model, environment, json.dumps(value), run_started,
        )

    def seed_load(self, seed: str, environment: str) -> tuple[str, str] | None:
        rows = self._do("SELECT * FROM seed_loads WHERE seed = ? AND environment = ?", seed, environment)
        return (rows[0]["digest"], rows[0]["output_identity"]) if rows else None

    def set_seed_load(self, seed: str, environment: str, digest: str, identity: str) -> None:
        self._do("INSERT OR REPLACE INTO seed_loads VALUES (?,?,?,?)", seed, environment, digest, identity)

    # -- promotions and evidence

    def promotion(self, source: str, target: str, commit: str, detail: dict) -> str:
        key = uuid.uuid4().hex
        self._do("INSERT INTO promotions VALUES (?,?,?,?,?,?)", key, source, target, commit, time.time(), json.dumps(detail))
        return key

    def promotions(self) -> list[dict]:
        return [dict(r) | {"detail": json.loads(r["detail"])} for r in self._do("SELECT * FROM promotions ORDER BY at DESC")]

    def evidence(self, kind: str, subject: str, detail: dict) -> str:
        key = uuid.uuid4().hex
        self._do("INSERT INTO evidence VALUES (?,?,?,?,?)", key, kind, subject, time.time(), json.dumps(detail))
        return key

    def evidences(self, kind: str | None = None, subject: str | None = None) -> list[dict]:
        rows = self._do("SELECT * FROM evidence WHERE (?1 IS NULL OR kind = ?1) AND (?2 IS NULL OR subject = ?2) ORDER BY at DESC", kind, subject)
        return [dict(r) | {"detail": json.loads(r["detail"])} for r in rows]
