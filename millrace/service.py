"""The HTTP service: the command line's reports as JSON, and builds as background operations."""

from __future__ import annotations

import argparse
import hmac
import json
import threading
import time
import uuid
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from .cli import App, parser, plain

API_VERSION = 1
KINDS = ("run", "resume", "retry_failed", "test", "promote", "reload")


class HttpError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Operation:
    id: str
    kind: str
    request: dict
    status: str = "pending"  # pending, running, succeeded, failed, cancelled
    created: float = field(default_factory=time.time)
    result: Any = None
    error: str = ""


class Service:
    """One workspace, served to many; operations run one at a time, in order."""

    def __init__(self, root: str, spark: Any, sources: str | None = None, warehouse: str | None = None, token: str | None = None) -> None:
        self.options = ["--root", root] + (["--sources", sources] if sources else []) + (["--warehouse", warehouse] if warehouse else [])
        self.spark, self.token = spark, token
        self.app = App(parser().parse_args(["check", *self.options]), spark)
        self.app.project  # opens the store and the state
        self.operations: dict[str, Operation] = {}
        self.keys: dict[str, str] = {}
        self._lock = threading.Lock()
        self._one = threading.Lock()

    # -- reads

    def call(self, *argv: str) -> Any:
        """A command's result, on the shared project."""
        try:
            args = parser().parse_args([*argv, *self.options])
        except SystemExit as e:
            raise HttpError(400, f"bad request: {' '.join(argv)}") from e
        app = App(args, self.spark)
        app._project = self.app.project
        try:
            found = getattr(app, args.command)()
        except (RuntimeError, ValueError, KeyError, IndexError) as e:
            raise HttpError(404 if "selects no model" in str(e) else 400, str(e)) from e
        return found[0] if isinstance(found, tuple) and len(found) == 2 and isinstance(found[1], bool) else found

    def get(self, path: list[str], query: dict[str, str]) -> Any:
        state = self.app.project.state
        match path:
            case ["status"] | ["v1", "status"]:
                return {"status": "ok", "api": API_VERSION, "models": len(self.app.compiled.models), "operations": len(self.operations)}
            case ["v1", "check"]:
                return self.call("check")
            case ["v1", "models"]:
                return self.call("list", *_terms(query))
            case ["v1", "models", model]:
                return self.call("inspect", model)
            case ["v1", "graph"]:
                return self.call("graph")
            case ["v1", "plan"]:
                return self.call("plan", *_terms(query), *(["--environment", query["environment"]] if "environment" in query else []))
            case ["v1", "lineage"]:
                return self.call("lineage", "--format", query.get("format", "graph"))
            case ["v1", "lineage", target]:
                return self.call("lineage", target)
            case ["v1", "impact", target]:
                return self.call("impact", target)
            case ["v1", "impact"]:
                return {m["id"]: self.call("impact", m["id"]) for m in self.call("list", *_terms(query))}
            case ["v1", "diff", "lineage"]:
                if "base" not in query:
                    raise HttpError(400, "base is the path of an exported graph")
                return self.call("lineage", "--diff", query["base"], *([query["candidate"]] if "candidate" in query else []))
            case ["v1", "diff", "branch"]:
                return self.call("diff", "--from", query.get("from", "main"), "--to", query.get("to", "main"), *(["--deep"] if query.get("deep") else []))
            case ["v1", "state", "runs"]:
                return state.runs(query.get("environment"))
            case ["v1", "state", "runs", run]:
                return {"run": state.run(run), "models": state.model_runs(run), "tests": state.test_runs(run)}
            case ["v1", "state", "runs", run, "failed"]:
                return {m: r for m, r in state.model_runs(run).items() if r["status"] in ("failed", "blocked", "cancelled")}
            case ["v1", "state", "models", model]:
                return [r for r in state.records() if r.model == model]
            case ["v1", "state", "promotions"]:
                return state.promotions()
            case ["v1", "operations"]:
                return sorted(self.operations.values(), key=lambda o: o.created)
            case ["v1", "operations", key]:
                return self._operation(key)
        raise HttpError(404, "no such path")

    # -- writes

    def post(self, path: list[str], body: dict, idempotency: str | None) -> tuple[int, Any]:
        match path:
            case ["v1", "operations"]:
                return self.submit(body, idempotency)
            case ["v1", "operations", key, "cancel"]:
                return 200, self.cancel(key)
            case ["v1", "reload"]:
                compiled = self.app.project.reload()
                return 200, {"models": len(compiled.models), "ok": compiled.ok}
        raise HttpError(404, "no such path")

    def submit(self, body: dict, idempotency: str | None) -> tuple[int, Operation]:
        """Starts an operation; the same idempotency key gives the same one, with the same body only."""
        kind = body.get("kind")
        if kind not in KINDS:
            raise HttpError(400, f"kind is one of {', '.join(KINDS)}")
        with self._lock:
            if idempotency and idempotency in self.keys:
                old = self.operations[self.keys[idempotency]]
                if old.request != body:
                    raise HttpError(409, "the idempotency key was used for another request")
                return 200, old
            made = Operation(uuid.uuid4().hex, kind, body)
            self.operations[made.id] = made
            if idempotency:
                self.keys[idempotency] = made.id
        threading.Thread(target=self._work, args=(made,), daemon=True).start()
        return 202, made

    def cancel(self, key: str) -> Operation:
        operation = self._operation(key)
        with self._lock:
            if operation.status == "pending":
                operation.status = "cancelled"
            elif operation.status == "running":
                self.spark.sparkContext.cancelAllJobs()
                operation.status = "cancelled"
        return operation

    def _operation(self, key: str) -> Operation:
        if key not in self.operations:
            raise HttpError(404, f"no operation {key}")
        return self.operations[key]

    def _work(self, o: Operation) -> None:
        with self._one:
            with self._lock:
                if o.status == "cancelled":
                    return
                o.status = "running"
            try:
                result, good = self._do(o)
            except Exception as e:  # reported with the operation
                result, good, o.error = None, False, str(e).split("\n")[0]
            with self._lock:
                o.result = plain(result)
                if o.status != "cancelled":
                    o.status = "succeeded" if good else "failed"

    def _do(self, o: Operation) -> tuple[Any, bool]:
        project, r = self.app.project, o.request
        environment = r.get("environment", "main")
        if o.kind == "reload":
            return {"models": len(project.reload().models)}, project.compiled.ok
        if o.kind == "test":
            found = project.test(r.get("terms", []), environment)
            return found, all(t.status == "passed" for t in found.values())
        if o.kind == "promote":
            from .plans.promotion import promote

            return {"commit": promote(project, r["candidate"], r.get("to", "main"), bool(r.get("require_diff")), bool(r.get("allow_breaking_schema"))).id}, True
        if o.kind == "resume":
            result = project.resume(r["run"])
        elif o.kind == "retry_failed":
            result = project.retry_failed(r["run"])
        else:
            if environment != "main":
                project.ensure(environment)
            result = project.run(r.get("terms", []), r.get("exclude", []), environment, bool(r.get("force")))
        return {"run": result.run, "status": result.status, "models": {m.name: x.status for m, x in result.models.items()}, "tests": {n: t.status for n, t in result.tests.items()}}, result.status == "passed"


def _terms(query: dict[str, str]) -> list[str]:
    return [t for t in query.get("select", "").split(",") if t]


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server; with a token, everything but /status asks for it as a bearer token."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: Any) -> None:
            pass

        def _answer(self, status: int, value: Any) -> None:
            body = json.dumps(plain(value), default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _serve(self, write: bool) -> None:
            url = urlsplit(self.path)
            path = [unquote(p) for p in url.path.split("/") if p]
            try:
                if service.token and path != ["status"] and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {service.token}"):
                    raise HttpError(401, "a bearer token is required")
                if write:
                    raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                    try:
                        body = json.loads(raw or b"{}")
                    except ValueError as e:
                        raise HttpError(400, "the body isn't JSON") from e
                    self._answer(*service.post(path, body, self.headers.get("Idempotency-Key")))
                else:
                    self._answer(200, service.get(path, {k: v[-1] for k, v in parse_qs(url.query).items()}))
            except HttpError as e:
                self._answer(e.status, {"error": str(e)})
            except Exception as e:
                self._answer(500, {"error": str(e).split("\n")[0]})

        def do_GET(self) -> None:
            self._serve(False)

        def do_POST(self) -> None:
            self._serve(True)

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--sources")
    p.add_argument("--warehouse")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8390)
    p.add_argument("--token")
    a = p.parse_args()
    if a.host not in ("127.0.0.1", "localhost", "::1") and not a.token:
        p.error("serving beyond this machine needs --token")
    from pyspark.sql import SparkSession

    server(Service(a.root, SparkSession.builder.appName("millrace").getOrCreate(), a.sources, a.warehouse, a.token), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
