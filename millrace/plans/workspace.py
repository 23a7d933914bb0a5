"""Discovery: a folder of SQL models, seeds, tests and settings becomes a workspace."""

from __future__ import annotations

import fnmatch
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from millrace.operators.diff import Policy, Tolerance
from millrace.sources.seeds import header, seed_hash

from .diagnostics import Diagnostic, error, warning
from .directives import MATERIALIZATIONS, Directives, Incremental, parse_directives
from .identity import ModelId, Relation

CONFIG = "millrace.toml"
ROOT_CONFIG = "transform.toml"
_FOLDER = "transforms"


@dataclass
class Contract:
    """Declared columns: name -> (type or None, nullable or None)."""

    enforced: bool = False
    columns: dict[str, tuple[str | None, bool | None]] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.columns or self.renames or self.enforced)


@dataclass
class Model:
    id: ModelId
    file: str
    sql: str
    directives: Directives
    materialization: str
    schema: str | None
    tags: tuple[str, ...]
    owner: str | None
    incremental: Incremental | None
    contract: Contract
    policy: Policy | None = None
    tolerances: dict[str, Tolerance] = field(default_factory=dict)
    workflow: str | None = None

    @property
    def key(self) -> tuple[str, ...]:
        return self.directives.key


@dataclass
class Seed:
    name: str
    file: str
    relation: Relation
    digest: str
    columns: tuple[str, ...]


@dataclass
class SqlTest:
    name: str
    file: str
    sql: str


@dataclass
class Workspace:
    root: str
    models: dict[ModelId, Model]
    seeds: dict[str, Seed]
    tests: dict[str, SqlTest]
    diagnostics: list[Diagnostic]
    default_schema: str | None = None
    default_catalog: str | None = None
    cross_workflow: str = "allow"

    @staticmethod
    def load(root: str | os.PathLike) -> "Workspace":
        return _Loader(Path(root)).load()


def _toml(path: Path, notes: list[Diagnostic]) -> dict:
    try:
        return tomllib.loads(path.read_text())
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        notes.append(error("CONFIG001", str(e), path.name))
        return {}


class _Loader:
    def __init__(self, root: Path) -> None:
        self.root = root
        self.notes: list[Diagnostic] = []
        self.config = _toml(root / CONFIG, self.notes) if (root / CONFIG).exists() else {}
        self.transform = self.config.get("transform", {})
        self.folder_configs: dict[str, dict] = {}
        self.places: dict[PurePosixPath, tuple] = {}
        self.chains: dict[PurePosixPath, dict] = {}

    def load(self) -> Workspace:
        models: dict[ModelId, Model] = {}
        pinned: dict[ModelId, str] = {}
        for path in self._files("*.sql"):
            if path.parts[0] == "tests" or not self._is_model(path):
                continue
            model = self._model(path)
            if model is None:
                continue
            if model.directives.id is not None:
                if model.id in pinned:
                    self.notes.append(error("PROJECT003", f"id {model.id} is pinned by {pinned[model.id]} too", path))
                pinned.setdefault(model.id, str(path))
            if model.id in models:
                self.notes.append(error("PROJECT002", f"model {model.id} is also defined in {models[model.id].file}", path))
                continue
            models[model.id] = model
        if not models:
            self.notes.append(warning("PROJECT001", "no models found", self.root))
        known = {m.name for m in models} | {m.name.replace(".", "_") for m in models}
        for name in self.config.get("model", {}):
            if name not in known:
                self.notes.append(warning("CONFIG002", f"settings for an unknown model {name}", CONFIG))
        return Workspace(str(self.root), dict(sorted(models.items())), self._seeds(), self._tests(), self.notes, self.transform.get("default_schema"), self.transform.get("default_catalog"), self.config.get("dependencies", {}).get("cross_workflow", "allow"))

    def _files(self, pattern: str) -> list[PurePosixPath]:
        out = []
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if not d.startswith((".", "__")))
            for n in sorted(names):
                if fnmatch.fnmatch(n, pattern):
                    out.append(PurePosixPath(Path(folder, n).relative_to(self.root).as_posix()))
        return out

    def _is_model(self, path: PurePosixPath) -> bool:
        discovery = self.transform.get("discovery", {})
        if any(_glob(path, p) for p in discovery.get("exclude", [])):
            return False
        if discovery.get("include"):
            return any(_glob(path, p) for p in discovery["include"])
        return _FOLDER in path.parts[:-1] or self._configured_root(path) is not None

    def _configured_root(self, path: PurePosixPath) -> PurePosixPath | None:
        return next((p for p in path.parents if self._folder_config(p)), None)

    def _folder_config(self, folder: PurePosixPath) -> dict:
        key = str(folder)
        if key not in self.folder_configs:
            at = self.root / folder / ROOT_CONFIG
            self.folder_configs[key] = _toml(at, self.notes) if at.exists() else {}
        return self.folder_configs[key]

    def _place(self, path: PurePosixPath) -> tuple[str | None, PurePosixPath, PurePosixPath, str | None]:
        """Namespace, root folder, path below the root and workflow of a model file."""
        parts = path.parts
        default = self.transform.get("default_namespace")
        if _FOLDER in parts[:-1]:
            at = len(parts) - 2 - parts[:-1][::-1].index(_FOLDER)
            root = PurePosixPath(*parts[: at + 1])
            below = PurePosixPath(*parts[at + 1 :])
            named = self._folder_config(root).get("namespace")
            if at == 0:  # transforms/<namespace>/...
                if named or default and len(below.parts) == 1:
                    return named or default, root, below, None
                if len(below.parts) > 1:
                    return below.parts[0], root / below.parts[0], PurePosixPath(*below.parts[1:]), None
                return default, root, below, None
            workflow = parts[at - 1] if at >= 2 and parts[at - 2] == "workflows" else None
            return named or parts[at - 1], root, below, workflow
        root = self._configured_root(path)
        if root is not None:
            return self._folder_config(root).get("namespace") or root.name, root, path.relative_to(root), None
        return default or (parts[0] if len(parts) > 1 else None), PurePosixPath(*parts[:1]), PurePosixPath(*parts[1:]), None

    def _model(self, path: PurePosixPath) -> Model | None:
        try:
            sql = (self.root / path).read_text()
        except (OSError, UnicodeDecodeError) as e:
            self.notes.append(error("PROJECT005", str(e), path))
            return None
        directives = parse_directives(sql, path)
        self.notes += directives.diagnostics
        folder = path.parent
        if folder not in self.places:
            self.places[folder] = self._place(path)
        namespace, root, _, workflow = self.places[folder]
        below = PurePosixPath(*path.parts[len(root.parts) :])
        try:
            own = ModelId.parse(".".join([namespace or "", *below.with_suffix("").parts]))
        except ValueError:
            own = None
        identity = directives.id or own
        if identity is None:
            self.notes.append(error("PROJECT004", f"no valid model id for {path}", path))
            return None
        if folder not in self.chains:
            self.chains[folder] = self._settings(root, below)
        settings = self.chains[folder]
        declared = self.config.get("model", {}).get(identity.name) or self.config.get("model", {}).get(identity.name.replace(".", "_")) or {}
        incremental, kind = directives.incremental, directives.materialization or settings["materialized"]
        wanted = declared.get("incremental", {})
        if wanted.get("strategy"):
            found = self._incremental(wanted, path)
            if found and incremental is None:
                incremental = found
                kind = directives.materialization or "incremental"
        if wanted.get("overlap") and incremental:
            incremental = Incremental(incremental.strategy, incremental.columns, wanted["overlap"])
        if incremental and incremental.strategy == "key":
            directives.key = tuple(sorted({*directives.key, *incremental.columns}))
        if kind == "incremental" and incremental is None:
            incremental = Incremental("append")
        policy, tolerances = _policy(declared.get("diff", {}))
        return Model(identity, str(path), sql, directives, kind, settings["schema"], tuple(sorted({*settings["tags"], *directives.tags})), directives.owner or settings["owner"], incremental, _contract(declared), policy, tolerances, workflow)

    def _incremental(self, wanted: dict, path: PurePosixPath) -> Incremental | None:
        names = {"append": "", "key": wanted.get("key", ""), "partition": wanted.get("partition", ""), "time-window": wanted.get("column", ""), "window": wanted.get("column", "")}
        strategy = wanted["strategy"]
        if strategy not in names:
            self.notes.append(error("CONFIG001", f"unknown incremental strategy {strategy!r}", path))
            return None
        columns = tuple(c.strip() for c in names[strategy].split(",") if c.strip())
        return Incremental("window" if strategy == "time-window" else strategy, columns)

    def _settings(self, root: PurePosixPath, below: PurePosixPath) -> dict:
        """Workspace, then root, then folders from the top down; tags add up, a schema comes from a folder only."""
        out = {"materialized": self.transform.get("default_materialization", "view"), "schema": None, "owner": None, "tags": set()}
        chain = [root, *[p for p in reversed((root / below).parents) if p != root and root in p.parents]]
        layers = []
        for folder in dict.fromkeys([*[p for p in reversed(root.parents)], *chain]):
            config = self._folder_config(folder)
            if not config:
                continue
            layers.append((config, False))
            for name, inner in sorted(config.get("folder", {}).items(), key=lambda x: len(PurePosixPath(x[0]).parts)):
                if PurePosixPath(name) in (root / below).relative_to(folder).parents:
                    layers.append((inner, True))
        for layer, is_folder in layers:
            if layer.get("materialized"):
                if layer["materialized"] in MATERIALIZATIONS:
                    out["materialized"] = layer["materialized"]
                else:
                    self.notes.append(error("CONFIG001", f"unknown materialization {layer['materialized']!r}", root))
            if is_folder and layer.get("schema"):
                out["schema"] = layer["schema"]
            out["owner"] = layer.get("owner", out["owner"])
            out["tags"] |= set(layer.get("tags", []))
        return out

    def _seeds(self) -> dict[str, Seed]:
        seeds: dict[str, Seed] = {}
        for path in self._files("*.csv"):
            if path.parts[0] != "seeds":
                continue
            content = (self.root / path).read_bytes()
            name = path.stem
            if name in seeds:
                self.notes.append(error("PROJECT009", f"seed {name} is also defined in {seeds[name].file}", path))
                continue
            try:
                columns = tuple(header(content.decode("utf-8-sig")))
            except UnicodeDecodeError as e:
                self.notes.append(error("PROJECT008", str(e), path))
                continue
            schema = self.config.get("seed", {}).get(name, {}).get("schema") or self.config.get("seeds", {}).get("schema") or self.transform.get("default_schema") or "seeds"
            seeds[name] = Seed(name, str(path), Relation(schema, name), seed_hash(content), columns)
        return seeds

    def _tests(self) -> dict[str, SqlTest]:
        found = [p for p in self._files("*.sql") if p.parts[0] == "tests"]
        return {p.stem: SqlTest(p.stem, str(p), (self.root / p).read_text()) for p in found}


def _glob(path: PurePosixPath, pattern: str) -> bool:
    return path.full_match(pattern)


def _contract(declared: dict) -> Contract:
    columns = {name: (c.get("type"), c.get("nullable")) for name, c in declared.get("columns", {}).items()}
    return Contract(bool(declared.get("contract", {}).get("enforced")), columns, dict(declared.get("renames", {})))


def _policy(declared: dict) -> tuple[Policy | None, dict[str, Tolerance]]:
    names = ("max_added_rows", "max_removed_rows", "max_modified_rows", "max_changed_fraction", "require_keyed_diff", "require_full_diff")
    given = {k: declared[k] for k in names if k in declared}
    tolerances = {c: Tolerance(t.get("absolute_tolerance"), t.get("relative_tolerance")) for c, t in declared.get("columns", {}).items()}
    return (Policy(**given) if given else None), tolerances
