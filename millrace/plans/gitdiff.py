"""Which models changed since a Git revision."""

from __future__ import annotations

import subprocess
from pathlib import PurePosixPath

from .compiler import Compiled
from .directives import parse_directives
from .identity import ModelId
from .relations import canonical, references
from .sqltext import tokenize
from .workspace import CONFIG, ROOT_CONFIG


class GitError(RuntimeError):
    pass


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def changed_files(root: str, revision: str) -> dict[str, str]:
    """Paths (relative to ``root``) that differ from the merge base with ``revision``: their status letters."""
    base = _git(root, "merge-base", revision, "HEAD").strip()
    out: dict[str, str] = {}
    fields = _git(root, "diff", "--name-status", "-z", "-M", "--relative", base).split("\0")
    k = 0
    while k < len(fields) - 1:
        status = fields[k]
        if status[0] in "RC":
            out[fields[k + 1]], out[fields[k + 2]] = "D", "A"
            k += 3
        else:
            out[fields[k + 1]] = status[0]
            k += 2
    for path in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0"):
        if path:
            out[path] = "A"
    return out


def _meaning(sql: str) -> tuple:
    d = parse_directives(sql)
    return canonical(sql), d.id, d.materialization, d.incremental, d.tags, d.owner, d.key, d.not_null


def changed_since(compiled: Compiled, revision: str) -> set[ModelId]:
    """Models whose meaning, settings, seeds or tests changed, and dependents of models that are gone.

    Model files compare by their SQL without comments and spacing and by their
    directives.  A folder's settings touch its subtree, the workspace's all.
    """
    root = compiled.workspace.root
    base = _git(root, "merge-base", revision, "HEAD").strip()
    prefix = _git(root, "rev-parse", "--show-prefix").strip()
    by_file = {m.model.file: i for i, m in compiled.models.items()}
    out: set[ModelId] = set()
    for path, status in changed_files(root, revision).items():
        name = PurePosixPath(path).name
        if name == CONFIG:
            return set(compiled.models)
        if name == ROOT_CONFIG:
            folder = PurePosixPath(path).parent
            out |= {i for f, i in by_file.items() if folder in PurePosixPath(f).parents}
        elif path in by_file:
            if status == "M":
                try:
                    before = _git(root, "show", f"{base}:{prefix}{path}")
                except GitError:
                    before = ""
                if before and _meaning(before) == _meaning(compiled.models[by_file[path]].model.sql):
                    continue
            out.add(by_file[path])
        elif path.startswith("seeds/") and name.endswith(".csv"):
            stem = PurePosixPath(path).stem
            out |= {i for i, m in compiled.models.items() if any(s.table == stem for s in m.sources)}
        elif path.startswith("tests/") and name.endswith(".sql"):
            test = compiled.tests.get(PurePosixPath(path).stem)
            out |= set(test.targets) if test else set()
        elif name.endswith(".sql") and status == "D":
            stem = PurePosixPath(path).stem
            out |= {i for i, m in compiled.models.items() if any(r.parts[-1] == stem for r in references(tokenize(m.model.sql)))}
    return out
