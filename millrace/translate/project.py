"""dbt projects into workspaces: models, sources, tests, seeds, with a finding for whatever isn't certain."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from .templates import Evaluator, Macro, NotStatic, parse

CLEAN, REVIEW, UNSUPPORTED = "CLEAN", "REVIEW", "UNSUPPORTED"

#: Fixed codes of findings.
CODES = {
    "DBT001": "unresolved ref",
    "DBT002": "unresolved source",
    "DBT003": "unresolved var",
    "DBT004": "macro or call without an equivalent",
    "DBT005": "template construct without a static meaning",
    "DBT006": "is_incremental in a pattern without a strategy",
    "DBT007": "setting without an equivalent",
    "DBT008": "materialization without an equivalent",
    "DBT009": "depends on the environment",
    "DBT010": "unsupported kind of resource",
    "DBT011": "disabled",
    "DBT012": "cross-project or versioned ref",
    "DBT013": "name collision",
    "DBT014": "test without an equivalent",
    "DBT015": "seed that can't be taken over",
    "DBT016": "file can't be loaded",
    "DBT017": "ref to a model that isn't translated",
}
_UNSUPPORTED = frozenset(("DBT010", "DBT011", "DBT016"))
_TYPES = {"string": "varchar", "int": "integer", "bigint": "bigint", "float": "double", "numeric": "decimal(28,6)", "boolean": "boolean", "timestamp": "timestamp"}
_NULL_KEY = "_dbt_utils_surrogate_key_null_"


@dataclass
class Finding:
    code: str
    message: str


@dataclass
class Outcome:
    kind: str
    name: str
    findings: list[Finding] = field(default_factory=list)

    @property
    def classification(self) -> str:
        if any(f.code in _UNSUPPORTED for f in self.findings):
            return UNSUPPORTED
        return REVIEW if self.findings else CLEAN


@dataclass
class Translation:
    files: dict[str, str]
    outcomes: list[Outcome]

    def outcome(self, name: str) -> Outcome:
        return next(o for o in self.outcomes if o.name == name)

    def summary(self) -> dict[str, int]:
        return {c: sum(o.classification == c for o in self.outcomes) for c in (CLEAN, REVIEW, UNSUPPORTED)}

    def write(self, folder: str, overwrite: bool = False) -> list[str]:
        """Writes the workspace; an existing file is an error unless ``overwrite``."""
        clash = [p for p in self.files if os.path.exists(os.path.join(folder, p))]
        if clash and not overwrite:
            raise FileExistsError(", ".join(sorted(clash)[:5]))
        for path, content in self.files.items():
            full = os.path.join(folder, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w") as f:
                f.write(content)
        return sorted(self.files)


@dataclass
class _Model:
    name: str
    path: Path
    source: str
    config: dict[str, Any]
    columns: list[dict]
    tests: list[Any]


class Translator:
    def __init__(self, root: str | os.PathLike) -> None:
        self.root = Path(root)
        self.outcomes: list[Outcome] = []
        self.files: dict[str, str] = {}
        self.config = yaml.safe_load((self.root / "dbt_project.yml").read_text()) or {}
        self.name = self.config.get("name", self.root.name)
        self.vars = self.config.get("vars") or {}
        self.vars = {**{k: v for k, v in self.vars.items() if not isinstance(v, dict)}, **(self.vars.get(self.name) or {})}
        self.models: dict[str, _Model] = {}
        self.sources: dict[tuple[str, str], str] = {}
        self.seeds: dict[str, Path] = {}
        self.macros: dict[str, Macro] = {}
        self.properties: dict[str, dict] = {}

    # -- loading

    def _paths(self, key: str, default: str) -> list[Path]:
        return [self.root / p for p in self.config.get(key) or [default] if (self.root / p).is_dir()]

    def load(self) -> None:
        for folder in self._paths("macro-paths", "macros"):
            for path in sorted(folder.rglob("*.sql")):
                outcome = Outcome("macro", path.stem)
                try:
                    self.macros |= parse(path.read_text())[1]
                except NotStatic as e:
                    outcome.findings.append(Finding(e.code, str(e)))
                self.outcomes.append(outcome)
        for folder in self._paths("model-paths", "models"):
            for path in sorted([*folder.rglob("*.yml"), *folder.rglob("*.yaml")]):
                self._properties(path)
            for path in sorted(folder.rglob("*.sql")):
                below = path.relative_to(folder)
                own = self.properties.get(path.stem, {})
                config = self._folder_config(below) | (own.get("config") or {})
                if path.stem in self.models:
                    self.outcomes.append(Outcome("model", path.stem, [Finding("DBT013", f"two models are named {path.stem}")]))
                    continue
                self.models[path.stem] = _Model(path.stem, below, path.read_text(), config, own.get("columns") or [], (own.get("tests") or []) + (own.get("data_tests") or []))
        for folder in self._paths("seed-paths", "seeds"):
            self.seeds |= {p.stem: p for p in sorted(folder.rglob("*.csv"))}
        for key, default, kind in (("snapshot-paths", "snapshots", "snapshot"), ("analysis-paths", "analyses", "analysis")):
            for folder in self._paths(key, default):
                for path in sorted(folder.rglob("*.sql")):
                    self.outcomes.append(Outcome(kind, path.stem, [Finding("DBT010", f"{kind} is not translated")]))

    def _properties(self, path: Path) -> None:
        try:
            content = yaml.safe_load(path.read_text()) or {}
        except yaml.YAMLError as e:
            self.outcomes.append(Outcome("package", path.name, [Finding("DBT016", str(e).split("\n")[0])]))
            return
        for m in (content.get("models") or []) + (content.get("seeds") or []):
            self.properties[m["name"]] = m
        for s in content.get("sources") or []:
            for t in s.get("tables") or []:
                relation = f"{s.get('schema', s['name'])}.{t.get('identifier', t['name'])}"
                self.sources[s["name"], t["name"]] = relation
                self.outcomes.append(Outcome("source", f"{s['name']}.{t['name']}"))
                for column in t.get("columns") or []:
                    self._tests(relation, column.get("name"), (column.get("tests") or []) + (column.get("data_tests") or []), f"{s['name']}_{t['name']}")
                self._tests(relation, None, (t.get("tests") or []) + (t.get("data_tests") or []), f"{s['name']}_{t['name']}")

    def _folder_config(self, below: Path) -> dict[str, Any]:
        """Settings of dbt_project.yml, from the project down the model's folders; tags add up."""
        out: dict[str, Any] = {}
        level = (self.config.get("models") or {}).get(self.name) or {}
        for part in [None, *below.parts[:-1], below.stem]:
            if part is not None:
                level = level.get(part) if isinstance(level.get(part), dict) else {}
            for k, v in level.items():
                if k.startswith("+") or not isinstance(v, dict):
                    key = k.lstrip("+")
                    if key == "tags":
                        v = [*out.get("tags", []), *([v] if isinstance(v, str) else v)]
                    out[key] = v
        return out

    # -- calls

    def _caller(self, outcome: Outcome, config: dict[str, Any]):
        def call(name: str, args: list, named: dict, ev: Evaluator) -> Any:
            if name == "ref":
                return self._ref(args, named, outcome)
            if name == "source":
                if len(args) == 2 and tuple(args) in self.sources:
                    return self.sources[tuple(args)]
                raise NotStatic("DBT002", f"source {args} isn't declared")
            if name == "var":
                if args[0] in self.vars:
                    return self.vars[args[0]]
                if len(args) > 1 or "default" in named:
                    return args[1] if len(args) > 1 else named["default"]
                raise NotStatic("DBT003", f"var {args[0]} has no value")
            if name == "config":
                for k, v in named.items():
                    config[k] = [*config.get("tags", []), *([v] if isinstance(v, str) else v)] if k == "tags" else v
                return ""
            if name in ("env_var", "run_query", "adapter.get_relation", "statement", "load_result", "dbt_utils.get_column_values"):
                raise NotStatic("DBT009" if name == "env_var" else "DBT004", f"{name} needs the original environment")
            if name == "is_incremental":
                config["__incremental"] = True
                return False
            done = lower_helper(name, args, named, self.vars)
            if done is None:
                raise NotStatic("DBT004", f"{name} has no equivalent")
            return done

        return call

    def _ref(self, args: list, named: dict, outcome: Outcome) -> str:
        if len(args) != 1 or named:
            if len(args) == 2 and args[0] == self.name and not named:
                args = args[1:]
            else:
                raise NotStatic("DBT012", f"ref({', '.join(map(str, args))}) is across projects or versioned")
        name = args[0]
        if name in self.seeds:
            return f"seeds.{name}"
        if name not in self.models:
            raise NotStatic("DBT001", f"ref({name}) is no model")
        return self._logical(self.models[name])

    def _logical(self, m: _Model) -> str:
        return ".".join((self.name, *m.path.with_suffix("").parts))

    def _evaluate(self, source: str, outcome: Outcome, config: dict[str, Any], this: str = "") -> str | None:
        """The rendered text, or None with a finding."""
        env = {n: NotStatic("DBT009", f"{n} depends on the environment") for n in ("target", "run_started_at", "invocation_id", "env_var")}
        names: dict[str, Any] = {"this": this, "execute": True, **env}
        try:
            nodes, own = parse(source)
            return Evaluator(self.macros | own, self._caller(outcome, config), names).render(nodes, {})
        except NotStatic as e:
            outcome.findings.append(Finding(e.code, str(e)))
        except (TypeError, IndexError, KeyError, AttributeError) as e:
            outcome.findings.append(Finding("DBT005", f"template can't be evaluated: {e}"))
        return None

    # -- resources

    def run(self) -> Translation:
        self.load()
        schema = "analytics"
        self.files["millrace.toml"] = f'[transform]\ndefault_schema = "{schema}"\n\n[seeds]\nschema = "seeds"\n'
        for m in self.models.values():
            self._model(m)
        for name, path in self.seeds.items():
            outcome = Outcome("seed", name)
            self.outcomes.append(outcome)
            try:
                self.files[f"seeds/{name}.csv"] = path.read_text()
            except (OSError, UnicodeDecodeError) as e:
                outcome.findings.append(Finding("DBT015", str(e)))
        for folder in self._paths("test-paths", "tests"):
            for path in sorted(folder.rglob("*.sql")):
                outcome = Outcome("singular_test", path.stem)
                self.outcomes.append(outcome)
                sql = self._evaluate(path.read_text(), outcome, {})
                if sql is not None:
                    self.files[f"tests/{path.stem}.sql"] = sql.strip() + "\n"
        return Translation(self.files, self.outcomes)

    def _model(self, m: _Model) -> None:
        outcome = Outcome("model", m.name)
        self.outcomes.append(outcome)
        config = dict(m.config)
        sql = self._evaluate(m.source, outcome, config, self._logical(m))
        if config.get("enabled") is False:
            outcome.findings.append(Finding("DBT011", f"{m.name} is disabled"))
            return
        kind = config.get("materialized", "view")
        lines: list[str] = []
        if kind in ("view", "table", "ephemeral"):
            lines.append(f"-- @{kind}")
        elif kind == "incremental":
            lines.append(f"-- @incremental {self._strategy(m, config, outcome)}")
        else:
            outcome.findings.append(Finding("DBT008", f"materialization {kind}"))
            lines.append("-- @table")
        tags = config.get("tags") or []
        tags = [tags] if isinstance(tags, str) else tags
        if tags:
            lines.append(f"-- @tags {', '.join(dict.fromkeys(tags))}")
        owner = (self.properties.get(m.name, {}).get("meta") or {}).get("owner")
        if owner:
            lines.append(f"-- @owner {owner}")
        for k in sorted(set(config) & {"pre_hook", "post_hook", "pre-hook", "post-hook", "database", "alias", "schema", "on_schema_change", "sql_header", "contract"}):
            outcome.findings.append(Finding("DBT007", f"setting {k} isn't carried over"))
        lines += self._column_tests(m)
        self._tests(self._logical(m), None, m.tests, m.name)
        body = sql if sql is not None else m.source  # kept as it was, so that it fails loudly
        self.files["/".join(("transforms", self.name, *m.path.parts))] = "\n".join(lines) + "\n" + body.strip() + "\n"

    _WATERMARK = re.compile(r"\{%-?\s*if\s+is_incremental\(\)\s*-?%\}(.*?)\{%-?\s*endif\s*-?%\}", re.S)

    def _strategy(self, m: _Model, config: dict[str, Any], outcome: Outcome) -> str:
        key = config.get("unique_key")
        key = [key] if isinstance(key, str) else key or []
        strategy = config.get("incremental_strategy")
        if key and strategy in (None, "merge", "delete+insert", "append"):
            return f"key={','.join(key)}"
        if strategy == "insert_overwrite":
            part = config.get("partition_by")
            part = part.get("field") if isinstance(part, dict) else part
            if part:
                return f"partition={part if isinstance(part, str) else ','.join(part)}"
        blocks = self._WATERMARK.findall(m.source)
        if blocks:
            one = re.fullmatch(r"\s*(?:where|and)\s+([\w.\"]+)\s*>=?\s*\(\s*select\s+(?:coalesce\()?max\(\s*([\w.\"]+)\s*\).*?from\s+\{\{\s*this\s*\}\}\s*\)\s*", blocks[0], re.S | re.I)
            if len(blocks) == 1 and one:
                return f"window={one[2].split('.')[-1]}"
            outcome.findings.append(Finding("DBT006", "the incremental filter has no equivalent; the model appends all of its rows"))
        return "append"

    def _column_tests(self, m: _Model) -> list[str]:
        """not_null and unique become directives where they say the same, else SQL tests."""
        keys, not_nulls = [], []
        for c in m.columns:
            tests = (c.get("tests") or []) + (c.get("data_tests") or [])
            plain = {t for t in tests if isinstance(t, str)}
            rest = [t for t in tests if not (isinstance(t, str) and t in ("unique", "not_null"))]
            if {"unique", "not_null"} <= plain and not keys:
                keys.append(c["name"])
            else:
                not_nulls += [c["name"]] if "not_null" in plain else []
                rest += ["unique"] if "unique" in plain else []
            for t in sorted(plain & {"unique", "not_null"}):
                self.outcomes.append(Outcome("generic_test", f"{t}_{m.name}_{c['name']}"))
            self._tests(self._logical(m), c["name"], rest, m.name, counted={"unique"} & plain)
        return ([f"-- @key {keys[0]}"] if keys else []) + ([f"-- @not-null {', '.join(not_nulls)}"] if not_nulls else [])

    def _tests(self, relation: str, column: str | None, tests: list[Any], owner: str, counted: set[str] | None = None) -> None:
        for t in tests:
            name, options = (t, {}) if isinstance(t, str) else next(iter(t.items()))
            options = dict(options or {})
            options |= options.pop("arguments", None) or {}
            bare = name.split(".")[-1]
            label = re.sub(r"\W+", "_", "_".join(x for x in (bare, owner, column) if x))
            while f"tests/{label}.sql" in self.files:
                label += "_again"
            outcome = Outcome("generic_test", label)
            if not (counted and bare in counted):
                self.outcomes.append(outcome)
            sql = self._test_sql(bare, relation, column, options, outcome)
            if sql is None:
                outcome.findings = outcome.findings or [Finding("DBT014", f"test {name}")]
                continue
            where = (options.get("config") or {}).get("where") or options.get("where")
            if where:
                sql = f"select * from ({sql}) as violations where {where}"
            self.files[f"tests/{label}.sql"] = sql + "\n"

    def _test_sql(self, name: str, relation: str, column: str | None, o: dict[str, Any], outcome: Outcome) -> str | None:
        quote = lambda v: "'" + str(v).replace("'", "''") + "'" if o.get("quote", True) and not isinstance(v, (int, float, bool)) else str(v)
        if name == "not_null" and column:
            return f"select * from {relation} where {column} is null"
        if name == "unique" and column:
            return f"select {column}, count(*) as cnt from {relation} where {column} is not null group by {column} having count(*) > 1"
        if name == "accepted_values" and column:
            return f"select * from {relation} where {column} not in ({', '.join(quote(v) for v in o['values'])})"
        if name == "relationships" and column:
            m = re.fullmatch(r"\s*(ref|source)\(\s*'([^']+)'(?:\s*,\s*'([^']+)')?\s*\)\s*", o["to"])
            if not m:
                return None
            try:
                parent = self.sources[m[2], m[3]] if m[1] == "source" else self._ref([m[2]], {}, outcome)
            except (KeyError, NotStatic) as e:
                outcome.findings.append(Finding(getattr(e, "code", "DBT002"), str(e)))
                return None
            return f"select child.{column} from {relation} as child left join {parent} as parent on child.{column} = parent.{o['field']} where child.{column} is not null and parent.{o['field']} is null"
        if name == "expression_is_true":
            expression = f"{column} {o['expression']}" if column else o["expression"]
            return f"select * from {relation} where not ({expression})"
        if name == "accepted_range" and column:
            strict = "" if o.get("inclusive", True) else "="
            parts = ([f"{column} <{strict} {o['min_value']}"] if "min_value" in o else []) + ([f"{column} >{strict} {o['max_value']}"] if "max_value" in o else [])
            return f"select * from {relation} where {' or '.join(parts)}" if parts else None
        if name == "not_constant" and column:
            group = o.get("group_by_columns") or []
            tail = f" group by {', '.join(group)}" if group else ""
            return f"select {''.join(g + ', ' for g in group)}count(distinct {column}) as n_values from {relation}{tail} having count(distinct {column}) = 1"
        if name == "not_empty_string" and column:
            return f"select * from {relation} where {f'trim({column})' if o.get('trim_whitespace', True) else column} = ''"
        if name == "unique_combination_of_columns":
            names = ", ".join(o["combination_of_columns"])
            return f"select {names}, count(*) as cnt from {relation} group by {names} having count(*) > 1"
        if name in ("equality", "equal_rowcount"):
            m = re.fullmatch(r"\s*ref\(\s*'([^']+)'\s*\)\s*", o["compare_model"])
            if not m:
                return None
            try:
                other = self._ref([m[1]], {}, outcome)
            except NotStatic as e:
                outcome.findings.append(Finding(e.code, str(e)))
                return None
            if name == "equal_rowcount":
                return f"select a.n as count_a, b.n as count_b from (select count(*) as n from {relation}) a cross join (select count(*) as n from {other}) b where a.n <> b.n"
            names = ", ".join(o.get("compare_columns") or ["*"])
            return f"(select {names} from {relation} except all select {names} from {other}) union all (select {names} from {other} except all select {names} from {relation})"
        return None


def lower_helper(name: str, args: list, named: dict, variables: dict) -> str | None:
    """The SQL of a known helper call; None for any other name or shape."""

    def arg(k: int, key: str, default: Any = None) -> Any:
        return args[k] if k < len(args) else named.get(key, default)

    short = name.removeprefix("dbt.").removeprefix("dbt_utils.")
    if name == "dbt_utils.generate_surrogate_key":
        fields = arg(0, "field_list")
        if not isinstance(fields, list) or not fields:
            return None
        null = "" if variables.get("surrogate_key_treat_nulls_as_empty_strings") else _NULL_KEY
        return "md5(concat_ws('-', " + ", ".join(f"coalesce(cast({f} as varchar), '{null}')" for f in fields) + "))"
    if name == "dbt_utils.star":
        if set(named) - {"from", "except", "exclude"} or len(args) > 1:
            return None
        names = named.get("except") or named.get("exclude") or []
        return f"* exclude ({', '.join(names)})" if names else "*"
    if name == "dbt_utils.group_by":
        return ", ".join(str(k + 1) for k in range(int(arg(0, "n"))))
    if name in ("dbt_utils.safe_cast", "dbt.safe_cast"):
        return f"try_cast({arg(0, 'field')} as {arg(1, 'type')})"
    if name == "dbt_utils.date_spine":
        part = arg(0, "datepart")
        return f"(select d as date_{part} from generate_series({arg(1, 'start_date')}, {arg(2, 'end_date')} - interval '1' {part}, interval '1' {part}) as s(d))"
    if name == "dbt_date.get_base_dates":
        return _base_dates(arg(0, "start_date"), arg(1, "end_date"), arg(2, "n_dateparts"), arg(3, "datepart", "day"))
    if name == "fivetran_utils.partition_by_source_relation":
        return _source_relation(arg(0, "package_name"), arg(1, "has_other_partitions", "yes"), arg(2, "alias"), arg(3, "package_prefix_union_variable", True), variables)
    if name == "fivetran_utils.fill_pass_through_columns":
        return _pass_through(variables.get(arg(0, "pass_through_variable")))
    if short.startswith("type_"):
        return _TYPES.get(short[5:])
    if not name.startswith("dbt."):
        return None
    match short:
        case "cast":
            return f"cast({arg(0, 'field')} as {arg(1, 'type')})"
        case "string_literal":
            return f"'{arg(0, 'value')}'"
        case "escape_single_quotes":
            return str(arg(0, "expression")).replace("'", "''")
        case "current_timestamp":
            return "current_timestamp"
        case "date_trunc":
            return f"date_trunc('{arg(0, 'datepart')}', {arg(1, 'date')})"
        case "datediff":
            return f"date_diff('{arg(2, 'datepart')}', {arg(0, 'first_date')}, {arg(1, 'second_date')})"
        case "dateadd":
            n = arg(1, "interval")
            return f"({arg(2, 'from_date_or_timestamp')} {'-' if isinstance(n, int) and n < 0 else '+'} interval '{abs(n)}' {arg(0, 'datepart')})" if isinstance(n, int) else None
        case "last_day":
            return f"last_day({arg(0, 'date')})" if arg(1, "datepart", "month") == "month" else None
        case "split_part":
            text, mark = arg(0, "string_text"), arg(1, "delimiter_text")
            mark = mark if str(mark).startswith("'") else f"'{mark}'"
            return f"split_part({text}, {mark}, {arg(2, 'part_number')})"
        case "hash":
            return f"md5(cast({arg(0, 'field')} as varchar))"
        case "concat":
            return "concat_ws('', " + ", ".join(arg(0, "fields")) + ")"
    return None


_DATE_PARTS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def _base_dates(start: Any, end: Any, parts: Any, part: Any) -> str | None:
    """Dates from a start to an end, or from some parts before today to tomorrow; both ends included."""
    if part not in _DATE_PARTS:
        return None
    if isinstance(start, str) and isinstance(end, str):
        first, last = f"cast('{start}' as timestamp)", f"cast('{end}' as timestamp)"
    elif start is None and end is None and isinstance(parts, int):
        first, last = f"cast(current_date as timestamp) - interval '{parts}' {part}", f"cast(current_date as timestamp) + interval '1' {part}"
    else:
        return None
    return f"(select date_trunc('{part}', d) as date_{part} from generate_series({first}, {last}, interval '1' {part}) as s(d))"


def _source_relation(package: Any, others: Any, alias: Any, prefixed: Any, variables: dict) -> str | None:
    """The partition column of a connector that unions several schemas, databases or sources; nothing for one that doesn't."""
    if not isinstance(package, str) or not isinstance(prefixed, bool):
        return None
    before = f"{package}_" if prefixed else ""
    unions = any(isinstance(v := variables.get(name), (list, tuple, dict, str)) and len(v) > 1 for name in (f"{before}union_schemas", f"{before}union_databases", f"{package}_sources"))
    if not unions:
        return ""
    column = f"{alias}.source_relation" if alias else "source_relation"
    return f"partition by {column}" if others == "no" else f", {column}"


def _pass_through(fields: Any) -> str | None:
    """The columns that a variable lists, each after a comma: names, or mappings with name, alias and transform_sql."""
    if not isinstance(fields, list):
        return None
    out = []
    for f in fields:
        if isinstance(f, str):
            out.append(f)
            continue
        name = (f.get("alias") or f.get("name")) if isinstance(f, dict) else None
        if not isinstance(name, str) or "{{" in name or "{{" in str(f.get("transform_sql") or ""):
            return None
        out.append(f"{f['transform_sql']} as {name}" if f.get("transform_sql") else name)
    return "".join(f", {c}" for c in out)


def translate(root: str | os.PathLike) -> Translation:
    return Translator(root).run()
