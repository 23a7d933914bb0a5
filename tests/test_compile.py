import pytest
from millrace.plans.compiler import compile_workspace
from millrace.plans.directives import parse_directives
from millrace.plans.graph import Graph
from millrace.plans.identity import ModelId
from millrace.plans.selection import SelectionError, select
from millrace.plans.workspace import Workspace

T = "workflows/assay/transforms/"


def compiled(root):
    return compile_workspace(Workspace.load(root))


def codes(c):
    return sorted(d.code for d in c.diagnostics)


def test_dependencies_follow_from_names(workspace):
    c = compiled(workspace({T + "raw.sql": "select * from external.raw_results", T + "results.sql": "select * from raw r join external.samples s using (k)", "workflows/reporting/transforms/monthly.sql": "select * from assay.results"}))
    assert c.ok
    assert [str(i) for i in c.order] == ["assay.raw", "assay.results", "reporting.monthly"]
    assert [s.name for s in c.models[ModelId.parse("assay.results")].sources] == ["external.samples"]


def test_ctes_shadow_models_and_refs_are_rewritten(workspace):
    c = compiled(workspace({"millrace.toml": '[transform]\ndefault_schema = "analytics"\n', T + "raw.sql": "select * from external.x", T + "results.sql": "with raw as (select * from external.local_raw) select * from raw join assay.raw r on r.k = raw.k"}))
    sql = c.models[ModelId.parse("assay.results")].sql
    assert "`analytics`.`assay__raw` r" in sql and "from raw join" in sql and "`external`.`local_raw` AS `local_raw`" in sql


def test_ephemeral_models_are_inlined_through_chains(workspace):
    c = compiled(workspace({T + "a.sql": "-- @ephemeral\nselect id from external.r -- no newline", T + "b.sql": "-- @ephemeral\nselect id from a where id > 0", T + "c.sql": "select x.id from b x join b y on x.id = y.id"}))
    sql = c.models[ModelId.parse("assay.c")].sql
    assert sql.count("`external`.`r`") == 2 and "assay__b" not in sql


@pytest.mark.parametrize(
    ("files", "code"),
    [
        ({T + "a.sql": "select * from b", T + "b.sql": "select * from a"}, "GRAPH001"),
        ({T + "a.sql": "select * from assay.a"}, "GRAPH001"),
        ({"workflows/a/transforms/results.sql": "select 1 as x", "workflows/b/transforms/results.sql": "select 1 as x", "workflows/c/transforms/m.sql": "select * from results"}, "RESOLUTION001"),
        ({T + "a.sql": "-- @id x.y\nselect 1 as k", T + "b.sql": "-- @id x.y\nselect 1 as k"}, "PROJECT003"),
        ({T + "a__b.sql": "-- @table\nselect 1 as k", T + "a/b.sql": "-- @table\nselect 1 as k"}, "PROJECT007"),
        ({T + "a.sql": "select (1 as k"}, "PARSE001"),
        ({T + "a.sql": "drop table x"}, "MODEL001"),
        ({T + "a.sql": "-- @table now\nselect 1 as k"}, "PARSE002"),
        ({T + "a.sql": "-- @nonsense\nselect 1 as k"}, "PARSE003"),
        ({"millrace.toml": "[transform\n", T + "a.sql": "select 1 as k"}, "CONFIG001"),
        ({"millrace.toml": '[dependencies]\ncross_workflow = "error"\n', "workflows/a/transforms/m.sql": "select 1 as k", "workflows/b/transforms/n.sql": "select * from a.m"}, "DEPENDENCIES001"),
        ({}, "PROJECT001"),
    ],
)
def test_diagnostics(workspace, tmp_path, files, code):
    (tmp_path / "ws").mkdir(exist_ok=True)
    assert code in codes(compiled(workspace(files) if files else str(tmp_path / "ws")))


def test_settings_precedence(workspace):
    c = compiled(
        workspace(
            {
                "millrace.toml": '[transform]\ndefault_materialization = "view"\ndefault_schema = "analytics"\n',
                T + "transform.toml": 'materialized = "table"\nowner = "team"\ntags = ["assay"]\n\n[folder.marts]\nmaterialized = "view"\ntags = ["gold"]\nschema = "marts"\n',
                T + "staging/raw.sql": "select * from external.x",
                T + "marts/results.sql": "select * from staging.raw",
                T + "marts/direct.sql": "-- @table\n-- @tags own\nselect * from staging.raw",
            }
        )
    )
    m = {str(i): x for i, x in c.models.items()}
    assert m["assay.staging.raw"].materialization == "table" and m["assay.staging.raw"].target.name == "analytics.assay__staging__raw"
    assert m["assay.marts.results"].materialization == "view" and m["assay.marts.results"].target.name == "marts.assay__marts__results"
    assert m["assay.marts.direct"].materialization == "table" and m["assay.marts.direct"].model.tags == ("assay", "gold", "own")


def test_custom_roots_pinned_ids_and_seeds(workspace):
    c = compiled(
        workspace(
            {
                "millrace.toml": '[transform]\ndefault_namespace = "main"\n[transform.discovery]\ninclude = ["domains/*/transforms/**"]\nexclude = ["domains/*/transforms/ignored/**"]\n[seeds]\nschema = "raw"\n',
                "domains/assay/transforms/raw.sql": "-- @id assay.first\nselect * from raw.raw_events",
                "domains/assay/transforms/ignored/x.sql": "select 1 as k",
                "seeds/raw_events.csv": "id,status\n1,a\n",
            }
        )
    )
    assert [str(i) for i in c.models] == ["assay.first"]
    assert [s.name for s in c.seeds.values()] == ["raw_events"] and c.models[ModelId.parse("assay.first")].sources[0] in c.seeds


def test_directives():
    d = parse_directives("-- @incremental key=b,a\n-- @key a\n-- @not-null c\n--   @tags y, x\n-- @owner me\nselect 1")
    assert (d.materialization, d.key, d.not_null, d.tags, d.owner) == ("incremental", ("a", "b"), ("c",), ("x", "y"), "me")
    assert d.incremental.columns == ("b", "a")
    assert parse_directives("-- @incremental full\nselect 1").diagnostics[0].code == "PARSE002"
    assert parse_directives("-- @view\n-- @table\nselect 1").diagnostics[0].code == "PARSE002"


def test_versions_react_to_meaning_only(workspace):
    def version(sql, config="", upstream="select * from external.r"):
        c = compiled(workspace({"millrace.toml": config, T + "up.sql": upstream, T + "m.sql": sql}, root=f"w{abs(hash((sql, config, upstream)))}"))
        return c.models[ModelId.parse("assay.m")].version

    base = version("select a from up")
    assert version("-- @tags x\n-- @owner me\nSELECT  a\nFROM up -- note") == base
    assert version("select b from up") != base
    assert version("-- @table\nselect a from up") != base
    assert version("-- @not-null a\nselect a from up") != base
    assert version("select a from up", upstream="select k from external.r") != base
    assert version("select a from up", config='[transform]\ndefault_schema = "s"\n') != base


def test_selectors(workspace):
    c = compiled(workspace({T + "a.sql": "-- @tags t\nselect * from external.r", T + "b.sql": "select * from a", T + "c.sql": "-- @tags t\nselect * from b", "workflows/other/transforms/d.sql": "select * from assay.c"}))
    pick = lambda *a, **k: [i.name for i in select(c, *a, **k)]
    assert pick() == ["assay.a", "assay.b", "assay.c", "other.d"]
    assert pick(["+b"]) == ["assay.a", "assay.b"]
    assert pick(["b+"]) == ["assay.b", "assay.c", "other.d"]
    assert pick(["tag:t"]) == ["assay.a", "assay.c"]
    assert pick(["namespace:other"]) == ["other.d"]
    assert pick(["source:external.r"]) == ["assay.a"]
    assert pick(["assay.*"], ["c+"]) == ["assay.a", "assay.b"]
    assert pick(["+d"], tags=["t"]) == ["assay.a", "assay.c"]
    assert pick(["b"], upstream=True, downstream=True) == ["assay.a", "assay.b", "assay.c", "other.d"]
    assert pick(["changed"], changed=set) == []
    for bad in ("nope", "tag:none", "++", "odd:x"):
        with pytest.raises(SelectionError):
            pick([bad])


def test_graph_orders_smallest_first():
    g = Graph({"c": [], "a": ["c"], "b": [], "d": ["a", "b"]})
    assert g.order() == ["b", "c", "a", "d"] and g.cycle() is None
    assert g.upstream(["a"]) == {"a", "c"} and g.downstream(["c"]) == {"c", "a", "d"}
