import io
import json
import subprocess

import pytest
from conftest import SF
from millrace.cli import main
from millrace.plans.artifacts import read_artifact
from millrace.plans.analysis import Analyzer
from millrace.plans.compiler import compile_workspace
from millrace.plans.gitdiff import changed_since
from millrace.plans.lineage import LineageGraph, Node, lineage_diff, open_lineage
from millrace.plans.workspace import Workspace
from pyspark.sql.types import StructType

T = "workflows/shop/transforms/"
FILES = {
    "millrace.toml": '[transform]\ndefault_schema = "an"\n',
    T + "stg.sql": "-- @view\nselect o_orderkey, o_custkey, o_totalprice from orders",
    T + "by.sql": "-- @table\n-- @key o_custkey\nselect o_custkey, sum(o_totalprice) as total from stg where o_orderkey > 0 group by 1",
    "tests/neg.sql": "select * from shop.by where total < 0",
}


@pytest.fixture
def cli(spark, workspace):
    root = workspace(FILES)

    def call(*args, code=0):
        out = io.StringIO()
        assert main([args[0], *args[1:], "--root", root, "--sources", SF, "--json"], spark, out) == code, out.getvalue()
        return json.loads(out.getvalue())

    call.root = root
    return call


def test_command_line(cli):
    assert cli("check")["models"] == 2
    assert [m["id"] for m in cli("list")] == ["shop.stg", "shop.by"]
    assert cli("inspect", "by")["key"] == ["o_custkey"]
    assert cli("plan")["summary"]["build"] == 2
    assert cli("run")["status"] == "passed"
    assert cli("explain", "by")["action"] == "skip"
    assert cli("test")["neg"]["status"] == "passed"
    assert cli("impact", "orders.o_totalprice")["columns"] == ["shop.by.total", "shop.stg.o_totalprice"]
    assert cli("lineage", "shop.by.total")["upstream"]
    assert len(cli("lineage", "--format", "openlineage")) == 5
    assert "main" in cli("ref", "list")
    cli("ref", "create", "cand")
    assert cli("run", "--environment", "cand")["models"]["shop.by"]["status"] == "cached"
    assert [d["status"] for d in cli("diff", "--to", "cand")["datasets"]] == ["unchanged", "unchanged"]
    assert cli("promote", "cand", "--check")
    assert len(cli("state", "runs")) == 2 and cli("state", "model", "shop.by")
    assert cli("manifest")["models"]["shop.by"]["depends"] == ["shop.stg"]
    assert read_artifact(f"{cli.root}/.millrace", "run")["status"] == "passed" and read_artifact(f"{cli.root}/.millrace", "diff") is None
    with open(f"{cli.root}/graph.json", "w") as f:
        json.dump(cli("lineage"), f)
    assert cli("lineage", "--diff", f"{cli.root}/graph.json")["edges_added"] == []
    assert "error" in cli("run", "nope", code=2)
    assert cli("doctor")["compiles"]


def test_partition_diff_is_printed_whole(spark, workspace):
    model = "-- @table\n-- @key id\nselect o_orderkey as id from orders where o_orderkey "
    root = workspace({"millrace.toml": '[transform]\ndefault_schema = "an"\n', T + "ids.sql": model + "> 0"})

    def call(*args):
        out = io.StringIO()
        code = main([*args, "--root", root, "--sources", SF, "--json"], spark, out)
        return code, json.loads(out.getvalue())

    assert call("run")[0] == 0 and call("ref", "create", "cand")[0] == 0
    with open(f"{root}/{T}ids.sql", "w") as f:
        f.write(model + "< 0")
    assert call("run", "--environment", "cand")[0] == 0
    report = call("diff", "ids", "--to", "cand", "--partition", "id")[1]["report"]
    names = [r["partition"] for r in report]
    assert len(names) == spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey > 0").count() > 1000
    assert names == sorted(names) and {r["status"] for r in report} == {"removed"}


def test_changes_since_a_revision(cli, workspace):
    git = lambda *a: subprocess.run(["git", "-C", cli.root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    since = lambda: {i.name for i in changed_since(compile_workspace(Workspace.load(cli.root)), "HEAD")}
    assert since() == set()
    workspace({T + "stg.sql": "-- @view\nSELECT o_orderkey, o_custkey,   o_totalprice FROM orders -- same"})
    assert since() == set()
    workspace({T + "stg.sql": "-- @view\nselect o_orderkey, o_custkey, o_totalprice + 1 as o_totalprice from orders"})
    assert since() == {"shop.stg"}
    workspace({"tests/neg.sql": "select * from shop.by where total < 1"})
    assert since() == {"shop.stg", "shop.by"}
    assert [m["id"] for m in cli("list", "changed+", "--since", "HEAD")] == ["shop.stg", "shop.by"]


def test_translate_command(cli, workspace, tmp_path):
    project = workspace({"dbt_project.yml": "name: p\n", "models/a.sql": "select 1 as k", "models/b.sql": "select * from {{ ref('a') }}"}, "dbt")
    done = cli("translate", project, "--out", str(tmp_path / "out"))
    assert done["summary"]["CLEAN"] == 2 and "transforms/p/b.sql" in done["written"]


SCHEMAS = {"external.raw": "id string, titre double, kind string, captured timestamp", "external.samples": "sample_id string, batch string"}


def analysed(spark, root):
    c = compile_workspace(Workspace.load(root))
    a = Analyzer(spark, c, lambda r: StructType.fromDDL(SCHEMAS[r.name]) if r.name in SCHEMAS else None)
    return c, a.run(), a


def test_types_and_lineage(spark, workspace):
    A = "workflows/assay/transforms/"
    root = workspace(
        {
            A + "raw.sql": "select * from external.raw",
            A + "clean.sql": "select id as sample_id, ln(titre) as lt, captured from raw where kind = 'x'",
            A + "daily.sql": "select date_trunc('day', captured) as day, count(*) as n, avg(lt) as mean from clean group by 1 order by 1",
            A + "joined.sql": "select c.sample_id, s.batch, c.lt / 2 as half from clean c join external.samples s on s.sample_id = c.sample_id",
            A + "ranked.sql": "select sample_id, row_number() over (partition by batch order by half) as rn, case when half > 1 then 1 end as flag from joined",
            A + "mystery.sql": "select * from external.mystery",
            A + "broken.sql": "select nope from raw",
        }
    )
    c, found, analyzer = analysed(spark, root)
    by = {i.last: a for i, a in found.items()}
    assert [f.dataType.simpleString() for f in by["daily"].schema] == ["timestamp_ntz", "bigint", "double"]
    how = lambda m, col: {(x.relation, x.column, x.directness, x.transformation) for x in by[m].inputs[col]}
    assert ("assay.raw", "titre", "DIRECT", "TRANSFORMATION") in how("clean", "lt") and ("assay.raw", "kind", "INDIRECT", "FILTER") in how("clean", "lt")
    assert ("assay.clean", "lt", "DIRECT", "AGGREGATION") in how("daily", "mean") and ("assay.clean", "captured", "INDIRECT", "GROUP_BY") in how("daily", "n")
    assert {x[:2] for x in how("joined", "half") if x[3] == "JOIN"} == {("assay.clean", "sample_id"), ("external.samples", "sample_id")}
    assert {("assay.joined", "batch", "INDIRECT", "GROUP_BY"), ("assay.joined", "half", "INDIRECT", "SORT")} <= how("ranked", "rn")
    assert ("assay.joined", "half", "DIRECT", "CONDITIONAL") in how("ranked", "flag")
    assert by["mystery"].schema is None and [d.code for d in analyzer.diagnostics] == ["TYPE001"]
    g = LineageGraph.build(c, found)
    assert g.impact(Node("column", "external.raw.titre"))["models"] == ["assay.clean", "assay.daily", "assay.joined", "assay.ranked", "assay.raw"]
    assert LineageGraph.from_json(g.to_json()).fingerprint() == g.fingerprint()
    events = open_lineage(c, found, "ns", "p", "2024-01-01T00:00:00Z")
    assert sum("job" in e for e in events) == 7 and all("eventTime" in e and "producer" in e for e in events)
    workspace({A + "clean.sql": "select id as sample_id, titre as lt, captured from raw"})
    c2, found2, _ = analysed(spark, root)
    d = lineage_diff(g, LineageGraph.build(c2, found2))
    assert not d.empty and any(s.name == "assay.raw.titre" and t.name == "assay.clean.lt" for s, t, _, _ in d.edges_changed)
    assert lineage_diff(g, g).empty
