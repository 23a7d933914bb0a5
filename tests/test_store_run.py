import datetime as dt

import pytest
from millrace.operators import asof, diff, materialize, quality
from millrace.plans.identity import ModelId
from millrace.plans.diagnostics import CODES
from millrace.plans.planner import REASONS, staleness
from millrace.plans.project import Project, folder_sources
from millrace.plans.promotion import branch_diff, evaluate_gates, promote, rollback
from millrace.plans.runner import RunError
from millrace.sources.seeds import read_seed
from millrace.sources.store import Conflict, Store, StoreError, branch_folder
from pyspark.sql.types import StructType

T = "workflows/w/transforms/"


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


# ---------------------------------------------------------------- operators


def test_merge_by_key(spark):
    target = spark.createDataFrame([(1, "old"), (2, "keep"), (None, "n")], "id int, v string")
    rows = spark.createDataFrame([(1, "new"), (3, "ins"), (None, "m")], "id int, v string")
    assert {tuple(r) for r in materialize.merged(target, rows, ["id"]).collect()} == {(1, "new"), (2, "keep"), (3, "ins"), (None, "n"), (None, "m")}
    with pytest.raises(materialize.DuplicateKeys):
        materialize.merged(target, rows.union(rows), ["id"])
    assert materialize.merged(target, rows, []).count() == 6


def test_replace_partitions(spark):
    target = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (9, None)], "id int, d string")
    rows = spark.createDataFrame([(3, "2024-01-02"), (4, "2024-01-03"), (8, None)], "id int, d string")
    assert got(materialize.partitions_replaced(target, rows, ["d"]), "id") == [(1,), (3,), (4,), (8,)]


def test_time_window(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i)) for i in range(5)] + [(9, None)], "id int, ts timestamp_ntz")
    high = dt.datetime(2024, 1, 1, 3)
    assert got(materialize.window_rows(rows, "ts", high), "id") == [(4,)]
    assert got(materialize.window_rows(rows, "ts", high, materialize.overlap_seconds("2h")), "id") == [(2,), (3,), (4,)]
    assert materialize.window_rows(rows, "ts", None).count() == 6
    assert [materialize.overlap_seconds(x) for x in ("90s", "2 hours", "1d", "x", None)] == [90, 7200, 86400, None, None]


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {(r.k, r.t, r.v) for r in asof.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()} == {("a", 5, "y"), ("a", 1, None), ("b", 9, None), (None, 3, None), ("a", None, None)}
    assert {(r.t, r.v) for r in asof.asof_join(left, right, ["k"], "t", "t", ["v"], strict=True).where("k = 'a' AND t IS NOT NULL").collect()} == {(5, "x"), (1, None)}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_of_a_hot_key_by_slices(spark, strict):
    """One key holds nearly all rows; slices of its time axis give the same matches, gaps and nulls included."""
    left = spark.range(400).selectExpr("CASE WHEN id % 40 = 0 THEN NULL WHEN id % 13 = 0 THEN 'cold' ELSE 'hot' END AS k", "CASE WHEN id % 57 = 0 THEN NULL ELSE timestamp_seconds((id * 7919) % 5000) END AS t", "id")
    right = spark.range(90).selectExpr("CASE WHEN id % 9 = 0 THEN 'cold' ELSE 'hot' END AS k", "timestamp_seconds(CASE WHEN id < 60 THEN (id * 31) % 900 ELSE 4000 + id END) AS u", "id * 10 AS v")
    right = right.groupBy("k", "u").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    whole = asof.asof_join(left, right, ["k"], "t", "u", ["v"], strict)
    sliced = asof.asof_join(left, right, ["k"], "t", "u", ["v"], strict, slices=7)
    assert sliced.columns == whole.columns
    assert sorted(map(str, sliced.collect())) == sorted(map(str, whole.collect()))
    assert len({r.v for r in whole.collect()}) > 20


def test_keyed_diff_and_null_keys(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (None, 7.0)], "id int, value double")
    cand = spark.createDataFrame([(2, 2.5), (3, None), (4, 4.0), (None, 7.0)], "id int, value double")
    assert diff.keyed_diff(base, cand, ["id"]).first().asDict() == {"base_rows": 4, "candidate_rows": 4, "added": 1, "removed": 1, "modified": 1, "unchanged": 2, "changed_value": 1}
    old = diff.keyed_diff(base, cand, ["id"], compat=True).first()
    assert (old.added, old.removed, old.unchanged) == (2, 2, 1)
    near = diff.keyed_diff(base, cand, ["id"], tolerances={"value": diff.Tolerance(relative=0.3)}).first()
    assert near.modified == 0


def test_partition_diff_sees_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "v int, p string")
    b = spark.createDataFrame([(1, "x"), (5, "y"), (6, "w")], "v int, p string")
    assert got(diff.partition_diff(a, b, ["p"]), "partition", "status") == [("w", "added"), ("z", "removed")]
    assert got(diff.partition_diff(a, b, ["p"], content=True), "partition", "status") == [("w", "added"), ("y", "changed"), ("z", "removed")]


def test_schema_changes_and_policy():
    old = StructType.fromDDL("a int, b string, c int")
    assert diff.safety(diff.schema_changes(old, StructType.fromDDL("a int, b string, c int, d int"))) == diff.SAFE
    assert diff.safety(diff.schema_changes(old, StructType.fromDDL("a bigint, b string, c int"))) == diff.REVIEW
    assert diff.safety(diff.schema_changes(old, StructType.fromDDL("a int, b string"))) == diff.FULL_REBUILD
    assert diff.safety(diff.schema_changes(old, StructType.fromDDL("a int, b date, c int"))) == diff.ERROR
    assert [c.kind for c in diff.schema_changes(old, StructType.fromDDL("a int, b string, z int"), {"z": "c"})] == ["renamed"]
    summary = {"base_rows": 100, "added": 2, "removed": 0, "modified": 2}
    assert diff.evaluate(diff.Policy(10, 0, 5, 0.05), summary).passed
    assert not diff.evaluate(diff.Policy(max_changed_fraction=0.03), summary).passed
    assert not diff.evaluate(diff.Policy(max_added_rows=1), {}).passed
    assert not diff.evaluate(diff.Policy(require_keyed_diff=True), summary, "aggregate").passed


def test_quality_tests(spark):
    t = spark.createDataFrame([(1, "a"), (1, None), (2, " ")], "k int, s string")
    assert quality.unique(t, ["k"]).collect()[0].cnt == 2
    assert quality.not_null(t, "s").count() == 1 and quality.not_empty_string(t, "s").count() == 1
    assert quality.accepted_values(t, "s", ["a"]).count() == 1
    assert quality.equality(t, t.limit(2)).count() == 1 and quality.equality(t, t).count() == 0
    assert quality.run_test("x", quality.not_null(t, "s"), where="k = 2").status == "passed"
    assert quality.run_test("x", quality.not_null(t, "s")).status == "failed"
    assert quality.profile(t, ["k", "s"], [["k"]]) == {"not_null:k": 0, "not_null:s": 1, "unique:k": 1}


def test_seed_types(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,amount,flag,name,none,mixed\n1,2.5,true,"a, b",,1\n2,,FALSE,"say ""x""",,x\n')
    df = read_seed(spark, f"file://{tmp_path}/s.csv")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string", "string"]
    assert df.collect()[1].name == 'say "x"' and df.collect()[1].amount is None


# ---------------------------------------------------------------- store


def test_snapshots_branches_and_conflicts(spark, store):
    one = spark.range(3).toDF("id")
    store.record("main", {"s.t": store.write("s.t", one)})
    store.create_branch("feature/x")
    assert store.provenance("feature/x") == ("main", store.head().id)
    store.record("feature/x", {"s.t": store.appended("s.t", store.version("s.t"), spark.range(5, 6).toDF("other"))})
    assert store.table("s.t").count() == 3 and store.table("s.t", "feature/x").count() == 4
    with pytest.raises(StoreError):
        store.appended("s.t", store.version("s.t"), spark.range(1).selectExpr("id", "id AS b"))
    before = store.head().id
    store.merge("feature/x")
    assert store.table("s.t").count() == 4
    store.reset("main", before)
    store.record("main", {"s.t": store.write("s.t", spark.range(1).toDF("id"))})
    assert store.conflicts("feature/x", "main") == ["s.t"]
    with pytest.raises(Conflict):
        store.merge("feature/x")
    with pytest.raises(Conflict):
        store.record("main", {}, expected=before)
    with pytest.raises(StoreError):
        store.create_branch("feature/x")
    store.delete_branch("feature/x")
    assert set(store.branches()) == {"main"}
    assert branch_folder("a-b") != branch_folder("a/b")


def test_partitioned_versions_keep_other_folders(spark, store):
    rows = spark.createDataFrame([(1, "a b/c"), (2, "y"), (3, None)], "id int, p string")
    store.record("main", {"s.t": store.write("s.t", rows, ["p"])})
    old = store.version("s.t")
    new = store.with_partitions("s.t", old, spark.createDataFrame([(9, "y")], "id int, p string"))
    assert len(set(old.folders) & set(new.folders)) == 2
    assert {tuple(r) for r in store.read(new).collect()} == {(1, "a b/c"), (9, "y"), (3, None)}


def test_empty_tables_keep_their_schema(spark, store):
    store.record("main", {"s.e": store.write("s.e", spark.range(0).selectExpr("id", "'x' AS s"))})
    assert store.table("s.e").count() == 0 and store.table("s.e").columns == ["id", "s"]


# ---------------------------------------------------------------- projects


FILES = {
    "millrace.toml": '[transform]\ndefault_schema = "an"\n',
    T + "stg.sql": "-- @view\nselect id, v from src where v > 0",
    T + "mid.sql": "-- @ephemeral\nselect id, v * 2 as v from stg",
    T + "out.sql": "-- @table\n-- @key id\nselect id, sum(v) as v from mid group by id",
    T + "seeded.sql": "-- @table\nselect s.id, o.v from raw_x s join out o on o.id = s.id",
    "seeds/raw_x.csv": "id,amount\n1,2.5\n2,3\n",
    "tests/positive.sql": "select * from w.out where v < 0",
}


@pytest.fixture
def project(spark, workspace, tmp_path):
    data = {"rows": [(1, 1), (2, 2), (3, -3)]}

    def sources(relation):
        return spark.createDataFrame(data["rows"], "id int, v int") if relation.table in ("src", "ev") else None

    p = Project(spark, workspace(FILES), f"file://{tmp_path}/wh", sources)
    p.data, p.files = data, workspace
    return p


def statuses(result):
    return {m.last: o.status for m, o in result.models.items()}


def kinds(plan):
    return {m.last: a.kind for m, a in plan.actions.items()}


def test_build_skip_and_rebuild(project):
    r = project.run()
    assert r.status == "passed" and statuses(r) == {"stg": "passed", "mid": "skipped", "out": "passed", "seeded": "passed"}
    assert r.seeds == {"raw_x": "passed"} and r.tests["positive"].status == "passed"
    assert got(project.store.table("an.w__out")) == [(1, 2), (2, 4)]
    again = project.plan()
    assert again.summary() == {"build": 0, "cached": 0, "skip": 3, "inline": 1}
    project.files({**FILES, T + "mid.sql": "-- @ephemeral\nselect id, v * 3 as v from stg"})
    project.reload()
    plan = project.plan()
    assert kinds(plan) == {"stg": "skip", "mid": "inline", "out": "build", "seeded": "build"}
    assert plan.actions[ModelId.parse("w.out")].reasons == ["dependency_change"]
    project.apply(plan)
    assert got(project.store.table("an.w__out")) == [(1, 3), (2, 6)]
    with pytest.raises(RunError):
        project.apply(plan)  # the branch has moved


def test_failures_block_only_what_follows(project):
    project.files({**FILES, T + "out.sql": "-- @table\nselect id, cast(concat('x', cast(v as varchar)) as int) as v from mid", T + "free.sql": "-- @table\nselect 1 as k"})
    project.reload()
    r = project.run(retries=1)
    s = statuses(r)
    assert (s["out"], s["seeded"], s["free"], s["stg"]) == ("failed", "blocked", "passed", "passed")
    assert "CAST_INVALID_INPUT" in r.models[ModelId.parse("w.out")].message and r.tests["positive"].status == "blocked"
    project.files(FILES)
    project.reload()
    again = project.retry_failed(r.run)
    assert again.status == "passed" and statuses(again)["seeded"] == "passed"


def test_failing_test_fails_the_run(project):
    project.files({**FILES, "tests/none.sql": "select * from w.out where v > 0"})
    project.reload()
    r = project.run()
    assert r.status == "failed" and r.tests["none"].violations == 2
    assert project.test(["out"])["none"].status == "failed"


def test_drift_and_force(project, spark):
    project.run()
    project.store.record("main", {"an.w__out": project.store.write("an.w__out", spark.range(1).selectExpr("id", "id AS v"))})
    plan = project.plan()
    assert plan.actions[ModelId.parse("w.out")].reasons == ["output_drift"]
    assert set(kinds(project.plan(force=True)).values()) == {"build", "inline"}


def test_changed_sources_rebuild(spark, workspace, tmp_path):
    from millrace.plans.project import folder_sources, folder_states

    folder = f"file://{tmp_path}/src"
    spark.range(3).write.parquet(f"{folder}/ev.parquet")
    p = Project(spark, workspace({T + "m.sql": "-- @table\nselect count(*) as n from ev"}), f"file://{tmp_path}/wh", folder_sources(spark, folder), source_states=folder_states(spark, folder))
    assert p.run().status == "passed"
    p.reload()
    assert p.plan().summary()["skip"] == 1
    spark.range(3).write.mode("append").parquet(f"{folder}/ev.parquet")
    p.reload()
    assert p.plan().actions[ModelId.parse("w.m")].reasons == ["source_change"]
    p.run()
    assert got(p.store.table("w.m")) == [(6,)]


def test_resume_keeps_what_passed(project):
    r = project.run()
    project.state.finish_run(r.run, "cancelled", project.store.head().id)
    assert "failed" not in statuses(project.resume(r.run)).values()
    with pytest.raises(RunError):
        project.resume("none")


def test_incremental_strategies(project):
    project.files({**FILES, T + "app.sql": "-- @incremental append\nselect id, v from ev", T + "key.sql": "-- @incremental key=id\nselect id, v from ev", T + "part.sql": "-- @incremental partition=id\nselect id, v from ev", T + "win.sql": "-- @incremental window=id\nselect id, v from ev"})
    project.reload()
    project.run()
    project.data["rows"] = [(3, 30), (4, 40)]
    terms = ["app", "key", "part", "win"]
    assert project.run(terms, force=True).status == "passed"
    t = lambda n: got(project.store.table(f"an.w__{n}"))
    assert t("app") == [(1, 1), (2, 2), (3, -3), (3, 30), (4, 40)]
    assert t("key") == t("part") == [(1, 1), (2, 2), (3, 30), (4, 40)]
    assert t("win") == [(1, 1), (2, 2), (3, -3), (4, 40)]


def test_branch_adoption_gates_and_promotion(project):
    project.run()
    project.ensure("cand")
    assert set(kinds(project.plan(environment="cand")).values()) == {"cached", "inline"}
    project.files({**FILES, T + "out.sql": "-- @table\n-- @key id\nselect id, sum(v) + 1 as v from mid group by id"})
    project.reload()
    r = project.run(environment="cand")
    assert r.status == "passed" and statuses(r)["out"] == "passed" and statuses(r)["stg"] == "cached"
    before = project.store.head().id
    assert [g.name for g in evaluate_gates(project, "cand") if not g.passed] == ["schema"]
    found = branch_diff(project, "cand", deep=True)
    out = next(d for d in found.datasets if d.model == "w.out")
    assert out.status == "changed" and out.report["modified"] == 2 and found.of("unchanged") == ["w.stg"]
    assert all(g.passed for g in evaluate_gates(project, "cand", require_diff=True))
    promote(project, "cand", require_diff=True)
    assert got(project.store.table("an.w__out")) == [(1, 3), (2, 5)]
    assert project.plan().summary()["build"] == 0
    rollback(project, before)
    assert got(project.store.table("an.w__out")) == [(1, 2), (2, 4)]
    project.store.record("main", {}, "something else")
    assert [g.name for g in evaluate_gates(project, "cand") if not g.passed] == ["schema", "base"]
    with pytest.raises(RunError):
        promote(project, "cand")


def test_a_diff_that_lacks_a_changed_model_is_no_audit(project):
    project.run()
    project.ensure("cand")
    project.files({**FILES, T + "more.sql": "-- @table\nselect 1 as one"})
    project.reload()
    known = project.compiled.models.pop(ModelId.parse("w.more"))
    project.compiled.order.remove(known.id)
    project.runner("cand").store.record("cand", {known.target.key: project.store.write(known.target.key, project.spark.range(1))})
    branch_diff(project, "cand", deep=True)
    project.reload()
    schema = next(g for g in evaluate_gates(project, "cand") if g.name == "schema")
    assert not schema.passed and "doesn't cover w.more" in schema.detail
    assert "itself" in next(g for g in evaluate_gates(project, "main", "main") if g.name == "schema").detail


def test_late_models_are_timeouts(project):
    project.files({**FILES, T + "slow.sql": "-- @table\nselect count(*) as n from range(100000000000) a"})
    project.reload()
    r = project.run(["slow"], timeout=1.5)
    out = r.models[ModelId.parse("w.slow")]
    assert out.status == "failed" and out.kind == "timeout" and out.message.startswith("stopped after 1.5 s")


def test_branch_diffs_name_what_is_downstream(project):
    project.run()
    project.ensure("cand")
    project.files({**FILES, T + "out.sql": "-- @table\n-- @key id\nselect id, sum(v) + 1 as v from mid group by id"})
    project.reload()
    assert project.run(environment="cand").status == "passed"
    found = branch_diff(project, "cand", deep=True)
    assert found.impacts == {"w.out": ["w.seeded"], "w.seeded": []}
    out = next(d for d in found.datasets if d.model == "w.out")
    assert out.report["modified"] == 2 and out.base_rows == out.candidate_rows == 2


def test_contracts_are_enforced(project):
    project.files({**FILES, "millrace.toml": '[transform]\ndefault_schema = "an"\n[model."w.out".contract]\nenforced = true\n[model."w.out".columns.v]\ntype = "VARCHAR"\n'})
    project.reload()
    with pytest.raises(RunError, match="TYPE005"):
        project.run(["+out"])


@pytest.mark.parametrize(
    ("sql", "code"),
    [
        ("select id, nope from mid", "TYPE001"),
        ("select id from mid a join stg b on a.id = b.id", "TYPE002"),
        ("select id from mid union all select id, v from stg", "TYPE004"),
        ("select id, v, v as id from mid", "TYPE003"),
        ("select m.id, m.v + 1 as w from mid m", None),
    ],
)
def test_types_are_checked_before_anything_is_built(project, sql, code):
    project.files({**FILES, T + "out.sql": f"-- @table\n{sql}"})
    project.reload()
    found = [d for d in project.check() if d.where == "w.out"]
    assert [d.code for d in found] == ([code] if code else [])
    assert all(code in CODES for code in [d.code for d in found])
    if found and found[0].severity == "error":
        with pytest.raises(RunError, match=code):
            project.plan()
        assert project.plan(["stg"]).actions  # what doesn't need the model is planned
        assert not project.store.head().tables
    else:
        assert project.plan(["out"]).actions


def test_sources_have_states_by_default(spark, workspace, tmp_path):
    root = workspace({"millrace.toml": '[transform]\ndefault_schema = "a"\n', T + "m.sql": "-- @table\nselect id from src"})
    folder = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(f"{folder}/src.parquet")
    p = Project(spark, root, f"file://{tmp_path}/wh", folder_sources(spark, folder))
    p.run()
    p.reload()
    assert p.plan().actions[ModelId.parse("w.m")].reasons == ["unchanged"]
    spark.range(5).write.mode("append").parquet(f"{folder}/src.parquet")
    p.reload()
    assert p.plan().actions[ModelId.parse("w.m")].reasons == ["source_change"]


def test_plans_say_why(project):
    first = project.plan(["seeded"])
    out, stg = (first.actions[ModelId.parse(f"w.{m}")] for m in ("out", "stg"))
    assert stg.membership == out.membership == "dependency" and stg.reasons == ["missing_relation", "selected_dependency"]
    assert out.reasons == ["missing_relation", "selected_dependency"]
    project.apply(first)
    forced = project.plan(["+out"], force=True)
    assert forced.actions[ModelId.parse("w.out")].membership == "selected" and forced.actions[ModelId.parse("w.stg")].membership == "expanded"
    assert set(sum((a.reasons for a in forced.actions.values()), [])) <= set(REASONS)
    project.files({**FILES, T + "stg.sql": "-- @view\nselect id, v from src where v > 1"})
    plan = project.plan()
    project.reload()
    assert "w.stg changed" in staleness(plan, project.store, project.compiled)
    again = project.plan()
    assert again.actions[ModelId.parse("w.stg")].reasons == ["sql_semantic_change"]
    assert again.actions[ModelId.parse("w.out")].reasons == ["dependency_change"]
    assert again.actions[ModelId.parse("w.seeded")].reasons == ["dependency_change", "upstream_rebuild"]


def test_streaming_takes_every_file_once(spark, store, tmp_path):
    from millrace.streaming.windows import take_up

    folder, schema = f"file://{tmp_path}/in", StructType.fromDDL("id long")
    spark.range(3).write.parquet(f"{folder}/a")
    args = (spark, store, f"{folder}/*", schema, "s.t", f"file://{tmp_path}/cp")
    assert take_up(*args) == 1 and store.table("s.t").count() == 3
    assert take_up(*args) == 0
    spark.range(10, 12).write.parquet(f"{folder}/b")
    assert take_up(*args) == 1 and store.table("s.t").count() == 5


def test_all_violations_are_counted(spark):
    t = spark.range(2500).selectExpr("nullif(id, id) as s")
    assert quality.run_test("x", quality.not_null(t, "s")).violations == 2500


def test_a_replayed_batch_is_known_after_many_commits(spark, store, tmp_path):
    import shutil

    from millrace.streaming.windows import take_up

    spark.range(3).write.parquet(f"file://{tmp_path}/in/a")
    args = (spark, store, f"file://{tmp_path}/in/*", StructType.fromDDL("id long"), "s.t", f"file://{tmp_path}/cp")
    assert take_up(*args) == 1
    for _ in range(60):
        store.record("main", {}, "another writer")
    shutil.rmtree(f"{tmp_path}/cp/commits")  # as after a crash before the stream noted the batch
    assert take_up(*args) == 0 and store.table("s.t").count() == 3


def test_of_several_writers_none_is_lost(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: Store(spark, store.files.root).record("main", {f"t.{k}": store.view(f"SELECT {k} AS x")}), range(12)))
    assert set(Store(spark, store.files.root).head().tables) == {f"t.{k}" for k in range(12)}
    at = store.head().id
    with ThreadPoolExecutor(4) as pool:

        def claim(k):
            try:
                return Store(spark, store.files.root).record("main", {"t.won": store.view(f"SELECT {k} AS x")}, expected=at).id
            except Conflict:
                return None

        won = [x for x in pool.map(claim, range(6)) if x]
    assert len(won) == 1 and store.head().id == won[0]


def test_commits_keep_changes_only(spark, store, monkeypatch):
    for k in range(40):
        store.record("main", {f"t.{k % 7}": store.view(f"SELECT {k} AS x"), "t.gone": store.view("SELECT 0 AS x") if k % 2 else None})
    fresh = Store(spark, store.files.root)
    assert {n: v.sql for n, v in fresh.head().tables.items()} == {n: v.sql for n, v in store.head().tables.items()}
    assert len(fresh.ancestors(fresh.head().id)) == 41 and "t.gone" in fresh.head().tables
    sizes = [len(fresh.files.read("commits", c + ".json").get("changes", {})) for c in fresh.ancestors(fresh.head().id)]
    assert max(sizes) == 2 and sizes.count(0) == 2


def test_merge_rewrites_only_folders_that_hold_a_key(spark, store):
    first = spark.range(0, 100).selectExpr("id AS k", "'a' AS v")
    store.record("main", {"t": store.write("t", first)})
    store.record("main", {"t": store.appended("t", store.version("t"), spark.range(100, 200).selectExpr("id AS k", "'b' AS v"))})
    old = store.version("t")
    new = store.merged("t", old, spark.sql("SELECT * FROM VALUES (150L, 'c'), (300L, 'c'), (CAST(NULL AS BIGINT), 'c') AS t(k, v)"), ["k"])
    assert old.folders[0] in new.folders and old.folders[1] not in new.folders and len(new.folders) == 3
    assert got(store.read(new).groupBy("v").count(), "v", "count") == [("a", 100), ("b", 99), ("c", 3)]
    untouched = store.merged("t", old, spark.sql("SELECT 999L AS k, 'd' AS v"), ["k"])
    assert untouched.folders[:2] == old.folders
    with pytest.raises(materialize.DuplicateKeys):
        store.merged("t", old, spark.sql("SELECT * FROM VALUES (1L, 'x'), (1L, 'y') AS t(k, v)"), ["k"])


def test_a_window_table_carries_its_own_mark(spark, workspace, tmp_path):
    """The mark counts when the rows do: a build whose commit fails is taken up again from the old mark."""
    root = workspace({"millrace.toml": '[transform]\ndefault_schema = "a"\n', T + "e.sql": "-- @incremental window=ts\nSELECT id, ts FROM events"})
    rows = {"n": 3}
    sources = lambda relation: spark.range(rows["n"]).selectExpr("id", "timestamp_seconds(id * 3600) AS ts")
    project = Project(spark, root, "file://" + str(tmp_path / "wh"), sources)
    assert project.run().status == "passed"
    key = next(iter(project.store.head().tables))
    mark = project.store.version(key).watermark
    rows["n"] = 6
    record, project.store.record = project.store.record, lambda *a, **k: (_ for _ in ()).throw(OSError("lost"))
    assert project.run(force=True).status == "failed"
    project.store.record = record
    assert project.store.version(key).watermark == mark
    project.state.set_watermark("w.e", "main", {"timestamp": "2031-01-01T00:00:00"}, 0.0)
    assert project.run(force=True).status == "passed"
    assert project.store.table(key).count() == 6 and project.store.version(key).watermark != mark
