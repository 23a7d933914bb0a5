"""All queries of the engine: the relational catalogue and the data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import catalogue
from .operators import asof, diff, materialize, quality
from .plans.engine import run_sql
from .plans.compiler import compile_workspace
from .plans.contracts import diff_contracts
from .plans.graph import Graph
from .plans.project import Project, folder_sources
from .plans.selection import select
from .plans.workspace import Workspace
from .sources.seeds import read_seed
from .sources.store import Store
from .sources.tables import read_table
from .streaming.windows import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(catalogue.ORACLE)


def _relational(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run_sql(spark, folder, sql)


QUERIES |= {name: _relational(sql) for name, sql in catalogue.Q.items()}


def query(oracle: str) -> Callable:
    """Registers a function under its name, with its DuckDB equivalent."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle.strip()
        return f

    return keep


def _store(spark: SparkSession) -> Store:
    """A fresh store in the shared folder that the session names, or in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder: executors can't write where the driver reads")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-store-")
    return Store(spark, f"{root.rstrip('/')}/store-{spark.sparkContext.applicationId}-{next(_numbers)}")


_numbers = iter(range(1, 1 << 62))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders")


# ---------------------------------------------------------------- joins beyond SQL


@query("""
SELECT o_orderkey, e.value AS value FROM orders ASOF LEFT JOIN
  (SELECT user_id, ts, max(value) AS value FROM events GROUP BY user_id, ts) e ON o_custkey = e.user_id AND o_orderdate >= e.ts
""")
def asof_join(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    orders = _orders(spark, folder).withColumn("user_id", F.col("o_custkey"))
    return asof.asof_join(orders, events, ["user_id"], "o_orderdate", "ts", ["value"]).select("o_orderkey", "value")


# ---------------------------------------------------------------- materialisation


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def mat_table(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    store.record("main", {"shop.counts": store.write("shop.counts", run_sql(spark, folder, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"))})
    return store.table("shop.counts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def mat_view(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    store.record("main", {"shop.done": store.view("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")})
    return run_sql(spark, folder, store.version("shop.done").sql)


@query("SELECT o_orderkey, o_orderstatus, 'second' AS batch FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_orderstatus, 'first' FROM orders WHERE o_orderkey % 2 = 0")
def inc_append(spark: SparkSession, folder: str) -> DataFrame:
    rows = _orders(spark, folder).select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "first").otherwise("second").alias("batch"))
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", rows.where("batch = 'first'"))})
    store.record("main", {"t.orders": store.appended("t.orders", store.version("t.orders"), rows.where("batch = 'second'"))})
    return store.table("t.orders")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE o_orderstatus END AS status FROM orders
WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
""")
def inc_merge_key(spark: SparkSession, folder: str) -> DataFrame:
    first = _orders(spark, folder).where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    second = _orders(spark, folder).where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("updated").alias("status"))
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", first)})
    store.record("main", {"t.orders": store.merged("t.orders", store.version("t.orders"), second, ["o_orderkey"])})
    return store.table("t.orders")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 400 = 0 THEN 'updated' ELSE o_orderstatus END AS status FROM orders
""")
def inc_merge_key_folders(spark: SparkSession, folder: str) -> DataFrame:
    """A merge into a table of four folders, of which it meets one: the others stay as they are."""
    rows = _orders(spark, folder).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", rows.where("o_orderkey % 4 = 0"))})
    for k in (1, 2, 3):
        store.record("main", {"t.orders": store.appended("t.orders", store.version("t.orders"), rows.where(f"o_orderkey % 4 = {k}"))})
    old = store.version("t.orders")
    new = store.merged("t.orders", old, rows.where("o_orderkey % 400 = 0").withColumn("status", F.lit("updated")), ["o_orderkey"])
    if len(set(old.folders) & set(new.folders)) != 3:
        raise RuntimeError("folders without a merged key were written again")
    store.record("main", {"t.orders": new})
    return store.table("t.orders")


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority NOT LIKE '1%'
UNION ALL SELECT o_orderkey, o_orderpriority, 0.0::DOUBLE FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0
""")
def inc_replace_partition(spark: SparkSession, folder: str) -> DataFrame:
    rows = _orders(spark, folder).select("o_orderkey", "o_orderpriority", "o_totalprice")
    fresh = rows.where("o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", rows, ["o_orderpriority"])})
    store.record("main", {"t.orders": store.with_partitions("t.orders", store.version("t.orders"), fresh)})
    return store.table("t.orders")


_PARTS = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN 'a|b' WHEN 3 THEN 'a' ELSE '' END AS p, CASE o_orderkey % 5 WHEN 2 THEN 'c' WHEN 3 THEN 'b|c' ELSE 'x' END AS q"


@query(f"""
SELECT o_orderkey, p, q, 'old' AS batch FROM (SELECT o_orderkey, {_PARTS} FROM orders) WHERE p IS NOT NULL AND p <> 'a|b'
UNION ALL SELECT o_orderkey, p, q, 'new' FROM (SELECT o_orderkey, {_PARTS} FROM orders) WHERE (p IS NULL OR p = 'a|b') AND o_orderkey % 2 = 0
""")
def inc_replace_null_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Replacing the null partition leaves 'NULL' and '' alone, and ('a|b', 'c') leaves ('a', 'b|c') alone."""
    rows = _orders(spark, folder).selectExpr("o_orderkey", *_PARTS.replace(" AS p, ", " AS p@").split("@"))
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", rows.withColumn("batch", F.lit("old")), ["p", "q"])})
    fresh = rows.where("(p IS NULL OR p = 'a|b') AND o_orderkey % 2 = 0").withColumn("batch", F.lit("new"))
    store.record("main", {"t.orders": store.with_partitions("t.orders", store.version("t.orders"), fresh)})
    return store.table("t.orders")


def _window_batches(spark: SparkSession, folder: str, overlap: int | None) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id", "ts", "user_id")
    cut = events.agg(F.timestamp_seconds(F.floor(F.avg(F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600) * 3600).cast("timestamp_ntz").alias("cut")).first()["cut"]
    store = _store(spark)
    store.record("main", {"t.events": store.write("t.events", events.where(F.col("ts") <= F.lit(cut)))})
    high = materialize.watermark(store.table("t.events"), "ts")
    store.record("main", {"t.events": store.appended("t.events", store.version("t.events"), materialize.window_rows(events, "ts", high, overlap))})
    return store.table("t.events")


@query("SELECT event_id, ts, user_id FROM events WHERE ts IS NOT NULL")
def inc_time_window(spark: SparkSession, folder: str) -> DataFrame:
    return _window_batches(spark, folder, None)


_CUT = "(SELECT CAST(to_timestamp(floor(avg(epoch(ts)::BIGINT) / 3600) * 3600) AS TIMESTAMP) FROM events)"


@query(f"""
WITH high AS (SELECT max(ts) AS h FROM events WHERE ts <= {_CUT})
SELECT event_id, ts, user_id FROM events WHERE ts IS NOT NULL
UNION ALL SELECT event_id, ts, user_id FROM events, high WHERE ts > h - INTERVAL 86400 SECOND AND ts <= h
""")
def inc_time_window_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _window_batches(spark, folder, materialize.overlap_seconds("1d"))


@query("SELECT o_orderpriority AS partition, count(*) AS row_count FROM orders GROUP BY 1")
def partition_counts(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", _orders(spark, folder), ["o_orderpriority"])})
    return store.partition_counts("t.orders", columns=["o_orderpriority"])


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, chr(92) || 'N') AS partition, count(*) AS row_count FROM orders GROUP BY 1")
def partition_counts_nulls(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    store.record("main", {"t.orders": store.write("t.orders", _orders(spark, folder).selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS s"), ["s"])})
    return store.partition_counts("t.orders", columns=["s"])


# ---------------------------------------------------------------- quality tests


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL")
def test_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_null(_orders(spark, folder).selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS s"), "s").select("o_orderkey")


@query("SELECT o_custkey, o_orderstatus, count(*) AS cnt FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def test_unique_composite(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unique(_orders(spark, folder), ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL AND o_custkey IS NOT NULL")
def test_relationships(spark: SparkSession, folder: str) -> DataFrame:
    parents = read_table(spark, folder, "customer").where("c_custkey % 5 <> 0")
    return quality.relationships(_orders(spark, folder), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def test_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    return quality.accepted_values(_orders(spark, folder), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45")
def test_accepted_range(spark: SparkSession, folder: str) -> DataFrame:
    return quality.accepted_range(read_table(spark, folder, "lineitem"), "l_quantity", 5, 45).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 20000)")
def test_expression(spark: SparkSession, folder: str) -> DataFrame:
    return quality.expression_is_true(_orders(spark, folder), "o_totalprice > 20000").select("o_orderkey")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def test_not_constant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_constant(_orders(spark, folder), "o_orderstatus", ["o_custkey"])


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS s FROM customer) WHERE trim(s) = ''")
def test_not_empty_string(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_empty_string(read_table(spark, folder, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS s"), "s").select("c_custkey")


@query("""
(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)
""")
def test_equality(spark: SparkSession, folder: str) -> DataFrame:
    a = read_table(spark, folder, "customer").select(F.col("c_nationkey").alias("k"))
    return quality.equality(a, read_table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT * FROM (SELECT count(*) AS count_a FROM orders), (SELECT count(*) AS count_b FROM customer) WHERE count_a <> count_b")
def test_equal_rowcount(spark: SparkSession, folder: str) -> DataFrame:
    return quality.equal_rowcount(_orders(spark, folder), read_table(spark, folder, "customer"))


# ---------------------------------------------------------------- diffs


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders without every 11th key, and orders without every 13th, repriced where the key is a multiple of 7."""
    rows = _orders(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    return rows.where("o_orderkey % 11 <> 0"), rows.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", price).withColumn("o_orderstatus", status)


_SIDES = """
WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT b.o_orderkey AS bk, c.o_orderkey AS ck, b.o_totalprice IS DISTINCT FROM c.o_totalprice AS dp, b.o_orderstatus IS DISTINCT FROM c.o_orderstatus AS ds,
        b.o_orderpriority IS DISTINCT FROM c.o_orderpriority AS dq, abs(b.o_totalprice - c.o_totalprice) AS gap FROM b FULL JOIN c ON b.o_orderkey IS NOT DISTINCT FROM c.o_orderkey)
"""


@query(_SIDES + """
SELECT count(bk) AS base_rows, count(ck) AS candidate_rows, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ck IS NULL) AS removed,
  count(*) FILTER (bk IS NOT NULL AND ck IS NOT NULL AND (dp OR ds OR dq)) AS modified, count(*) FILTER (bk IS NOT NULL AND ck IS NOT NULL AND NOT (dp OR ds OR dq)) AS unchanged,
  count(*) FILTER (bk IS NOT NULL AND ck IS NOT NULL AND ds) AS changed_o_orderstatus, count(*) FILTER (bk IS NOT NULL AND ck IS NOT NULL AND dp) AS changed_o_totalprice,
  count(*) FILTER (bk IS NOT NULL AND ck IS NOT NULL AND dq) AS changed_o_orderpriority FROM j
""")
def diff_keyed(spark: SparkSession, folder: str) -> DataFrame:
    return diff.keyed_diff(*_sides(spark, folder), ["o_orderkey"])


@query(_SIDES + """
SELECT * FROM (SELECT 'o_orderstatus' AS column_name, count(*) FILTER (ds) AS changed FROM j WHERE bk IS NOT NULL AND ck IS NOT NULL
  UNION ALL SELECT 'o_totalprice', count(*) FILTER (dp) FROM j WHERE bk IS NOT NULL AND ck IS NOT NULL) WHERE changed > 0
""")
def diff_columns(spark: SparkSession, folder: str) -> DataFrame:
    return diff.column_changes(diff.keyed_diff(*_sides(spark, folder), ["o_orderkey"]))


@query(_SIDES + """
SELECT count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ck IS NULL) AS removed, count(*) FILTER (gap > 1.5) AS modified FROM j
""")
def diff_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    report = diff.keyed_diff(*_sides(spark, folder), ["o_orderkey"], ["o_totalprice"], {"o_totalprice": diff.Tolerance(absolute=1.5)})
    return report.select("added", "removed", "modified")


@query(_SIDES + """
SELECT coalesce(x.p, y.p) AS partition, CASE WHEN x.p IS NULL THEN 'added' WHEN y.p IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(x.n, 0) AS base_rows, coalesce(y.n, 0) AS candidate_rows
FROM (SELECT o_orderpriority AS p, count(*) AS n FROM b GROUP BY 1) x FULL JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM c GROUP BY 1) y ON x.p = y.p
WHERE x.n IS DISTINCT FROM y.n
""")
def diff_partition(spark: SparkSession, folder: str) -> DataFrame:
    return diff.partition_diff(*_sides(spark, folder), ["o_orderpriority"])


@query("""
SELECT o_orderstatus AS partition, 'changed' AS status, 2 * count(*) AS base_rows, 2 * count(*) AS candidate_rows FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1
""")
def diff_partition_content(spark: SparkSession, folder: str) -> DataFrame:
    """Every row stands twice on both sides; those of two partitions have changed, with the same counts."""
    rows = _orders(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice")
    twice = rows.unionByName(rows)
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return diff.partition_diff(twice, twice.withColumn("o_totalprice", price), ["o_orderstatus"], content=True)


@query(_SIDES + "SELECT (SELECT count(*) FROM b) AS base_rows, (SELECT count(*) FROM c) AS candidate_rows")
def diff_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return diff.aggregate_diff(*_sides(spark, folder))


@query(_SIDES + "SELECT count(*) FILTER (bk IS NULL) <= 100000 AND (count(*) FILTER (bk IS NULL OR ck IS NULL OR dp OR ds OR dq))::DOUBLE / count(bk) <= 0.05 AS passed FROM j")
def diff_policy(spark: SparkSession, folder: str) -> DataFrame:
    report = diff.keyed_diff(*_sides(spark, folder), ["o_orderkey"])
    verdict = diff.evaluate(diff.Policy(max_added_rows=100000, max_changed_fraction=0.05), report.first().asDict())
    return spark.createDataFrame([(verdict.passed,)], "passed boolean")


@query(_SIDES + """
SELECT count(*) FILTER (bk IS NULL) > 0 AS some_added, count(*) FILTER (ck IS NULL) > 0 AS some_removed, true AS same_keys, true AS close FROM j
""")
def diff_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the keys of two different sides: the same keys of both, and shares near those of all keys."""
    base, candidate = _sides(spark, folder)
    a, b = (diff.key_sample(x, ["o_orderkey"], 10) for x in (base, candidate.repartition("o_totalprice")))
    part = diff.keyed_diff(a, b, ["o_orderkey"]).select(*[F.col(c).alias(f"part_{c}") for c in ("base_rows", "added", "removed", "modified")])
    whole = diff.keyed_diff(base, candidate, ["o_orderkey"]).select("base_rows", "added", "removed", "modified")
    # A key that is in both tables is in both samples: what the samples miss of one another the tables miss too.
    lost = a.join(candidate, "o_orderkey", "left_semi").join(b, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    near = F.lit(True)
    for c in ("base_rows", "added", "removed", "modified"):
        near = near & F.col(f"part_{c}").between(0.05 * F.col(c) - 10, 0.15 * F.col(c) + 10)
    one = part.crossJoin(whole).crossJoin(lost)  # three tables of one row
    return one.select((F.col("part_added") > 0).alias("some_added"), (F.col("part_removed") > 0).alias("some_removed"), (F.col("lost") == 0).alias("same_keys"), near.alias("close"))


# ---------------------------------------------------------------- a whole workspace

_SHOP = {
    "millrace.toml": '[transform]\ndefault_schema = "analytics"\n',
    "workflows/shop/transforms/stg_orders.sql": "-- @view\nSELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 0",
    "workflows/shop/transforms/big_orders.sql": "-- @ephemeral\nSELECT * FROM stg_orders WHERE o_totalprice > 1000",
    "workflows/shop/transforms/orders_by_customer.sql": "-- @table\n-- @key o_custkey\nSELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big_orders GROUP BY 1",
    "workflows/shop/transforms/top_segments.sql": "-- @table\n-- @not-null c_mktsegment\nSELECT c.c_mktsegment, count(*) AS customers, max(b.n) AS most_orders, max(b.top) AS top FROM orders_by_customer b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY 1",
}
_SHOP_SQL = """
SELECT c.c_mktsegment, count(*) AS customers, max(b.n) AS most_orders, max(b.top) AS top
FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1) b
JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY 1
"""


def _shop() -> str:
    return _written(_SHOP)


def _written(files: dict[str, str]) -> str:
    """A workspace folder on the driver: models are compiled there."""
    root = tempfile.mkdtemp(prefix="millrace-shop-")
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(content)
    return root


@query(_SHOP_SQL)
def workspace_build(spark: SparkSession, folder: str) -> DataFrame:
    """Three models and an ephemeral one, compiled, planned, built and tested; the last one's rows."""
    store = _store(spark)
    project = Project(spark, _shop(), store.files.root, folder_sources(spark, folder))
    result = project.run()
    if result.status != "passed":
        raise RuntimeError(f"the build {result.status}: {result.models} {result.tests}")
    return project.store.table("analytics.shop__top_segments")


@query("SELECT * FROM (VALUES ('first', 'build', 3), ('first', 'inline', 1), ('second', 'skip', 3), ('second', 'inline', 1)) t(round, action, n)")
def plan_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """How the plan of an unchanged workspace differs before and after a run."""
    project = Project(spark, _shop(), _store(spark).files.root, folder_sources(spark, folder))
    rows = []
    for label in ("first", "second"):
        plan = project.plan()
        rows += [(label, kind, n) for kind, n in plan.summary().items() if n]
        project.apply(plan)
    return spark.createDataFrame(rows, "round string, action string, n int")


@query("SELECT * FROM (VALUES ('first', 'shop.counts', 'missing_relation'), ('same', 'shop.counts', 'unchanged'), ('changed', 'shop.counts', 'source_change'), ('after', 'shop.counts', 'unchanged')) t(round, model, reason)")
def plan_source_change(spark: SparkSession, folder: str) -> DataFrame:
    """A source's files change; the plan sees it from the file system alone."""
    store = _store(spark)
    raw = store.files.at("raw")
    orders = _orders(spark, folder).select("o_custkey")
    orders.where("o_custkey % 2 = 0").write.parquet(f"{raw}/orders.parquet")
    project = Project(spark, _written({"millrace.toml": '[transform]\ndefault_schema = "a"\n', "workflows/shop/transforms/counts.sql": "-- @table\nSELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"}), store.files.root, folder_sources(spark, raw))
    rows = []
    for label in ("first", "same", "changed", "after"):
        if label == "changed":
            orders.where("o_custkey % 2 = 1").write.mode("append").parquet(f"{raw}/orders.parquet")
        project.reload()
        plan = project.plan()
        rows += [(label, m.name, a.reasons[0]) for m, a in plan.actions.items()]
        project.apply(plan)
    return spark.createDataFrame(rows, "round string, model string, reason string")


@query("SELECT * FROM (VALUES ('shop.ambiguous', 'TYPE002', 'error'), ('shop.contract', 'TYPE005', 'error'), ('shop.twice', 'TYPE003', 'warning'), ('shop.unknown', 'TYPE001', 'error'), ('shop.width', 'TYPE004', 'error')) t(model, code, severity)")
def type_check(spark: SparkSession, folder: str) -> DataFrame:
    """What ``check`` finds in the types of five wrong models and a right one."""
    files = {
        "millrace.toml": '[transform]\ndefault_schema = "a"\n[model."shop.contract".contract]\nenforced = true\n[model."shop.contract".columns.o_orderkey]\ntype = "VARCHAR"\n',
        "workflows/shop/transforms/base.sql": "SELECT o_orderkey, o_custkey FROM orders",
        "workflows/shop/transforms/unknown.sql": "SELECT nothing FROM base",
        "workflows/shop/transforms/ambiguous.sql": "SELECT o_custkey FROM base a JOIN orders b ON a.o_orderkey = b.o_orderkey",
        "workflows/shop/transforms/twice.sql": "SELECT o_orderkey, o_custkey AS o_orderkey FROM base",
        "workflows/shop/transforms/width.sql": "SELECT o_orderkey FROM base UNION ALL SELECT o_orderkey, o_custkey FROM base",
        "workflows/shop/transforms/contract.sql": "SELECT o_orderkey FROM base",
    }
    found = Project(spark, _written(files), _store(spark).files.root, folder_sources(spark, folder)).check()
    return spark.createDataFrame([(d.where, d.code, d.severity) for d in found], "model string, code string, severity string")


@query("SELECT * FROM (VALUES (1, 'shop.stg_orders'), (2, 'shop.big_orders'), (3, 'shop.orders_by_customer'), (4, 'shop.top_segments')) t(place, model)")
def topo_order(spark: SparkSession, folder: str) -> DataFrame:
    order = compile_workspace(Workspace.load(_shop())).order
    return spark.createDataFrame([(k, m.name) for k, m in enumerate(order, 1)], "place int, model string")


@query("SELECT 'a -> b -> c -> a' AS path")
def cycle_path(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(" -> ".join(Graph({"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"]}).cycle()),)], "path string")


@query("""
SELECT * FROM (VALUES ('c_mktsegment', 'customer.c_mktsegment', 'DIRECT:IDENTITY'), ('c_mktsegment', 'customer.c_mktsegment', 'INDIRECT:GROUP_BY'),
  ('most_orders', 'shop.orders_by_customer.n', 'DIRECT:AGGREGATION'), ('top', 'shop.orders_by_customer.top', 'DIRECT:AGGREGATION')) t(output, source, how)
""")
def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Column edges into the last model: the direct ones, and the grouping key's onto itself."""
    from .plans.analysis import Analyzer
    from .plans.lineage import LineageGraph

    compiled = compile_workspace(Workspace.load(_shop()))
    find = folder_sources(spark, folder)
    graph = LineageGraph.build(compiled, Analyzer(spark, compiled, lambda r: find(r).schema).run())
    rows = graph.edges_frame(spark).where("kind = 'derives' AND source_kind = 'column' AND target LIKE 'shop.top_segments.%'")
    rows = rows.select(F.substring_index("target", ".", -1).alias("output"), "source", F.col("detail").alias("how"))
    return rows.where("how LIKE 'DIRECT%' OR (output = 'c_mktsegment' AND how = 'INDIRECT:GROUP_BY')")


@query("SELECT * FROM (VALUES ('added', 'c', 'safe'), ('nullability_changed', 'a', 'breaking'), ('removed', 'b', 'breaking'), ('type_changed', 'a', 'review')) t(kind, column_name, severity)")
def contract_changes(spark: SparkSession, folder: str) -> DataFrame:
    old = {"enforced": True, "columns": {"a": ["INTEGER", False], "b": ["VARCHAR", None]}, "renames": {}}
    new = {"enforced": True, "columns": {"a": ["BIGINT", True], "c": ["DOUBLE", None]}, "renames": {}}
    return spark.createDataFrame([(c.kind, c.column, c.severity) for c in diff_contracts(old, new)], "kind string, column_name string, severity string")


# ---------------------------------------------------------------- seeds, schemas, contracts and graphs


@query("""
SELECT c_custkey, c_custkey % 2 = 0 AS even, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'name ' || c_custkey END AS label FROM customer
""")
def seed_typed(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as CSV and read as a seed: bigint, boolean, double and string come back, empty is null."""
    rows = read_table(spark, folder, "customer").selectExpr("c_custkey", "c_custkey % 2 = 0 AS even", "c_acctbal AS balance", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('name ', c_custkey) END AS label")
    path = _store(spark).files.at("seed")
    rows.write.csv(path, header=True, escape='"')
    return read_seed(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey || ', \"' || c_mktsegment || '\"' END AS label, NULL::VARCHAR AS nothing FROM customer")
def seed_text(spark: SparkSession, folder: str) -> DataFrame:
    """Without inference all columns are text; commas and quotes in values survive, a column without values is text."""
    rows = read_table(spark, folder, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(c_custkey, ', \"', c_mktsegment, '\"') END AS label", "CAST(NULL AS STRING) AS nothing")
    path = _store(spark).files.at("seed")
    rows.write.csv(path, header=True, escape='"')
    return read_seed(spark, path, infer=False)


@query("""
SELECT * FROM (VALUES ('added', 'maybe', 'safe'), ('added', 'sure', 'review'), ('removed', 'gone', 'full_rebuild_required'), ('renamed', 'label', 'review'), ('type_changed', 'n', 'review'),
  ('type_changed', 's', 'error'), ('nullability_changed', 'k', 'safe')) t(kind, column_name, safety)
""")
def schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    old = StructType.fromDDL("k bigint not null, n int, s string, gone int, name string")
    new = StructType.fromDDL("k bigint, n bigint, s boolean, maybe int, sure int not null, label string")
    return spark.createDataFrame([(c.kind, c.column, c.safety) for c in diff.schema_changes(old, new, {"label": "name"})], "kind string, column_name string, safety string")


@query("""
SELECT * FROM (VALUES ('shop.loose', 'warning', 'column missing_one is missing'), ('shop.strict', 'error', 'column missing_one is missing'), ('shop.strict', 'error', 'column n is bigint, the contract says string'),
  ('shop.strict', 'error', 'column top may be null')) t(model, severity, message)
""")
def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """An enforced contract's violations are errors, another's warnings."""
    strict = '[model."shop.strict".contract]\nenforced = true\n[model."shop.strict".columns.missing_one]\ntype = "BIGINT"\n[model."shop.strict".columns.n]\ntype = "VARCHAR"\n[model."shop.strict".columns.top]\nnullable = false\n'
    config = strict + '[model."shop.loose".columns.missing_one]\ntype = "BIGINT"\n'
    sql = "SELECT o_custkey, count(*) AS n, max(nullif(o_totalprice, 0)) AS top FROM orders GROUP BY 1"
    files = {"millrace.toml": '[transform]\ndefault_schema = "a"\n' + config, "workflows/shop/transforms/strict.sql": sql, "workflows/shop/transforms/loose.sql": sql}
    found = Project(spark, _written(files), _store(spark).files.root, folder_sources(spark, folder)).check()
    return spark.createDataFrame([(d.where, d.severity, d.message) for d in found if d.code == "TYPE005"], "model string, severity string, message string")


@query("SELECT * FROM (VALUES ('unfiltered', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 20000)), ('filtered', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 20000 AND o_orderstatus = 'F'))) t(test, violations)")
def test_where_filters_violations(spark: SparkSession, folder: str) -> DataFrame:
    bad = quality.expression_is_true(_orders(spark, folder), "o_totalprice > 20000")
    return spark.createDataFrame([("unfiltered", quality.run_test("t", bad).violations), ("filtered", quality.run_test("t", bad, "o_orderstatus = 'F'").violations)], "test string, violations long")


@query("""
SELECT * FROM (VALUES ('+orders_by_customer', 'shop.big_orders'), ('+orders_by_customer', 'shop.orders_by_customer'), ('+orders_by_customer', 'shop.stg_orders'),
  ('big_orders+', 'shop.big_orders'), ('big_orders+', 'shop.orders_by_customer'), ('big_orders+', 'shop.top_segments'), ('shop.*', 'shop.big_orders'), ('shop.*', 'shop.orders_by_customer'),
  ('shop.*', 'shop.top_segments'), ('top_segments', 'shop.top_segments')) t(term, model)
""")
def selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Selections by name, with what they need and with what needs them, and of a namespace without one model."""
    compiled = compile_workspace(Workspace.load(_shop()))
    rows = [(term, i.name) for term in ("top_segments", "+orders_by_customer", "big_orders+") for i in select(compiled, [term])]
    rows += [("shop.*", i.name) for i in select(compiled, ["shop.*"], ["stg_orders"])]
    return spark.createDataFrame(rows, "term string, model string")


@query("SELECT * FROM (VALUES ('edge removed', 'shop.top_segments.top'), ('node added', 'shop.top_segments.lowest'), ('node removed', 'shop.top_segments.top')) t(change, node)")
def lineage_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The lineage graphs of a workspace before and after one column gives way to another."""
    from .plans.analysis import Analyzer
    from .plans.lineage import LineageGraph, lineage_diff

    find = folder_sources(spark, folder)

    def graph(files: dict[str, str]) -> LineageGraph:
        compiled = compile_workspace(Workspace.load(_written(files)))
        return LineageGraph.build(compiled, Analyzer(spark, compiled, lambda r: find(r).schema).run())

    name = "workflows/shop/transforms/top_segments.sql"
    found = lineage_diff(graph(_SHOP), graph(_SHOP | {name: _SHOP[name].replace("max(b.top) AS top", "min(b.n) AS lowest")}))
    rows = [("node added", n.name) for n in found.nodes_added] + [("node removed", n.name) for n in found.nodes_removed]
    rows += [("edge removed", e.target.name) for e in found.edges_removed if e.target.name.endswith(".top")]
    return spark.createDataFrame(sorted(set(rows)), "change string, node string")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return windowed_counts(events, "ts", "1 hour", ("event_type",)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
