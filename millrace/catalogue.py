"""Relational queries in model SQL, each with its DuckDB equivalent.

``Q[name]`` is the model SQL, run through the dialect bridge; where DuckDB
reads the same text the oracle is that text, else ``ORACLE[name]``.
"""

from __future__ import annotations

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

Q: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, oracle: str | None = None) -> None:
    Q[name] = sql.strip()
    ORACLE[name] = (oracle or sql).strip()


# ------------------------------------------------------------ projections and filters

_add("scan_project_alias", 'SELECT o_orderkey AS "order id", o_totalprice * 2 AS doubled, upper(o_orderstatus) AS status, o_orderdate FROM orders')
_add("star_all", "SELECT * FROM nation")
_add("star_qualified", "SELECT n.*, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("star_except", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
_add("derived_table", "SELECT x.k AS k, x.v + 1 AS v FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) x WHERE x.v > 3")
_add("nested_join_scan", "SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
_add("where_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_discount <= 0.05) OR (l_returnflag <> 'N' AND NOT l_tax >= 0.06)")
_add("xor_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 XOR l_discount > 0.05", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25) <> (l_discount > 0.05)")
_add("unary_ops", "SELECT o_orderkey, -o_totalprice AS negative, +o_custkey AS positive, NOT (o_totalprice > 1000) AS small FROM orders")
_add("in_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 13, 17) OR p_retailprice BETWEEN 900 AND 1000 OR p_type LIKE '%A%' OR p_brand ILIKE 'brand#1%'")
_add("similar_to", "SELECT p_partkey, p_brand FROM part WHERE p_brand SIMILAR TO 'Brand#[1-3]%'", "SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].*')")
_add("null_predicates", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS is_f, (nullif(o_orderstatus, 'F') = 'O') IS UNKNOWN AS unknown, (o_totalprice > 1000) IS TRUE AS big, (o_totalprice > 1000) IS NOT FALSE AS not_small FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS is_f, (nullif(o_orderstatus, 'F') = 'O') IS NULL AS unknown, (o_totalprice > 1000) IS NOT DISTINCT FROM true AS big, (o_totalprice > 1000) IS DISTINCT FROM false AS not_small FROM orders")
_add("is_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS differs, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS same FROM orders")
_add("exists_subquery", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
_add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
_add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
_add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
_add("cast_try_cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, TRY_CAST(o_orderstatus AS INTEGER) AS bad, o_custkey::DOUBLE AS d, CAST(o_orderdate AS DATE) AS day, CAST('12' AS BIGINT) AS n FROM orders")
_add("typed_literals", "SELECT o_orderkey, DATE '2024-02-29' AS d, TIMESTAMP '2024-01-01 12:30:00' AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
_add("literals", "SELECT r_regionkey, 7 AS i, CAST(1.5 AS DOUBLE) AS d, 'it''s' AS s, TRUE AS b, CAST(NULL AS INTEGER) AS n FROM region")
_add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("values_inline", "SELECT v.k AS k, v.name AS name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(k, name)")

# ------------------------------------------------------------ joins

_add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 50000")
_add("join_right", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
_add("join_full", "SELECT a.k AS a_k, b.k AS b_k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_add("join_using", "SELECT k, a.v AS a_v, b.w AS b_w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT c_nationkey AS k, c_custkey AS w FROM customer) b USING (k)")
_add("join_natural", "SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b")
_add("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
_add("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_add("join_anti_idiom", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
_add("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
_add("join_nullsafe", "SELECT a.o_orderkey AS a_key, b.n AS n FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) a JOIN (SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders GROUP BY 1) b ON a.s IS NOT DISTINCT FROM b.s")
_add("join_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber AND x.l_quantity > 10)")
_add("join_self_ephemeral", "WITH e AS (SELECT o_custkey AS customer_id, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.customer_id AS customer_id, a.n AS n, b.n AS same FROM e a JOIN e b ON a.customer_id = b.customer_id")
_add("join_multi", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")

# ------------------------------------------------------------ aggregates

_add("agg_basic", f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS sum_qty, {MONEY.format('l_extendedprice')} AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, count(l_tax) AS n_tax FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_global", "SELECT count(*) AS n, min(o_orderdate) AS first_day, max(o_totalprice) AS top FROM orders")
_add("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
_add("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_totalprice < 100000) AS top_small FROM orders GROUP BY o_custkey")
_add("count_if", "SELECT o_orderpriority, count_if(o_totalprice > 50000) AS big FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(count_if(o_totalprice > 50000) AS BIGINT) AS big FROM orders GROUP BY o_orderpriority")
_add("bool_aggs", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p, every(o_orderkey > 0) AS pos FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_orderkey > 0) AS pos FROM orders GROUP BY o_custkey")
_add("stddev_variance", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 5) AS v, round(stddev_pop(l_quantity), 6) AS sp, round(var_pop(l_quantity), 5) AS vp, round(stddev_samp(l_tax), 8) AS ss, round(var_samp(l_tax), 8) AS vs FROM lineitem GROUP BY l_returnflag")
_add("min_max_any", "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi, arbitrary(n_regionkey) AS one FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi, any_value(n_regionkey) AS one FROM nation GROUP BY n_regionkey")
_add("array_agg_sorted", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names, cardinality(array_agg(n_nationkey)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names, CAST(len(array_agg(n_nationkey)) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
_add("listagg_sorted", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
_add("having_duplicates", "SELECT o_custkey, o_orderstatus, count(*) AS cnt FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1")
_add("group_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
_add("group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
_add("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_add("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_add("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_add("approx_distinct_bounds", "SELECT o_orderstatus, approx_distinct(o_custkey) BETWEEN count(DISTINCT o_custkey) * 0.8 AND count(DISTINCT o_custkey) * 1.2 AS close FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
_add("approx_percentile_bounds", "SELECT l_returnflag, approx_percentile(l_quantity, 0.5) BETWEEN 20 AND 31 AS close FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
_add("hll_sketch_bounds", "SELECT hll_sketch_estimate(approx_set(o_custkey)) BETWEEN 0.8 * count(DISTINCT o_custkey) AND 1.2 * count(DISTINCT o_custkey) AS close FROM orders", "SELECT true AS close")
_add("checksum_duplicates", "SELECT (SELECT checksum(x) FROM (VALUES (1), (1)) t(x)) = (SELECT checksum(x) FROM (VALUES (2), (2)) t(x)) AS same_pairs, (SELECT checksum(x) FROM (VALUES (1), (2), (2)) t(x)) = (SELECT checksum(x) FROM (VALUES (2), (1), (2)) t(x)) AS same_bags, (SELECT checksum(x) FROM (VALUES (1)) t(x)) = (SELECT checksum(x) FROM (VALUES (1), (2), (2)) t(x)) AS same_without_pairs", "SELECT false AS same_pairs, true AS same_bags, false AS same_without_pairs")
_add("hll_merge_bounds", "SELECT cardinality(merge(s)) BETWEEN 0.8 * max(n) AND 1.2 * max(n) AS close FROM (SELECT approx_set(o_custkey) AS s, (SELECT count(DISTINCT o_custkey) FROM orders) AS n FROM orders GROUP BY o_orderstatus) x", "SELECT true AS close")
_add("array_agg_nulls", "SELECT n_regionkey, cardinality(array_agg(nullif(n_nationkey % 3, 0))) AS n, cardinality(array_agg(n_name) FILTER (WHERE n_nationkey > 3)) AS later, array_join(array_sort(array_agg(DISTINCT n_regionkey)), ',') AS regions FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(array_agg(nullif(n_nationkey % 3, 0))) AS INTEGER) AS n, CAST(coalesce(len(array_agg(n_name) FILTER (n_nationkey > 3)), 0) AS INTEGER) AS later, array_to_string(list_sort(array_agg(DISTINCT n_regionkey)), ',') AS regions FROM nation GROUP BY n_regionkey")
_add("checksum_agrees", "SELECT (SELECT checksum(o_orderkey) FROM orders) = (SELECT checksum(k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice) x) AS agrees", "SELECT true AS agrees")

# ------------------------------------------------------------ windows

_add("win_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
_add("win_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders")
_add("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2 FROM orders")
_add("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("win_percent_cume", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 8) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 8) AS cd FROM orders")
_add("win_agg", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running_max FROM orders")
_add("win_frame_rows", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS q3 FROM lineitem")
_add("win_frame_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM lineitem")
_add("win_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)")
_add("win_global_max", "SELECT s_suppkey, max(s_acctbal) OVER () AS top FROM supplier")
_add("qualify_topk", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
_add("qualify_alias", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM orders WHERE o_totalprice > 1000 QUALIFY rn = 1")
_add("qualify_grouped", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) = 1")

# ------------------------------------------------------------ order, limit, sets, CTEs

_add("order_limit_offset", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber OFFSET 5 ROWS FETCH FIRST 20 ROWS ONLY", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5")
_add("order_ordinal_nulls", "SELECT nullif(o_orderstatus, 'F') AS s, o_orderkey FROM orders ORDER BY 1 NULLS FIRST, 2 DESC LIMIT 50")
_add("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_add("sample_share", "SELECT count(*) BETWEEN 0.05 * (SELECT count(*) FROM lineitem) AND 0.15 * (SELECT count(*) FROM lineitem) AS close, count(DISTINCT l_orderkey) > 1 AS spread FROM lineitem TABLESAMPLE BERNOULLI (10)", "SELECT true AS close, true AS spread")
_add("sample_full", "SELECT count(*) AS n FROM orders TABLESAMPLE BERNOULLI (100)", "SELECT count(*) AS n FROM orders")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_add("except_all", "SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
_add("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT k, n FROM a WHERE n > 5) SELECT b.k AS k, b.n AS n, c.c_name AS name FROM b JOIN customer c ON c.c_custkey = b.k")
_add("cte_shadow", "WITH nation AS (SELECT 1 AS n_nationkey, 'shadow' AS n_name) SELECT n_nationkey, n_name FROM nation")
_add("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
_add("unnest_array", "SELECT n_nationkey, x FROM nation CROSS JOIN UNNEST(ARRAY[n_nationkey, n_nationkey * 10]) AS u(x)", "SELECT n_nationkey, unnest([n_nationkey, n_nationkey * 10]) AS x FROM nation")
_add("unnest_ordinality", "SELECT n_nationkey, x, i FROM nation CROSS JOIN UNNEST(ARRAY['a', 'b', n_name]) WITH ORDINALITY AS u(x, i)", "SELECT n_nationkey, unnest(['a', 'b', n_name]) AS x, CAST(unnest([1, 2, 3]) AS BIGINT) AS i FROM nation")
_add("unnest_embeddings", "SELECT vec_id, max(x) AS top FROM embeddings CROSS JOIN UNNEST(embedding) AS u(x) GROUP BY vec_id", "SELECT vec_id, list_max(embedding) AS top FROM embeddings")
_add("lateral_subquery", "SELECT c.c_custkey, t.top FROM customer c CROSS JOIN LATERAL (SELECT max(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t")
_add("table_function", "SELECT x FROM generate_series(1, 20, 3) AS t(x)", "SELECT CAST(x AS INTEGER) AS x FROM generate_series(1, 20, 3) AS t(x)")

# ------------------------------------------------------------ scalar functions

_add("str_functions", "SELECT n_nationkey, concat(n_name, '-', CAST(n_regionkey AS VARCHAR)) AS c, lower(n_name) AS lo, upper(n_name) AS up, substr(n_name, 2, 3) AS s1, substring(n_name, 2) AS s2, trim('  x ') AS t1, ltrim('  x') AS t2, rtrim('x  ') AS t3, replace(n_name, 'A', '_') AS r, format('%s:%s', n_name, n_regionkey) AS f, n_name || '!' AS bang FROM nation", "SELECT n_nationkey, concat(n_name, '-', CAST(n_regionkey AS VARCHAR)) AS c, lower(n_name) AS lo, upper(n_name) AS up, substr(n_name, 2, 3) AS s1, substring(n_name, 2) AS s2, trim('  x ') AS t1, ltrim('  x') AS t2, rtrim('x  ') AS t3, replace(n_name, 'A', '_') AS r, format('{}:{}', n_name, n_regionkey) AS f, n_name || '!' AS bang FROM nation")
_add("str_syntax", "SELECT n_nationkey, SUBSTRING(n_name FROM 2 FOR 3) AS s, TRIM(BOTH 'A' FROM n_name) AS t, length(n_name) AS n, strpos(n_name, 'A') AS p FROM nation", "SELECT n_nationkey, SUBSTRING(n_name FROM 2 FOR 3) AS s, TRIM(BOTH 'A' FROM n_name) AS t, CAST(length(n_name) AS INTEGER) AS n, strpos(n_name, 'A') AS p FROM nation")
_add("date_functions", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_trunc('month', o_orderdate) AS m, o_orderdate + INTERVAL '3' DAY AS later, format_datetime(o_orderdate, 'yyyy-MM-dd') AS f, last_day(CAST(o_orderdate AS DATE)) AS eom FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_orderdate + INTERVAL '3' DAY AS later, strftime(o_orderdate, '%Y-%m-%d') AS f, last_day(CAST(o_orderdate AS DATE)) AS eom FROM orders")
_add("date_diff_parts", "SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-03-15 12:00:00', o_orderdate) AS days, date_diff('month', TIMESTAMP '1995-03-15 12:00:00', o_orderdate) AS months, date_diff('year', TIMESTAMP '1995-03-15 12:00:00', o_orderdate) AS years FROM orders")
_add("extract_parts", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q FROM orders")
_add("math_functions", "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(sign(o_totalprice) AS DOUBLE) AS s, CAST(truncate(o_totalprice) AS DOUBLE) AS t, o_orderkey % 7 AS m, o_orderkey / 4 AS q FROM orders", "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(sign(o_totalprice) AS DOUBLE) AS s, CAST(trunc(o_totalprice) AS DOUBLE) AS t, o_orderkey % 7 AS m, o_orderkey / 4 AS q FROM orders")
_add("round_half", "SELECT l_orderkey, l_linenumber, round(l_quantity / 4, 1) AS r FROM lineitem")
_add("greatest_least_nulls", "SELECT o_orderkey, greatest(o_custkey, nullif(o_orderkey % 4, 0)) AS g, least(o_custkey, nullif(o_orderkey % 4, 0), 7) AS l FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_custkey IS NULL THEN NULL ELSE greatest(o_custkey, o_orderkey % 4) END AS g, CASE WHEN o_orderkey % 4 = 0 OR o_custkey IS NULL THEN NULL ELSE least(o_custkey, o_orderkey % 4, 7) END AS l FROM orders")
_add("multi_alias", "SELECT n_nationkey, ROW(n_regionkey, n_nationkey % 2) AS (region, odd) FROM nation", "SELECT n_nationkey, n_regionkey AS region, n_nationkey % 2 AS odd FROM nation")
_add("multi_alias_generator", "SELECT n_nationkey, stack(2, n_regionkey, 1, n_nationkey, 2) AS (value, place) FROM nation", "SELECT n_nationkey, n_regionkey AS value, 1 AS place FROM nation UNION ALL SELECT n_nationkey, n_nationkey, 2 FROM nation")
_add("conditional_functions", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, if(o_totalprice > 1000, 'big', 'small') AS i, greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, CASE WHEN o_totalprice > 1000 THEN 'big' ELSE 'small' END AS i, greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l FROM orders")
_add("json_scalar", "SELECT event_id, json_extract_scalar(props, '$.k') AS k, json_extract_scalar(props, '$.missing') AS none FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS none FROM events")
_add("surrogate_key", "SELECT o_orderkey, md5(concat_ws('-', coalesce(CAST(o_orderkey AS VARCHAR), '_null_'), coalesce(nullif(o_orderstatus, 'F'), '_null_'))) AS sk FROM orders")
_add("split_hash", "SELECT c_custkey, split_part(c_name, '#', 2) AS part, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer")
_add("date_spine", "SELECT d.day AS day, count(o.o_orderkey) AS n FROM generate_series(DATE '1995-01-01', DATE '1995-01-31', INTERVAL '1' DAY) AS d(day) LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.day GROUP BY d.day", "SELECT CAST(d.day AS DATE) AS day, count(o.o_orderkey) AS n FROM generate_series(DATE '1995-01-01', DATE '1995-01-31', INTERVAL '1' DAY) AS d(day) LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = CAST(d.day AS DATE) GROUP BY d.day")
_add("array_map_struct", "SELECT n_nationkey, ARRAY[n_nationkey, n_regionkey][2] AS second, MAP(ARRAY['a', 'b'], ARRAY[n_nationkey, n_regionkey])['b'] AS b, cardinality(ARRAY[1, 2, 3]) AS n, CAST(ROW(n_nationkey, n_name) AS ROW(id INTEGER, name VARCHAR)).name AS name FROM nation", "SELECT n_nationkey, [n_nationkey, n_regionkey][2] AS second, n_regionkey AS b, CAST(3 AS INTEGER) AS n, n_name AS name FROM nation")

# ------------------------------------------------------------ whole queries

_add("tpch_q1", f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS sum_qty, {MONEY.format('l_extendedprice')} AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_add("tpch_q3", "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-06-15 00:00:00' GROUP BY l_orderkey, o_orderdate")
_add("tpch_q5", "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_add("tpch_q6", "SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
