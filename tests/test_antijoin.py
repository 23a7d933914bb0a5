"""NOT IN of row values: anti-joins on equal keys, with the rows that SQL's nulls give."""

import pytest
from conftest import SF
from millrace.plans.antijoin import to_anti_joins
from millrace.plans.engine import query
from millrace.queries import QUERIES
from millrace.sources.tables import model_session

SEATS = [(1, 1, 1), (2, 1, 2), (3, 2, 2), (4, 1, None), (5, None, 2), (6, None, None), (7, 3, 3), (8, 3, None), (9, None, 3)]
TAKEN = {
    "none": [],
    "plain": [(1, 1), (1, 1), (2, 3)],
    "column": [(3, None), (2, 1)],
    "both columns": [(None, 2), (3, None)],
    "unknown": [(1, 1), (None, None)],
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def seats(spark):
    """A session with the tables ``seat`` and ``taken``, the second of the rows given."""

    def make(taken):
        own = model_session(spark)
        own.createDataFrame(SEATS, "id INT, row_no INT, place INT").createOrReplaceTempView("seat")
        own.createDataFrame(taken, "r BIGINT, p INT").createOrReplaceTempView("taken")
        return own

    return make


def free(taken):
    """The ids that are left, straight from the meaning of NOT IN."""
    return [i for i, *seat in SEATS if not any(all(a is None or b is None or a == b for a, b in zip(seat, t)) for t in taken)]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_rows_are_not_compared_pair_by_pair(spark):
    assert "NestedLoop" not in plan(QUERIES["join_tuple_in"](spark, SF))


@pytest.mark.parametrize("name", TAKEN)
def test_nulls_on_either_side(seats, name):
    own, want = seats(TAKEN[name]), free(TAKEN[name])
    for sql in ("SELECT id FROM seat WHERE (row_no, place) NOT IN (SELECT r, p FROM taken)", "SELECT id FROM seat s WHERE s.id > 0 AND (NOT (s.row_no, s.place) IN (SELECT r, p FROM taken)) ORDER BY id"):
        df = query(own, sql)
        assert "NestedLoop" not in plan(df)
        assert ids(df) == want


def test_three_columns(seats):
    own = seats([(1, 1), (3, None)])
    sql = "SELECT id FROM seat WHERE (row_no, id, place) NOT IN (SELECT r, r, p FROM taken)"
    assert ids(query(own, sql)) == [2, 3, 4, 5, 6, 7, 8, 9]
    own = seats([(9, None), (None, 3)])
    assert ids(query(own, sql)) == ids(own.sql(sql)) == [1, 2, 3, 5]


def test_below_or(seats):
    own = seats(TAKEN["plain"])
    sql = "SELECT id FROM seat WHERE id = 1 OR (row_no, place) NOT IN (SELECT r, p FROM taken)"
    assert ids(query(own, sql)) == sorted({1, *free(TAKEN["plain"])})


def test_subqueries_on_the_outer_row(seats):
    own = seats(TAKEN["plain"])
    sql = "SELECT id FROM seat WHERE (row_no, place) NOT IN (SELECT r, p FROM taken WHERE r < id)"
    assert ids(query(own, sql)) == ids(own.sql(sql))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT (a, b) NOT IN (SELECT c, d FROM u) AS f FROM t",
        "SELECT a FROM t WHERE NOT (a > 1 AND (a, b) NOT IN (SELECT c, d FROM u))",
        "SELECT a FROM t WHERE ((a, b) NOT IN (SELECT c, d FROM u)) IS NULL",
        "SELECT a FROM t WHERE CASE WHEN a > 1 AND (a, b) NOT IN (SELECT c, d FROM u) AND b > 1 THEN true END",
        "SELECT a FROM t WHERE coalesce((a, b) NOT IN (SELECT c, d FROM u), true)",
        "SELECT a FROM t WHERE (a, b) NOT IN ((1, 2), (3, 4))",
        "SELECT a FROM t WHERE (a, b) NOT IN (SELECT c, d FROM u LIMIT 3)",
        "SELECT a FROM t WHERE (a, b) IN (SELECT c, d FROM u)",
        "SELECT a FROM t JOIN v ON (a, b) NOT IN (SELECT c, d FROM u)",
    ],
)
def test_what_stays(sql):
    assert to_anti_joins(sql) == sql
