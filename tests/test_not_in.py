import pytest

from starprism.cube import sqlcompat

ROWS = "VALUES (1, 'a'), (2, 'b'), (NULL, 'c'), (4, NULL)"
QUERIES = [
    "SELECT k, s FROM nin_l WHERE k NOT IN (SELECT v FROM nin_{r} WHERE v > 1)",
    "SELECT k, s FROM nin_l WHERE k NOT IN (SELECT v FROM nin_{r})",
    "SELECT k, s FROM nin_l WHERE s <> 'b' AND k NOT IN (SELECT v FROM nin_{r} WHERE v IS NOT NULL) AND s IS NOT NULL ORDER BY k",
    "SELECT count(*) AS k, max(s) AS s FROM nin_l x WHERE x.k NOT IN (SELECT v + 1 FROM nin_{r} WHERE w = 'no OR (yes' OR v = 1) GROUP BY s",
    "SELECT k, s FROM nin_l WHERE k IN (SELECT k FROM nin_l WHERE k NOT IN (SELECT v FROM nin_{r} WHERE v IS NOT NULL))",
]
LEFT_ALONE = [
    "SELECT k, s FROM nin_l WHERE k NOT IN (SELECT v FROM nin_a) OR s = 'a'",
    "SELECT k, s FROM nin_l WHERE NOT (s = 'a' AND k NOT IN (SELECT v FROM nin_a))",
    "SELECT k, s FROM nin_l WHERE k NOT IN (SELECT v FROM nin_a LIMIT 1)",
    "SELECT k, s FROM nin_l WHERE k NOT IN (1, 2)",
    "SELECT k, s FROM nin_l WHERE s = 'x NOT IN (SELECT v FROM nin_a)'",
    "SELECT k, CASE WHEN k NOT IN (SELECT v FROM nin_a) THEN 1 END AS s FROM nin_l",
]


@pytest.fixture(scope="module")
def tables(spark):
    spark.sql(f"SELECT * FROM {ROWS} AS t(k, s)").createOrReplaceTempView("nin_l")
    for name, rows in (("a", "(1, 'x'), (7, 'y'), (7, 'y')"), ("n", "(1, 'x'), (CAST(NULL AS INT), 'y')"), ("e", "(1, 'x')")):
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(v, w)" + " WHERE v > 5" * (name == "e")).createOrReplaceTempView(f"nin_{name}")
    return spark


@pytest.mark.parametrize("right", ["a", "n", "e"])
@pytest.mark.parametrize("query", QUERIES)
def test_not_in_by_a_shuffled_join_keeps_the_rules_for_nulls(tables, query, right):
    text = query.replace("{r}", right)
    got, plain = sqlcompat.run(tables, text), tables.sql(text)
    assert "NOT EXISTS" in sqlcompat.shuffled_not_in(text)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.columns == plain.columns


@pytest.mark.parametrize("query", LEFT_ALONE)
def test_other_places_stay_as_they_are(tables, query):
    assert sqlcompat.shuffled_not_in(query) == query
    sqlcompat.run(tables, query).collect()


def test_a_correlated_subquery_still_runs(tables):
    q = "SELECT k, s FROM nin_l l WHERE k NOT IN (SELECT v FROM nin_a a WHERE a.w = l.s)"
    assert sorted(map(str, sqlcompat.run(tables, q).collect())) == sorted(map(str, tables.sql(q).collect()))


def test_join_not_in_broadcasts_no_values(tables):
    from starprism.plans.catalog import QUERIES as registered
    from tests.conftest import SF

    kept = tables.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
    try:
        plan = registered["join_not_in"](tables, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
