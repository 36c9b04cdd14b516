import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from starprism import operators as op


def test_lookup_join(spark):
    fact = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, k int")
    side = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "key int, name string")
    rows = op.lookup_join(fact, side, ["k"], ["key"]).orderBy("id").collect()
    assert [r.name for r in rows] == ["a", None, None]
    with pytest.raises(ValueError, match="several rows"):
        op.lookup_join(fact, side.union(spark.createDataFrame([(1, "x")], side.schema)), ["k"], ["key"])


def test_salted_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    side = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(op.salted_join(big, side, ["k"], 8, how).collect()) == sorted(big.join(side, "k", how).collect())
    with pytest.raises(ValueError):
        op.salted_join(big, side, ["k"], how="full")


def test_size_decides_about_broadcasts(spark):
    side = spark.read.parquet(f"{SF}/part.parquet")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(op.maybe_broadcast(side)).lower() and "broadcast" not in plan(op.maybe_broadcast(side, 10)).lower()


def test_guard_and_top(spark):
    d = spark.range(100)
    assert [r.id for r in op.top_k(d, 3, F.col("id").desc(), offset=1).collect()] == [98, 97, 96]
    assert op.guarded(d, 100).count() == 100
    with pytest.raises(op.ScanTooLarge):
        op.guarded(d, 99)


def test_other_null_rules(spark):
    d = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    assert d.agg(op.count_all("x"), op.or_zero(F.min, "x"), op.or_zero(F.sum, "x"), op.sum0("x")).first() == (3, 0, 6, 6)
    assert d.limit(0).agg(op.sum0("x")).first()[0] == 0


def test_bounds():
    b = op.Bounds.of
    x = op.merged_bounds([("a", b(">=", 3)), ("a", b("<", 10)), ("a", b(">", 3)), ("b", b("in", 1, 5, 9)), ("b", b("<=", 5)), ("c", b("=", 1)), ("c", b("=", 2)), ("d", b(">", 4)), ("d", b("<=", 4))])
    assert x["a"].holds(4) and not x["a"].holds(3) and not x["a"].holds(10) and not x["a"].empty
    assert x["b"].values == {1, 5} and x["c"].empty and x["d"].empty
    assert x["a"].overlaps(9, 20) and not x["a"].overlaps(10, 20) and not x["a"].overlaps(0, 3) and x["b"].overlaps(5, 6) and not x["b"].overlaps(2, 5)


def test_grouping_sets_equal_single_groupings(spark):
    d = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows = op.cuboids_by_grouping_sets(d, [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], F.count("*").alias("n")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.cuboid, []).append((r.l_returnflag, r.l_linestatus, r.n))
    assert sorted(by[""]) == [(None, None, d.count())]
    assert sorted(by["l_linestatus"], key=str) == sorted(((None, r.l_linestatus, r["count"]) for r in d.groupBy("l_linestatus").count().collect()), key=str)
    assert len(by["l_returnflag,l_linestatus"]) == d.select("l_returnflag", "l_linestatus").distinct().count()


def test_command_line(capsys, spark):
    from starprism.__main__ import main

    main([SF, "SELECT count(*) AS n FROM nation"])
    assert "25" in capsys.readouterr().out
