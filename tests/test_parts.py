import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType
from tests.conftest import SF

from starprism import functions, sources, streaming


def test_functions(spark):
    d = spark.createDataFrame([("hello wORLD-abc d2e",), ("",), (None,)], "s string")
    assert [r[0] for r in d.select(functions.initcap_words(F.col("s"))).collect()] == ["Hello World-Abc D2e", "", None]
    days = spark.range(1, 13).select(F.make_date(F.lit(2020), F.col("id").cast("int"), F.lit(1)).alias("d"))
    assert [r[0] for r in days.orderBy("d").select(functions.quarter_by_fours(F.col("d"))).collect()] == [m // 4 + 1 for m in range(1, 13)]
    functions.register(spark)
    assert spark.sql("SELECT quarter_by_fours(DATE '2020-07-01'), initcap_words('a-b c')").first() == (2, "A-B C")
    row = spark.range(1).select(functions.truncating_div(F.lit(-7), F.lit(2)), functions.round_to(F.lit(1234.5), F.lit(100.0))).first()
    assert row[0] == -3 and row[1] == 1200.0


@pytest.mark.parametrize(("text", "pattern", "want"), [("abc", "a%", True), ("abc", "a_c", True), ("abc", "a", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("aab", "(a|b)+", True), ("x5", "x[0-9]", True), ("a%", "a\\%", True), ("ab", "a\\%", False), ("a\nb", "a%", True)])
def test_similar_to(spark, text, pattern, want):
    assert spark.range(1).select(functions.similar_to(F.lit(text), pattern, "\\")).first()[0] is want


def test_sketch_error(spark):
    for n in (10, 100, 1000, 10_000, 100_000):
        for p in (10, 14):
            got = spark.range(n).agg(functions.sketch_distinct(F.col("id").cast("string"), p)).first()[0]
            assert abs(got - n) <= 3 * 1.04 / 2 ** (p / 2) * n


def test_delimited_files(spark, tmp_path):
    schema = StructType([StructField("a", IntegerType()), StructField("b", StringType()), StructField("c", DoubleType()), StructField("d", DateType())])
    lines = ['1,"x, ""y""",2.5,2020-01-01', "\\N,,\\N,", '3,z,,"2021-02-03"']
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows = sources.read_delimited(spark, f"file://{tmp_path}/t.csv", schema).collect()
    assert [r.a for r in rows] == [1, None, 3] and [r.b for r in rows] == ['x, "y"', "", "z"] and [r.c for r in rows] == [2.5, None, None] and str(rows[2].d) == "2021-02-03"
    for d in sources.DELIMITERS:
        assert sources.detect_delimiter(f"a{d}b{d}c") == d
    (tmp_path / "e.csv").write_text("")
    assert sources.read_delimited(spark, f"file://{tmp_path}/e.csv", schema).count() == 0


def test_sequence_files(spark, tmp_path):
    path = f"file://{tmp_path}/seq"
    spark.sparkContext.parallelize([(None, "1\x01a"), (None, "\\N\x01b")]).saveAsSequenceFile(path)
    got = sources.read_sequence(spark, path, StructType([StructField("n", IntegerType()), StructField("s", StringType())]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a"), (None, "b")], key=str)


def test_sinks(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/lineitem.parquet")
    sources.write_sharded(d, f"file://{tmp_path}/sharded", "l_orderkey", 3, "l_shipdate", 500)
    sources.write_ranged(d, f"file://{tmp_path}/ranged", ["l_shipdate"], 4)
    sources.write_flat(d, f"file://{tmp_path}/flat", "l_returnflag")
    sources.write_csv(d.limit(3), f"file://{tmp_path}/csv")
    for name in ("sharded", "ranged", "flat"):
        assert spark.read.parquet(f"file://{tmp_path}/{name}").count() == d.count()
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 3


def test_feed_appends_each_batch_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = streaming.read_stream(spark, f"file://{tmp_path}/in", 1)
    for _ in range(2):
        streaming.append_batches(stream, streaming.append_parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == events.count()


def test_windows_over_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = streaming.windowed(streaming.read_stream(spark, f"file://{tmp_path}/in"), "ts", ["event_type"], "1 hour", late="1 day", value="value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = streaming.windowed(events, "ts", ["event_type"], "1 hour", value="value")
    key = lambda rows: sorted((str(r.window_start), r.event_type, r.n) for r in rows)
    assert key(spark.table("win").collect()) == key(want.collect())
    assert streaming.sessions(events, "ts", "user_id", "30 minutes").agg(F.sum("n")).first()[0] == events.count()


def test_oracle_agrees(spark):
    """A sample of the registered queries against DuckDB (all of them run in the driver's check)."""
    import duckdb

    from starprism.plans.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in random.Random(1).sample(sorted(set(ORACLES) & set(QUERIES)), 25):
        got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name]).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(got.columns) == sorted(columns), name
        cell = lambda x: round(float(x), 4) if isinstance(x, float) else str(x)
        order = sorted(columns)
        mine = sorted((tuple(cell(r[c]) for c in order) for r in got.collect()), key=str)
        theirs = sorted((tuple(cell(dict(zip(columns, r, strict=True))[c]) for c in order) for r in want), key=str)
        assert mine == theirs, name
