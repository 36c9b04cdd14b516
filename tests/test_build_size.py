import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from starprism.cube import builder
from starprism.cube.builder import Builder, owned
from starprism.cube.engine import Engine
from starprism.cube.model import COUNT, DISTINCT, SUM, CubeDesc, Join, Lookup, Measure, RowKey, StarModel
from starprism.plans.star import sales_cube, sales_model, views, years


def norm(rows):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    """The sales cube over a small folder, built as if its rows were many."""
    low, high = years(spark, SF)
    kept, Builder.few = Builder.few, 50
    try:
        found = Engine(spark, f"file://{tmp_path_factory.mktemp('root')}", lambda t: spark.read.parquet(f"{SF}/{t}.parquet"))
        found.create(sales_cube(start=f"{low}-01-01"))
        for end in (low + 2, high + 1):
            found.build("sales", f"{end}-01-01")
    finally:
        Builder.few = kept
    views(spark, SF)
    return found


def test_near_copies_of_larger_cuboids_are_not_written(engine):
    r = engine.realizations["sales"]
    for s in r.timeline.ready():
        assert {int(c) for c in s.cuboids} == set(r.lattice.valid)
        rows = {int(c): r._read(p).count() for c, p in s.cuboids.items() if owned(int(c), p)}
        assert r.lattice.full in rows and 10 < len(rows) < len(s.cuboids)
        assert sum(rows.values()) < 2.5 * rows[r.lattice.full]  # some 20 times of it if all were written
        assert all(int(c) & int(p.rsplit("=")[-1]) == int(c) for c, p in s.cuboids.items())


@pytest.mark.parametrize(
    "query",
    [
        "SELECT l_suppkey, p_brand, p_size, count(*) n, sum(l_quantity) q, min(l_extendedprice) a, max(l_extendedprice) b {star} GROUP BY l_suppkey, p_brand, p_size",
        "SELECT l_returnflag, l_suppkey, p_size, count(*) n, avg(l_quantity) q {star} GROUP BY l_returnflag, l_suppkey, p_size",
        "SELECT year(l_shipdate) y, l_suppkey, p_brand, p_size, count(*) n, sum(l_extendedprice) p {star} WHERE p_size < 30 GROUP BY year(l_shipdate), l_suppkey, p_brand, p_size",
        "SELECT DISTINCT l_suppkey, p_brand, p_size {star}",
        "SELECT s_name, p_brand, p_size, sum(l_quantity) q {star} GROUP BY s_name, p_brand, p_size",
    ],
)
def test_what_stands_for_a_cuboid_gives_its_rows(spark, engine, query):
    text = query.format(star="FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
    got = engine.sql(text)
    assert engine.last["kind"] == "cube" and not owned(engine.last["cuboid"], engine.realizations["sales"].timeline.segments[0].cuboids[str(engine.last["cuboid"])])
    assert norm(got.collect()) == norm(spark.sql(text).collect())
    cut = engine.realizations["sales"].timeline.segments[0].end
    low = engine.realizations["sales"].timeline.first
    one = f" WHERE l_shipdate >= TIMESTAMP '{low} 00:00:00' AND l_shipdate < TIMESTAMP '{cut} 00:00:00'"
    text = text.replace(" WHERE", one + " AND") if " WHERE" in text else text.replace(" GROUP", one + " GROUP") if " GROUP" in text else text + one
    got = engine.sql(text)  # of one segment: still added up
    assert engine.last["segments"] == 1 and not engine.last["exact"]
    assert norm(got.collect()) == norm(spark.sql(text).collect())


def test_sizes_of_all_cuboids_are_exact(spark, engine):
    r = engine.realizations["sales"]
    got = {(x.segment, x.cuboid): x.n for x in engine.sizes("sales").collect()}
    assert len(got) == 2 * len(r.lattice.valid)
    for s in r.timeline.ready():
        base = r._read(s.cuboids[str(r.lattice.full)])
        for c in r.lattice.valid:
            assert got[f"{s.start}_{s.end}", c] == base.select(*[x.replace(".", "__") for x in r.lattice.names(c)]).distinct().count()


def test_merged_segments_of_many_rows(spark, engine):
    r = engine.realizations["sales"]
    text = "SELECT l_suppkey, p_brand, p_size, count(*) n, sum(l_quantity) q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, p_brand, p_size"
    before = list(r.timeline.segments)
    engine.merge("sales", before[0].start, before[-1].end)
    try:
        assert norm(engine.sql(text).collect()) == norm(spark.sql(text).collect()) and engine.last["segments"] == 1
    finally:
        r.timeline.segments = before


def star(spark, tmp_path, kind="inner", lost=False):
    """Facts of which half have one key, with nulls in keys and measures."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 3001).cast("int")
    facts = spark.range(20_000).select(key.alias("k"), (F.col("id") % 997).cast("int").alias("g"), F.when(F.col("id") % 50 > 0, F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("w"))
    dims = spark.range(3002 if not lost else 2000).select(F.col("id").cast("int").alias("k"), (F.col("id") % 60).cast("int").alias("name"))
    for t, df in (("f", facts), ("d", dims)):
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{t}")
    tables = lambda t: spark.read.parquet(f"file://{tmp_path}/{t}")
    model = StarModel("m", "f", (Lookup("d", Join(kind, ("f.k",), ("d.k",))),))
    measures = (Measure("n", COUNT), Measure("v", SUM, ("f.v",), "double"), Measure("w", SUM, ("f.w",), "double"), Measure("h", DISTINCT, ("d.name",), "hllc(10)"))
    return tables, CubeDesc("c", model, (RowKey("f.k"), RowKey("f.g"), RowKey("d.name")), measures, (("f.k", "f.g", "d.name"),))


@pytest.mark.parametrize("kind", ["inner", "left"])
@pytest.mark.parametrize("lost", [False, True])
def test_rows_are_dealt_evenly_and_facts_are_the_joined_rows(spark, tmp_path, monkeypatch, kind, lost):
    monkeypatch.setattr(builder, "TASK_ROWS", 2500)
    tables, cube = star(spark, tmp_path, kind, lost)
    engine = Engine(spark, f"file://{tmp_path}/root", tables)
    engine.create(cube)
    segment = engine.build("c")[0]
    flat = tables("f").join(tables("d").withColumnRenamed("k", "dk"), F.col("k") == F.col("dk"), kind)
    base = spark.read.parquet(segment.cuboids["7"])
    files = [r["count"] for r in base.groupBy(F.input_file_name()).count().collect()]
    assert len(files) > 4 and max(files) < 3 * sum(files) / len(files)  # half of the rows have one key
    exact = flat.groupBy("k", "g", "name").agg(F.count("*"), F.sum("v"), F.sum("w"))
    assert norm(base.select("f__k", "f__g", "d__name", "m__n", "m__v", "m__w").collect()) == norm(exact.collect())
    row = flat.agg(F.count("*"), F.count("v"), F.count("w"), F.count("name")).first()
    assert segment.facts == {"rows": row[0], "non_null": [c for c, n in (("d.name", row[3]), ("f.v", row[1]), ("f.w", row[2])) if n == row[0]], "lossless": []}


def test_shards_of_many_rows_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(builder, "TASK_ROWS", 500)
    views(spark, SF)
    engine = Engine(spark, f"file://{tmp_path}/root", lambda t: spark.read.parquet(f"{SF}/{t}.parquet"))
    found = engine.detail("d", sales_model(), shard_by="lineitem.l_orderkey")
    files = [r["count"] for r in spark.read.parquet(found.path).groupBy(F.input_file_name()).count().collect()]
    assert max(files) <= 1000 and sum(files) == spark.table("lineitem").count()
    assert found.lossless == {"part", "supplier"}
