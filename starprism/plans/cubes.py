"""Registered queries that the sales cube or the detail store answers; each raises if it was not routed as meant."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starprism.cube.cuboid import Lattice
from starprism.cube.engine import Engine
from starprism.cube.model import DISTINCT, Measure
from starprism.plans.relational import near
from starprism.plans.star import _root, sales_cube, sales_engine, sales_model, views, years

ROUTED: dict[str, tuple[str, str]] = {  # name: SQL, kind of realization
    "cube_exact": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "cube"),
    "cube_post_agg": ("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS price, max(l_extendedprice) AS most, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size BETWEEN 10 AND 30 GROUP BY l_returnflag", "cube"),
    "cube_derived": ("SELECT s_name, s_nationkey, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12 GROUP BY s_name, s_nationkey", "cube"),
    "cube_hierarchy": ("SELECT CAST(year(l_shipdate) AS BIGINT) AS y, CAST(quarter(l_shipdate) AS BIGINT) AS q, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY year(l_shipdate), quarter(l_shipdate)", "cube"),
    "cube_having_sort": ("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10 ORDER BY qty DESC, l_suppkey LIMIT 8", "cube"),
    "cube_weak_match": ("SELECT l_returnflag, max(p_size) AS largest, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag", "cube"),
    "cube_nested": ("SELECT n, count(*) AS suppliers FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) t GROUP BY n", "cube"),
    "cube_distinct_dims": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "cube"),
    "cube_avg": ("SELECT l_linestatus, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY l_linestatus", "cube"),
    "cube_global": ("SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem", "cube"),
    "cube_window": ("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty, CAST(rank() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS BIGINT) AS place FROM lineitem GROUP BY l_suppkey", "cube"),
    "cube_fallback": ("SELECT l_tax, count(*) AS n FROM lineitem GROUP BY l_tax", "spark"),
}


def _routed(text: str, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = sales_engine(spark, sf_dir)
        out = engine.sql(text)
        if engine.last["kind"] != kind:
            raise RuntimeError(f"routed to {engine.last}")
        return out

    return run


def cube_segment_prune(spark, sf_dir):
    """A range at segments' ends reads only these and evaluates no filter."""
    engine = sales_engine(spark, sf_dir)
    cut = engine.realizations["sales"].timeline.segments[0].end
    low = engine.realizations["sales"].timeline.first
    out = engine.sql(f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '{low} 00:00:00' AND l_shipdate < TIMESTAMP '{cut} 00:00:00' GROUP BY l_returnflag")
    if engine.last.get("segments") != 1:
        raise RuntimeError(f"not pruned: {engine.last}")
    return out


def _merged(spark, sf_dir) -> Engine:
    low, high = years(spark, sf_dir)
    engine = Engine(spark, _root(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    small = sales_cube("merged", f"{low}-01-01")
    engine.create(replace(small, row_key=small.row_key[:3], groups=(("lineitem.l_returnflag", "lineitem.l_linestatus", "lineitem.ship_year"),), hierarchies=(), derived={}, expressions={k: v for k, v in small.expressions.items() if k.endswith("year")}))
    for y in range(low + 2, high + 2, 2):
        engine.build("merged", f"{y}-01-01")
    if str(engine.realizations["merged"].timeline.segments[-1].end) <= f"{high}-12-31":
        engine.build("merged", f"{high + 1}-01-01")
    return engine


def cube_merge(spark, sf_dir):
    """Segments of two years merged into one from their base cuboids."""
    engine = _merged(spark, sf_dir)
    ready = engine.realizations["merged"].timeline.segments
    engine.merge("merged", ready[0].start, ready[-1].end)
    sales_engine(spark, sf_dir)
    out = engine.sql("SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS y, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, year(l_shipdate)")
    if engine.last.get("segments") != 1:
        raise RuntimeError(f"not merged: {engine.last}")
    return out


FLAGS = "SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS y, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, year(l_shipdate)"
_SKETCH = Measure("sketch", DISTINCT, ("lineitem.l_suppkey",), "hllc(12)")
_NUMBER = Measure("suppliers", DISTINCT, ("lineitem.l_suppkey",), "bigint", "sketch")
_SIGMA = 1.04 / 2**6  # of sketches of 2^12 registers


def _few(spark, sf_dir, name: str, *measures) -> tuple[Engine, int, int]:
    """An engine with a cube of few groups (flags and years), nothing built yet; the first and the last year."""
    low, high = years(spark, sf_dir)
    views(spark, sf_dir)
    engine = Engine(spark, _root(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    whole = sales_cube(name, f"{low}-01-01")
    engine.create(replace(whole, row_key=whole.row_key[:3], measures=whole.measures[:2] + measures, groups=(("lineitem.l_returnflag", "lineitem.l_linestatus", "lineitem.ship_year"),), hierarchies=(), derived={}, expressions={k: v for k, v in whole.expressions.items() if k.endswith("year")}))
    return engine, low, high


def _answered(engine: Engine, text: str, segments: int) -> DataFrame:
    out = engine.sql(text)
    if engine.last["kind"] != "cube" or engine.last["segments"] != segments:
        raise RuntimeError(f"routed to {engine.last}")
    return out


def cube_few_groups(spark, sf_dir):
    """A cube with far fewer rows than facts, appended in two segments."""
    engine, low, high = _few(spark, sf_dir, "few")
    engine.build("few", f"{low + 1}-01-01")
    engine.build("few", f"{high + 1}-01-01")
    return _answered(engine, FLAGS, 2)


def cube_refresh(spark, sf_dir):
    """A segment built anew in its place."""
    engine, low, high = _few(spark, sf_dir, "fresh")
    engine.build("fresh", f"{low + 1}-01-01")
    engine.build("fresh", f"{high + 1}-01-01")
    before = [s.path for s in engine.realizations["fresh"].timeline.ready()]
    engine.refresh("fresh", f"{low}-01-01", f"{low + 1}-01-01")
    after = [s.path for s in engine.realizations["fresh"].timeline.ready()]
    if before[0] == after[0] or before[1] != after[1]:
        raise RuntimeError("not refreshed")
    return _answered(engine, FLAGS, 2)


def cube_append_and_merge(spark, sf_dir):
    """Distinct counts kept as numbers: each append is merged with all before, so one segment stays."""
    engine, low, high = _few(spark, sf_dir, "counted", _SKETCH, _NUMBER)
    engine.build("counted", f"{low + 1}-01-01")
    engine.build("counted", f"{high + 1}-01-01")
    return _answered(engine, FLAGS, 1)


def cube_holistic_count(spark, sf_dir):
    """The stored numbers of distinct suppliers by flag, held against exact ones."""
    engine, _, high = _few(spark, sf_dir, "holistic", _SKETCH, _NUMBER)
    engine.build("holistic", f"{high + 1}-01-01")
    r = engine.realizations["holistic"]
    kept = spark.read.parquet(r.timeline.segments[0].cuboids[str(r.lattice.mask(["lineitem.l_returnflag"]))])
    exact = spark.sql("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag")
    return kept.join(exact, kept["lineitem__l_returnflag"].eqNullSafe(exact["l_returnflag"])).select("l_returnflag", "n_suppliers", near("m__suppliers", "n_suppliers", _SIGMA).alias("near"))


def cube_distinct_pairs(spark, sf_dir):
    """A stored sketch of pairs of columns, held against exact counts."""
    engine, low, high = _few(spark, sf_dir, "pairs", Measure("pairs", DISTINCT, ("lineitem.l_returnflag", "lineitem.l_suppkey"), "hllc(12)"))
    engine.build("pairs", f"{low + 1}-01-01")
    engine.build("pairs", f"{high + 1}-01-01")
    out = _answered(engine, "SELECT l_linestatus, approx_count_distinct(struct(l_returnflag, l_suppkey)) AS pairs FROM lineitem GROUP BY l_linestatus", 2)
    exact = spark.sql("SELECT l_linestatus, count(DISTINCT l_returnflag, l_suppkey) AS n_pairs FROM lineitem GROUP BY l_linestatus")
    return out.join(exact, "l_linestatus").select("l_linestatus", "n_pairs", near("pairs", "n_pairs", _SIGMA).alias("near"))


def cube_snapshot_refresh(spark, sf_dir):
    """Derived columns after the lookup's snapshot was asked for anew; one of unchanged rows is used again."""
    engine = sales_engine(spark, sf_dir)
    before = engine.realizations["sales"].snapshots["supplier"]
    if engine.refresh_snapshot("sales", "supplier") != before:
        raise RuntimeError("an unchanged lookup was written again")
    return _routed("SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name", "cube")(spark, sf_dir)


def cube_or_ranges(spark, sf_dir):
    """Of ranges joined by OR only the segments that they meet are read."""
    engine, low, high = _few(spark, sf_dir, "ranges")
    for y in sorted({low + 1, max(low + 1, high), high + 1}):
        engine.build("ranges", f"{y}-01-01")
    day = lambda y: f"TIMESTAMP '{y}-01-01 00:00:00'"
    at = f"(l_shipdate >= {day(low)} AND l_shipdate < {day(low + 1)}) OR (l_shipdate >= {day(high)} AND l_shipdate < {day(high + 1)})"
    return _answered(engine, f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {at} GROUP BY l_returnflag", 2)


def hll_merge(spark, sf_dir):
    """Stored sketches of two segments, united, held against exact counts."""
    engine = sales_engine(spark, sf_dir)
    out = _answered(engine, "SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", 2)
    exact = spark.sql("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag")
    return out.join(exact, "l_returnflag").select("l_returnflag", "n_parts", near("parts", "n_parts", _SIGMA).alias("near"))


def _detail(spark, sf_dir) -> Engine:
    engine = sales_engine(spark, sf_dir)
    if "sales_detail" not in engine.realizations:
        columns = ["lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey", "lineitem.l_suppkey", "lineitem.l_quantity", "lineitem.l_tax", "lineitem.l_returnflag", "lineitem.l_shipdate", "part.p_partkey", "part.p_brand", "part.p_size"]
        engine.detail("sales_detail", sales_model(), columns, shard_by="lineitem.l_orderkey")
    return engine


def _from_detail(spark, sf_dir, text: str) -> DataFrame:
    engine = _detail(spark, sf_dir)
    out = engine.sql(text)
    if engine.last["kind"] != "detail":
        raise RuntimeError(f"routed to {engine.last}")
    return out


def detail_rows(spark, sf_dir):
    return _from_detail(spark, sf_dir, "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 AND l_tax > 0.03")


def detail_aggregate(spark, sf_dir):
    return _from_detail(spark, sf_dir, "SELECT p_brand, count(DISTINCT l_orderkey) AS orders_n, round(sum(l_tax), 4) AS tax FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")


def lookup_scan(spark, sf_dir):
    """A query on a lookup alone reads its snapshot."""
    engine = sales_engine(spark, sf_dir)
    lookup = engine.expose_lookup("sales", "supplier")
    out = engine.sql("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <= 50")
    del engine.realizations[lookup.name]
    if engine.last["kind"] != "lookup":
        raise RuntimeError(f"routed to {engine.last}")
    return out


_LATTICE = Lattice(sales_cube())
_YEARLY = [c for c in _LATTICE.valid if "lineitem.ship_year" in _LATTICE.names(c)]


def cuboid_sizes(spark, sf_dir):
    """Rows of every cuboid that holds the year, whose groups are of one segment each (segments are whole years)."""
    sizes = sales_engine(spark, sf_dir).sizes("sales")
    return sizes.where(F.col("cuboid").isin(_YEARLY)).groupBy("cuboid").agg(F.sum("n").alias("n"))


def _size_sql() -> str:
    columns = {"lineitem.ship_year": "year(l_shipdate)", "lineitem.ship_quarter": "quarter(l_shipdate)", "lineitem.ship_month": "month(l_shipdate)"}
    each = lambda c: ", ".join(columns.get(x, x.split(".")[1]) for x in _LATTICE.names(c))
    star = "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    return " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS cuboid, count(*) AS n FROM (SELECT DISTINCT {each(c)} FROM {star}) t" for c in _YEARLY)


FRAMES = (cube_segment_prune, cube_merge, cube_few_groups, cube_refresh, cube_append_and_merge, cube_holistic_count, cube_distinct_pairs, cube_snapshot_refresh, cube_or_ranges, hll_merge, detail_rows, detail_aggregate, lookup_scan, cuboid_sizes)
_HALF = "(SELECT year(min(l_shipdate)) + (year(max(l_shipdate)) + 1 - year(min(l_shipdate))) // 2 AS y FROM lineitem)"
FRAME_SQL = {
    "cube_segment_prune": f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE year(l_shipdate) < (SELECT y FROM {_HALF}) GROUP BY l_returnflag",
    "cube_merge": "SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS y, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, year(l_shipdate)",
    "cube_few_groups": FLAGS, "cube_refresh": FLAGS, "cube_append_and_merge": FLAGS,
    "cube_holistic_count": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, TRUE AS near FROM lineitem GROUP BY l_returnflag",
    "cube_distinct_pairs": "SELECT l_linestatus, count(DISTINCT (l_returnflag, l_suppkey)) AS n_pairs, TRUE AS near FROM lineitem GROUP BY l_linestatus",
    "cube_snapshot_refresh": "SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name",
    "cube_or_ranges": "SELECT l_returnflag, count(*) AS n FROM lineitem, (SELECT year(min(l_shipdate)) AS low, year(max(l_shipdate)) AS high FROM lineitem) y WHERE year(l_shipdate) IN (low, high) GROUP BY l_returnflag",
    "hll_merge": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, TRUE AS near FROM lineitem GROUP BY l_returnflag",
    "cuboid_sizes": _size_sql(),
    "detail_rows": "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 AND l_tax > 0.03",
    "detail_aggregate": "SELECT p_brand, count(DISTINCT l_orderkey) AS orders_n, round(sum(l_tax), 4) AS tax FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "lookup_scan": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <= 50",
}
QUERIES = {name: _routed(*x) for name, x in ROUTED.items()} | {f.__name__: f for f in FRAMES}
ORACLES = {name: text for name, (text, _) in ROUTED.items()} | FRAME_SQL
