"""The star over the driver's tables and the cubes that the registered queries use."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from starprism.cube.engine import Engine
from starprism.cube.model import COUNT, DISTINCT, MAX, MIN, SUM, CubeDesc, Join, Lookup, Measure, RowKey, StarModel

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_tables: dict[tuple, dict] = {}


def views(spark: SparkSession, sf_dir: str) -> None:
    """The tables of a folder as temporary views. Their schemas are looked up once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t, df in _tables[key].items():
        df.createOrReplaceTempView(t)


def sales_model(start: str = "1992-01-01", kind: str = "inner") -> StarModel:
    return StarModel(
        "sales", "lineitem",
        (Lookup("part", Join(kind, ("lineitem.l_partkey",), ("part.p_partkey",))), Lookup("supplier", Join(kind, ("lineitem.l_suppkey",), ("supplier.s_suppkey",)))),
        partition="lineitem.l_shipdate", start=start,
    )


def sales_cube(name: str = "sales", start: str = "1992-01-01", kind: str = "inner") -> CubeDesc:
    """Flags, ship dates as a hierarchy and the supplier; part sizes; the supplier's name and nation derive from its key."""
    columns = ("lineitem.l_returnflag", "lineitem.l_linestatus", "lineitem.ship_year", "lineitem.ship_quarter", "lineitem.ship_month", "lineitem.l_suppkey", "part.p_brand", "part.p_size")
    return CubeDesc(
        name, sales_model(start, kind), tuple(RowKey(c) for c in columns),
        (
            Measure("n", COUNT), Measure("qty", SUM, ("lineitem.l_quantity",), "double"), Measure("price", SUM, ("lineitem.l_extendedprice",), "double"),
            Measure("least", MIN, ("lineitem.l_extendedprice",), "double"), Measure("most", MAX, ("lineitem.l_extendedprice",), "double"), Measure("parts", DISTINCT, ("lineitem.l_partkey",), "hllc(12)"),
        ),
        groups=(("lineitem.l_returnflag", "lineitem.l_linestatus", "lineitem.ship_year", "lineitem.ship_quarter", "lineitem.ship_month"), ("lineitem.l_returnflag", "lineitem.l_suppkey", "part.p_brand", "part.p_size")),
        hierarchies=(("lineitem.ship_year", "lineitem.ship_quarter", "lineitem.ship_month"),),
        derived={"supplier": ("supplier.s_name", "supplier.s_nationkey")},
        expressions={"lineitem.ship_year": "year(lineitem.l_shipdate)", "lineitem.ship_quarter": "quarter(lineitem.l_shipdate)", "lineitem.ship_month": "month(lineitem.l_shipdate)"},
    )


_engines: dict[tuple, Engine] = {}


def _root(spark: SparkSession) -> str:
    """A folder that all executors share: beside checkpoints where the session has such a folder, else the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/starprism-{uuid.uuid4().hex[:10]}"


def years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    low, high = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    return low, high


def sales_engine(spark: SparkSession, sf_dir: str, segments: int = 2) -> Engine:
    """An engine with the sales cube over a folder's tables, built once for a session, in so many segments of years."""
    key = (spark.sparkContext.applicationId, sf_dir, segments)
    if key not in _engines:
        low, high = years(spark, sf_dir)
        engine = Engine(spark, _root(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        engine.create(sales_cube(start=f"{low}-01-01"))
        cuts = sorted({low + (high + 1 - low) * (i + 1) // segments for i in range(segments)} - {low})
        for y in cuts:
            engine.build("sales", f"{y}-01-01")
        _engines[key] = engine
    views(spark, sf_dir)
    return _engines[key]
