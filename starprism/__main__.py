"""Runs one query over a folder of Parquet tables and prints its rows: python -m starprism FOLDER "SELECT ..." [--csv PATH] [--explain]"""

from __future__ import annotations

import argparse
from pathlib import Path


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("query")
    parser.add_argument("--root", default=None, help="where cubes are kept; those that are there answer")
    parser.add_argument("--csv", default=None)
    parser.add_argument("--explain", action="store_true")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from starprism.cube.engine import Engine
    from starprism.sources import write_csv

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for path in sorted(Path(a.folder).glob("*.parquet")):
        spark.read.parquet(str(path)).createOrReplaceTempView(path.stem)
    engine = Engine(spark, a.root or spark.conf.get("spark.sql.warehouse.dir"))
    if a.root:
        engine.load()
    if a.explain:
        print(engine.explain(a.query))
    elif a.csv:
        write_csv(engine.sql(a.query), a.csv)
    else:
        engine.sql(a.query).show(100, truncate=False)


if __name__ == "__main__":
    main()
