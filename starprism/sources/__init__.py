"""Readers and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: delimiters that are tried, in this order
DELIMITERS = ("\x7f", "|", "\t", ",")


def detect_delimiter(line: str) -> str:
    """The delimiter that splits a line into most fields; the first of equals."""
    return max(DELIMITERS, key=lambda d: line.count(d))


def read_delimited(spark: SparkSession, path: str, schema: StructType, delimiter: str | None = None, null_values: tuple[str, ...] = ("\\N",), empty_is_null: bool = False) -> DataFrame:
    """CSV-like files with quoted fields; the delimiter is detected from the first line if it isn't given. Nulls are
    written as one of ``null_values``; with ``empty_is_null`` empty strings are null as well, as empty fields of other types
    always are."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()  # one line
        delimiter = detect_delimiter(first[0][0]) if first else ","
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = spark.read.csv(path, schema=text, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="")  # an empty field is null here
    cols = []
    for f in schema.fields:
        c = F.coalesce(F.col(f.name), F.lit(""))
        is_null = c.isin(*null_values)
        if f.dataType.typeName() != "string" or empty_is_null:
            is_null = is_null | (F.trim(c) == "")
        cols.append(F.when(~is_null, c).cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def read_sequence(spark: SparkSession, path: str, schema: StructType, delimiter: str = "\x01") -> DataFrame:
    """Sequence files whose text values hold delimited fields."""
    lines = spark.sparkContext.sequenceFile(path, valueClass="org.apache.hadoop.io.Text").map(lambda kv: (kv[1],))
    parts = F.split("line", f"\\Q{delimiter}\\E", -1)
    return spark.createDataFrame(lines, "line string").select(*[F.when(F.get(parts, i) != "\\N", F.get(parts, i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog (Hive tables where the session has Hive support)."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None, parts: int = 8, **options) -> DataFrame:
    """A table over JDBC, in parallel ranges of a column where one is given."""
    more = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **more, **options).load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_flat(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A flat table; partitioned by a column of few values where one is given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_sharded(df: DataFrame, path: str, key: str, shards: int, order: str, slice_rows: int = 50_000) -> None:
    """Rows dealt to shards by a key's hash, in time order, in files of at most ``slice_rows`` rows."""
    df.repartition(shards, key).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", slice_rows).parquet(path)


def write_ranged(df: DataFrame, path: str, columns: list[str], parts: int) -> None:
    """Rows ranged and sorted by columns, so that readers skip files and row groups by their statistics."""
    df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)
