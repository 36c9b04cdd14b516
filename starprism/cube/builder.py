"""Building: star to flat rows, base cuboid, smaller cuboids from their parents, merging segments."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from starprism.cube.cuboid import Lattice
from starprism.cube.measures import build, merge, stored
from starprism.cube.model import COUNT, CubeDesc, StarModel, physical
from starprism.cube.segments import Segment
from starprism.cube.storage import Store

Tables = Callable[[str], DataFrame]

#: Rows that a task should get of a shuffle at most, and rows of a lookup that is broadcast where its keys alone are used
TASK_ROWS, KEY_ROWS = 400_000, 500_000


def renamed(tables: Tables, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table with its columns named as in flat rows; only those asked for, so that scans read no others."""
    df = tables(table)
    return df.select(*[F.col(c).alias(physical(f"{table}.{c}")) for c in df.columns if columns is None or f"{table}.{c}" in columns])


def needed_columns(cube: CubeDesc) -> list[str]:
    """table.column of dimensions, measures, join keys, the partition and what expressions use."""
    out = [c for c in [*cube.dimensions, *(a for m in cube.measures for a in m.args)] if c not in cube.expressions]
    out += [k for x in cube.model.lookups for k in (*x.join.fact_keys, *x.join.lookup_keys)]
    if cube.model.partition:
        out.append(cube.model.partition)
    return list(dict.fromkeys(out))


def _used(tables: Tables, model: StarModel, columns: list[str], texts: list[str]) -> dict[str, list[str]]:
    """The columns of each table that are listed or named in SQL texts."""
    out = {}
    for t in model.tables:
        every = [f"{t}.{c}" for c in tables(t).columns]
        out[t] = [c for c in every if c in columns or any(c in x for x in texts)]
    return out


def flatten(tables: Tables, model: StarModel, columns: list[str], expressions: dict[str, str], start=None, end=None) -> DataFrame:
    """Fact rows of [start, end) joined with their lookups. Catalyst chooses how to join; lookups that are small enough
    by its statistics are broadcast, others shuffled. Where keys alone are used, counted rows decide: facts needn't be
    shuffled for these."""
    texts = [*expressions.values(), *([model.condition] if model.condition else [])]
    keys = [k for x in model.lookups for k in (*x.join.fact_keys, *x.join.lookup_keys)]
    used = _used(tables, model, [*columns, *keys, *([model.partition] if model.partition else [])], texts)
    flat = renamed(tables, model.fact, used[model.fact])
    if model.partition and start is not None:
        day = F.col(physical(model.partition))
        flat = flat.where((day >= F.lit(start).cast(flat.schema[physical(model.partition)].dataType)) & (day < F.lit(end).cast(flat.schema[physical(model.partition)].dataType)))
    for x in model.lookups:
        side = renamed(tables, x.table, used[x.table])
        on = [F.col(physical(a)) == F.col(physical(b)) for a, b in zip(x.join.fact_keys, x.join.lookup_keys, strict=True)]
        if set(used[x.table]) == set(x.join.lookup_keys) and side.count() <= KEY_ROWS:
            side = F.broadcast(side)
        flat = flat.join(side, on, x.join.kind)
    names = sorted((c for cols in used.values() for c in cols), key=len, reverse=True)

    def sql(text: str) -> str:
        for c in names:
            text = text.replace(c, f"`{physical(c)}`")
        return text

    if model.condition:
        flat = flat.where(sql(model.condition))
    return flat.withColumns({physical(n): F.expr(sql(e)) for n, e in expressions.items()}) if expressions else flat


def tasks(spark: SparkSession, rows: int) -> int:
    """For a shuffle of so many rows: as many parts as the session asks for, but more if they would be too large for a
    task's memory, and fewer if they would be tiny."""
    return max(1, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (TASK_ROWS // 16))))


def owned(cuboid: int, path: str) -> bool:
    """Whether a cuboid's path holds its own rows; else these are rows of a larger cuboid, to be added up."""
    return path.endswith(f"/cuboid={cuboid}")


class Builder:
    """Writes cuboids as Parquet, one folder for each, under the segment's folder. A cuboid that would keep over ``share``
    of the rows of the smallest written one above it is not written: its path is that one's, and queries add its rows up.
    Cuboids of up to ``few`` rows and cubes with distinct counts kept as numbers are written whole."""

    share, few = 0.125, 100_000

    def __init__(self, store: Store, cube: CubeDesc, tables: Tables, parallel: int = 4):
        self.store, self.cube, self.tables, self.parallel = store, cube, tables, parallel
        self.lattice = Lattice(cube)
        self.by_name = {m.name: m for m in cube.measures}

    def _write(self, df: DataFrame, path: str, cuboid: int) -> tuple[int, str]:
        folder = f"{path}/cuboid={cuboid}"
        df.write.option("compression", "zstd").parquet(folder)
        return cuboid, folder

    def _keys(self, cuboid: int) -> list[str]:
        return [physical(c) for c in self.lattice.names(cuboid)]

    def read(self, path: str) -> DataFrame:
        return self.store.spark.read.parquet(path)

    def _estimates(self, path: str) -> dict[int, int]:
        """About how many rows cuboids have, from the base; none for those that have few rows anyway."""
        base = self.read(path)
        names = self._keys(self.lattice.full)
        seen = base.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(c) for c in names]).first()
        most = {c: math.prod(max(seen[k], 1) * 1.2 + 1 for k in self._keys(c)) for c in self.lattice.valid}
        large = [c for c, n in most.items() if n > self.few and c != self.lattice.full] if seen["n"] > self.few and not self.cube.holistic else []
        if not large:
            return {}
        row = base.agg(*[F.approx_count_distinct(F.xxhash64(*self._keys(c))).alias(str(c)) for c in large]).first()
        return {self.lattice.full: seen["n"]} | {c: min(row[str(c)], seen["n"]) for c in large}

    def smaller(self, path: str) -> dict[str, str]:
        """All cuboids below the base, level by level; those of a level side by side, each from the smallest written
        cuboid above it (its parent, where nothing is known of sizes)."""
        paths = {self.lattice.full: f"{path}/cuboid={self.lattice.full}"}
        rows = self._estimates(paths[self.lattice.full])

        def one(cuboid: int, parent: int) -> tuple[int, str]:
            if rows:
                parent = min((c for c, p in paths.items() if c & cuboid == cuboid and owned(c, p)), key=lambda c: (rows.get(c, 0), c.bit_count(), c))
                if rows.get(cuboid, 0) > max(self.few, self.share * rows.get(parent, 0)):
                    return cuboid, paths[parent]
            found = self.read(paths[parent]).groupBy(*self._keys(cuboid)).agg(*[merge(m, self.by_name) for m in self.cube.measures])
            return self._write(found, path, cuboid)

        with ThreadPoolExecutor(self.parallel) as pool:
            for level in self.lattice.levels()[1:]:
                paths.update(list(pool.map(lambda x: one(*x), level)))
        return {str(k): v for k, v in paths.items()}

    def _fact(self, start, end) -> DataFrame:
        """The segment's fact rows without lookups, with the expressions over them alone."""
        lookups = self.cube.model.tables[1:]
        alone = replace(self.cube.model, lookups=(), condition=None)
        own = {n: e for n, e in self.cube.expressions.items() if not any(f"{t}." in e for t in lookups)}
        return flatten(self.tables, alone, needed_columns(self.cube), own, start, end)

    def _dealt(self, flat: DataFrame, fact: DataFrame, seen: Row) -> tuple[DataFrame, list[str]]:
        """Flat rows dealt so that they can be grouped without a further shuffle, and columns to group by besides the
        keys. Where groups are few, rows are as they were: they are better added up before they are shuffled. Else rows
        go by the fact's key of most values, so that most of a smaller cuboid's rows lie together; rows of its frequent
        values and nulls are spread by the other keys."""
        keys, distinct = self._keys(self.lattice.full), {k: seen[f"distinct {k}"] for k in map(physical, self.cube.dimensions) if f"distinct {k}" in seen}
        for t in self.cube.model.tables[1:]:
            if columns := [c.split(".")[1] for c in self.cube.dimensions if c.startswith(f"{t}.") and c not in self.cube.expressions]:
                distinct |= {physical(f"{t}.{k}"): v for k, v in self.tables(t).agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict().items()}
        if math.prod(max(v, 1) for v in distinct.values()) <= seen["rows"] / 2:
            return flat, []
        n = tasks(self.store.spark, seen["rows"])
        by = max((k for k in keys if k in fact.columns), key=lambda k: distinct[k], default=None)
        if by is None or distinct[by] < 4 * n:
            return flat.repartition(n, *keys), []
        frequent = [x for x in fact.stat.freqItems([by], max(1e-4, 0.25 / n)).first()[0] if x is not None]
        spread = F.col(by).isNull() | F.col(by).isin(frequent) if frequent else F.col(by).isNull()
        flat = flat.withColumn("_spread", F.when(spread, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).otherwise(0))
        return flat.repartition(n, by, "_spread"), ["_spread"]

    def _seen(self, fact: DataFrame) -> Row:
        """Rows of the fact table, values of each measured column, and about how many of each dimension."""
        args = sorted({physical(a) for m in self.cube.measures for a in m.args} & set(fact.columns))
        dims = [physical(c) for c in self.cube.dimensions if physical(c) in fact.columns]
        return fact.agg(F.count(F.lit(1)).alias("rows"), *[F.count(a).alias(f"count {a}") for a in args], *[F.approx_count_distinct(c).alias(f"distinct {c}") for c in dims]).first()

    def lossless(self, fact: DataFrame) -> list[str]:
        """The lookups whose inner joins lose no fact row."""
        out = []
        for x in self.cube.model.lookups:
            if x.join.kind == "inner":
                side = renamed(self.tables, x.table, list(x.join.lookup_keys))
                keys = fact.select(*map(physical, x.join.fact_keys)).distinct()
                on = [F.col(physical(a)) == F.col(physical(b)) for a, b in zip(x.join.fact_keys, x.join.lookup_keys, strict=True)]
                if not keys.join(side, on, "left_anti").take(1):
                    out.append(x.table)
        return out

    def _facts(self, flat: DataFrame, fact: DataFrame, seen: Row, base: str) -> dict:
        """What routing has to know: which measured columns hold no null, and which inner joins lose no fact row. Flat
        rows are joined once more only where the fact table alone doesn't tell."""
        model, args, whole = self.cube.model, sorted({a for m in self.cube.measures for a in m.args}), self.lossless(fact)
        count = next(m for m in self.cube.measures if m.func == COUNT)
        rows = self.read(base).agg(F.sum(stored(count))).first()[0] or 0
        full = {a for a in args if f"count {physical(a)}" in seen and seen[f"count {physical(a)}"] == seen["rows"]}
        same = not model.condition and all(x.join.kind == "left" or x.table in whole for x in model.lookups)
        if open_ := [a for a in args if a not in full and not (same and f"count {physical(a)}" in seen)]:
            values = flat.agg(*[F.count(physical(a)).alias(physical(a)) for a in open_]).first()
            full |= {a for a in open_ if values[physical(a)] == rows}
        return {"rows": rows, "non_null": sorted(full), "lossless": whole}

    def build(self, segment: Segment) -> Segment:
        span = (segment.start, segment.end) if self.cube.model.partition else (None, None)
        path = self.store.path(self.cube.name, f"{segment.start}_{segment.end}_{uuid.uuid4().hex[:8]}")
        flat, fact = flatten(self.tables, self.cube.model, needed_columns(self.cube), self.cube.expressions, *span), self._fact(*span)
        seen, keys = self._seen(fact), self._keys(self.lattice.full)
        dealt, more = self._dealt(flat.select(*dict.fromkeys([*keys, *(physical(a) for m in self.cube.measures for a in m.args)])), fact, seen)
        base = dealt.groupBy(*keys, *more).agg(*[build(m) for m in self.cube.measures]).drop(*more)
        _, folder = self._write(base, path, self.lattice.full)
        return Segment(segment.start, segment.end, segment.status, path, self.smaller(path), self._facts(flat, fact, seen, folder))

    def merged(self, segment: Segment, parts: list[Segment]) -> Segment:
        """A segment from the base cuboids of others, without the fact table."""
        path = self.store.path(self.cube.name, f"{segment.start}_{segment.end}_{uuid.uuid4().hex[:8]}")
        rows = None
        for p in parts:
            one = self.read(p.cuboids[str(self.lattice.full)])
            rows = one if rows is None else rows.unionByName(one)
        base = rows.groupBy(*self._keys(self.lattice.full)).agg(*[merge(m, self.by_name) for m in self.cube.measures])
        self._write(base, path, self.lattice.full)
        both = lambda key: sorted(set.intersection(*[set(p.facts[key]) for p in parts]))
        return Segment(segment.start, segment.end, segment.status, path, self.smaller(path), {"rows": sum(p.facts["rows"] for p in parts), "non_null": both("non_null"), "lossless": both("lossless")})

    def snapshot(self, lookup: str) -> str:
        """A copy of a lookup for derived columns; one that is there already serves if rows are the same. Keys must be unique."""
        side = self.tables(lookup)
        keys = [k.split(".")[1] for k in self.cube.model.lookup(lookup).join.lookup_keys]
        if side.where(F.concat_ws("", *[F.when(F.col(k).isNull(), "x") for k in keys]) == "").groupBy(*keys).count().where("count > 1").take(1):
            raise ValueError(f"lookup {lookup} has several rows for a key")
        row = side.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*side.columns).cast("decimal(38,0)"))).first()
        path = self.store.path("snapshots", f"{lookup}-{row[0]}-{row[1]}")
        if not self.store.exists("snapshots", f"{lookup}-{row[0]}-{row[1]}", "_SUCCESS"):
            renamed(self.tables, lookup).write.mode("overwrite").parquet(path)
        return path


def _exact_text(df: DataFrame, column: str) -> Column:
    """A text that differs for different values, with its length before it; nulls have one of their own."""
    value = F.unix_micros(column) if df.schema[column].dataType.typeName() == "timestamp" else F.col(column)
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sizes(df: DataFrame, lattice: Lattice, cuboids: list[int], path: str) -> list[DataFrame]:
    """Groups (cuboid, n) of the cuboids whose rows are at the path. Those that aren't written and share the columns of
    one of them are counted together: rows meet by these columns once, and are told apart by the others there."""
    out, left = [], [c for c in cuboids if not owned(c, path)]
    alone = lambda rows, c: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("cuboid"), "n")
    names = lambda c: [physical(x) for x in lattice.names(c)]
    out += [alone(df, c) for c in cuboids if owned(c, path)]
    if len(left) > 1:
        least = max(left, key=lambda m: (sum(c & m == m for c in left), -m.bit_count(), m))
        together = [c for c in left if c & least == least]
        common, others = names(least), list(dict.fromkeys(x for c in together for x in names(c & ~least)))
        groups = df.select(*common, *[_exact_text(df, x).alias(x) for x in others]).repartition(*map(F.col, common)).groupBy(*common).agg(F.collect_list(F.struct(F.lit(0), *others)).alias("_rows"))
        each = lambda c: F.size(F.array_distinct(F.transform("_rows", lambda x: F.concat(F.lit(""), *[x[k] for k in names(c & ~least)]))))
        counted = groups.select(*[(F.when(F.size("_rows") > 1, each(c)).otherwise(1) if c != least else F.lit(1)).cast("long").alias(str(c)) for c in together]).agg(*[F.coalesce(F.sum(str(c)), F.lit(0)).alias(str(c)) for c in together])
        out.append(counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cuboid"), F.col(str(c)).alias("n")) for c in together])).alias("x")).select("x.*"))
        left = [c for c in left if c not in together]
    return out + [alone(df.select(*names(c)).distinct(), c) for c in left]


def distribution(df: DataFrame) -> DataFrame:
    """Rows by partition: how evenly a table is laid out."""
    return df.groupBy(F.spark_partition_id().alias("part")).count()


def layout(df: DataFrame, columns: list[str], rows_per_file: int) -> DataFrame:
    """Rows ranged and sorted by columns, about so many in a file, so that filters on them skip files."""
    n = max(1, -(-df.count() // rows_per_file))
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
