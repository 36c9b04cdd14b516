"""Measures as build, merge and final expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starprism.cube.model import COUNT, DISTINCT, MAX, MIN, SUM, Measure, physical
from starprism.cube.types import DataType


def stored(m: Measure) -> str:
    """Column of a cuboid that holds the measure."""
    return f"m__{m.name}"


def _distinct_input(m: Measure) -> Column:
    """One value per combination; a combination with a null doesn't count, as in COUNT(DISTINCT a, b). Parts carry their
    lengths, so that no two combinations look alike."""
    cols = [F.col(physical(c)) for c in m.args]
    if len(cols) == 1:
        return cols[0].cast("string")
    text = [c.cast("string") for c in cols]
    return F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text])


def build(m: Measure) -> Column:
    """Over flat rows."""
    kind = DataType.parse(m.returns)
    if m.func == COUNT:
        return F.count(F.lit(1)).alias(stored(m))
    if m.func == DISTINCT:
        sketch = F.hll_sketch_agg(_distinct_input(m), F.lit(kind.precision if kind.is_sketch else 10))
        return (sketch if kind.is_sketch else F.hll_sketch_estimate(sketch)).alias(stored(m))
    col = F.col(physical(m.args[0]))
    return {SUM: F.sum, MIN: F.min, MAX: F.max}[m.func](col).alias(stored(m))


def merge(m: Measure, by_name: dict[str, Measure]) -> Column:
    """Over rows of cuboids. A distinct count kept as a number comes from its sketch again, never from other numbers."""
    col = F.col(stored(m))
    if m.func == COUNT:
        return F.coalesce(F.sum(col), F.lit(0)).cast("long").alias(stored(m))
    if m.func == DISTINCT:
        if m.holistic:
            return F.hll_sketch_estimate(F.hll_union_agg(F.col(stored(by_name[m.of])), F.lit(True))).alias(stored(m))
        return F.hll_union_agg(col, F.lit(True)).alias(stored(m))
    return {SUM: F.sum, MIN: F.min, MAX: F.max}[m.func](col).alias(stored(m))


#: SQL over merged rows of cuboids, by the query's aggregate
MERGE_SQL = {SUM: "sum({c})", COUNT: "coalesce(sum({c}), 0L)", MIN: "min({c})", MAX: "max({c})", DISTINCT: "hll_sketch_estimate(hll_union_agg({c}, true))"}
#: the same where every group is one stored row
ROW_SQL = {SUM: "{c}", COUNT: "{c}", MIN: "{c}", MAX: "{c}", DISTINCT: "hll_sketch_estimate({c})"}
