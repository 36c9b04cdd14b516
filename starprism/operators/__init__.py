"""Operators that take more than one call of the DataFrame API."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast if Catalyst's statistics give it at most so many bytes.
BROADCAST_BYTES = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    """What Catalyst's statistics say of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast behind a check of the size, else left to a shuffled join."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def lookup_join(fact: DataFrame, lookup: DataFrame, fact_keys: list[str], lookup_keys: list[str], how: str = "left", check: bool = True) -> DataFrame:
    """Fills a fact's rows from a lookup by key. With ``check`` a key that stands twice in the lookup raises: the join would
    multiply facts. Null keys match nothing."""
    if check and lookup.dropna(subset=lookup_keys).groupBy(*lookup_keys).count().where("count > 1").take(1):
        raise ValueError(f"the lookup has several rows for a key of {lookup_keys}")
    on = [fact[a] == lookup[b] for a, b in zip(fact_keys, lookup_keys, strict=True)]
    return fact.join(maybe_broadcast(lookup), on, how)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], parts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose hot keys are spread: each row of ``big`` draws one of ``parts`` salts from its own content, each row of
    ``other`` stands once for every salt. For inner, left and semi joins from ``big``."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int"))
    copies = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, k: int, *order: Column | str, offset: int = 0) -> DataFrame:
    """The first k rows of a total order; Catalyst makes it a TakeOrdered, which sorts no more than k rows a task."""
    rows = df.orderBy(*order)
    return (rows.offset(offset) if offset else rows).limit(k)


class ScanTooLarge(Exception):
    """A query would read more rows than its guard allows."""


def guarded(df: DataFrame, most: int) -> DataFrame:
    """The rows, unless there are more than ``most``: then ScanTooLarge. At most ``most`` + 1 rows are counted."""
    if df.limit(most + 1).count() > most:
        raise ScanTooLarge(f"more than {most} rows")
    return df


def count_all(column: Column | str) -> Column:
    """COUNT(column) as engines have it that count nulls too."""
    return F.count(F.lit(1))


def or_zero(aggregate, column: str) -> Column:
    """SUM, MIN or MAX as engines have it that store a null as 0."""
    return aggregate(F.coalesce(F.col(column), F.lit(0)))


def sum0(column: Column | str) -> Column:
    """SUM that is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0))


@dataclass(frozen=True)
class Bounds:
    """What a conjunction of comparisons leaves of a column: values, or a closed or open range."""

    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = False
    values: frozenset | None = None

    @classmethod
    def of(cls, op: str, *values) -> Bounds:
        v = values[0] if values else None
        return {"=": lambda: cls(v, v, values=frozenset([v])), "in": lambda: cls(min(values), max(values), values=frozenset(values)), ">": lambda: cls(low=v, low_open=True), ">=": lambda: cls(low=v), "<": lambda: cls(high=v, high_open=True), "<=": lambda: cls(high=v)}[op]()

    def holds(self, v) -> bool:
        if self.values is not None and v not in self.values:
            return False
        if self.low is not None and (v < self.low or self.low_open and v == self.low):
            return False
        return not (self.high is not None and (v > self.high or self.high_open and v == self.high))

    def both(self, other: Bounds) -> Bounds:
        """What satisfies both."""
        lows = [(b.low, b.low_open) for b in (self, other) if b.low is not None]
        highs = [(b.high, not b.high_open) for b in (self, other) if b.high is not None]
        low, high = max(lows, default=(None, False)), min(highs, default=(None, True))
        values = self.values if other.values is None else other.values if self.values is None else self.values & other.values
        out = Bounds(low[0], high[0], low[1], not high[1], values)
        if values is not None:
            left = frozenset(v for v in values if out.holds(v))
            return Bounds(min(left, default=None), max(left, default=None), values=left)
        return out

    @property
    def empty(self) -> bool:
        """Whether no value is left, so that nothing needs to be read."""
        if self.values is not None:
            return not self.values
        return self.low is not None and self.high is not None and (self.low > self.high or self.low == self.high and (self.low_open or self.high_open))

    def overlaps(self, start, end) -> bool:
        """Whether a value in [start, end) is left, as for pruning segments."""
        return not self.both(Bounds(start, end, high_open=True)).empty


def merged_bounds(conditions: Iterable[tuple[str, Bounds]]) -> dict[str, Bounds]:
    """Per column, what a conjunction leaves."""
    out: dict[str, Bounds] = {}
    for column, b in conditions:
        out[column] = out[column].both(b) if column in out else b
    return out


def cuboids_by_grouping_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """All combinations of a list in one pass: each row is expanded once for every set, so this is for few sets of small
    inputs; building from parent to child reads far less where there are many."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    n = len(every)
    mask = {sum(1 << (n - 1 - i) for i, c in enumerate(every) if c not in s): ",".join(s) for s in sets}
    rows = df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.grouping_id().alias("_grouping"), *aggregates)
    return rows.withColumn("cuboid", F.create_map(*[x for k, v in mask.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("_grouping")]).drop("_grouping")
