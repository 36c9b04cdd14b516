"""Connected components by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import forget, materialize


SALTS = 8


def shuffled(side: DataFrame) -> DataFrame:
    """A join's side whose rows grow with the input: the join is shuffled, whatever size Catalyst expects. Its estimates
    leave out what explode adds, so that by them millions of rows would be gathered on the driver and broadcast."""
    return side.hint("merge")


def salted_join(many: DataFrame, one: DataFrame, by: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Joins rows of ``many`` with the single row that ``one`` has for a key. A key's rows are dealt to ``salts`` places by
    the column ``spread`` and its single row is copied to each, so that a hub's rows don't land in one task."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(shuffled(copied), [by, "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return salted_join(both.where(F.col("b") > F.col("a")), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    side = salted_join(down, least, "a", "b").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for distinct long ``nodes`` and edges a, b between them.

    Each round's edges are written to the shared folder; the number of rounds grows with the logarithm of the longest
    path. Raises if it hasn't settled after ``most_rounds``.
    """
    now = edges.select("a", "b").where(F.col("a") != F.col("b"))
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, old = sign(now), None
    if before[0]:
        for _ in range(most_rounds):
            now = materialize(_small_star(_large_star(now)), "stars")
            if old is not None:
                forget(old)
            after, old = sign(now), now
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("the components did not settle")
    return nodes.join(shuffled(now.groupBy("a").agg(F.min("b").alias("b"))), nodes["node"] == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))
