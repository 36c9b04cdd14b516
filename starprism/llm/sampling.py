"""Bounded training samples, chosen by a hash of the id so that every run and every size chooses alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRAIN = 1_000_000


def stratified(rows: DataFrame, by: str, each: int) -> DataFrame:
    """About ``each`` rows of every value of ``by`` (all rows of a value with fewer). ``by`` is a class label: few values."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[x for value, n in counts.items() for x in (F.lit(value), F.lit(min(_GRAIN, -(-_GRAIN * each // n))))])
    return rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(_GRAIN)) < share[F.col(by)])
