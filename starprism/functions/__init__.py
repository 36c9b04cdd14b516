"""Functions that other SQL dialects have, as columns and as SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def initcap_words(text: Column) -> Column:
    """First letters in upper case, others in lower; words are runs of A-Z, a-z and 0-9, so `a-b` has two."""
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2147483647)))), "")


def quarter_by_fours(day: Column) -> Column:
    """month / 4 + 1 by integer division, as some engines define QUARTER: July is 2, October and November are 3."""
    return (F.floor(F.month(day) / 4) + 1).cast("int")


def truncating_div(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b)


def decimal_div(a: Column, b: Column) -> Column:
    """Division of decimals to 16 fractional digits, null for a zero divisor."""
    return (a.cast("decimal(19,4)") / F.nullif(b.cast("decimal(19,4)"), F.lit(0).cast("decimal(19,4)"))).cast("decimal(38,16)")


def varchar(text: Column, n: int) -> Column:
    """CAST AS VARCHAR(n) as engines have it that cut longer values."""
    return F.substring(text.cast("string"), 1, n)


def round_to(value: Column, multiple: Column) -> Column:
    """The largest multiple not above the value."""
    return F.floor(value / multiple) * multiple


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A SIMILAR TO pattern as a regular expression: % and _ are wildcards, | * + ? { } ( ) [ ] keep their meaning."""
    out, i, bracket = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("the pattern ends in its escape")
            out.append(re.escape(pattern[i]))
        elif bracket:
            out.append(c)
            bracket = c != "]"
        elif c == "[":
            out.append(c)
            bracket = True
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        elif c in "|*+?{}()":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(text: Column, pattern: str, escape: str | None = None) -> Column:
    return text.rlike(similar_pattern(pattern, escape))


def sketch_distinct(column: Column, precision: int = 10) -> Column:
    """Approximate distinct count by a HyperLogLog sketch of 2^precision registers."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(precision)))


def register(spark: SparkSession) -> None:
    """Makes quarter_by_fours and initcap_words callable from SQL, as SQL functions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quarter_by_fours(d DATE) RETURNS INT RETURN CAST(floor(month(d) / 4) + 1 AS INT)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION initcap_words(s STRING) RETURNS STRING RETURN array_join(transform(regexp_extract_all(s, '([A-Za-z0-9]+|[^A-Za-z0-9]+)', 1), p -> concat(upper(substring(p, 1, 1)), lower(substring(p, 2)))), '')")
