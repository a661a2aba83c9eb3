"""Per-key statistics joined back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once


def nz(c: Column) -> Column:
    """The column, null where it is zero (a divisor)."""
    return F.nullif(c, F.lit(0.0))


def join_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add per-key aggregates as columns.

    Partial aggregation plus a join instead of an unbounded window: the aggregate side has one row
    per key, and AQE splits a hot key on the row side. Without keys the single row is sent out.
    An input that is more than a scan is written once, as both sides read it.
    """
    df = once(df)
    one = [a.alias(n) for n, a in aggs.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*one)))
    return df.join(df.groupBy(*keys).agg(*one), keys)


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate that is null, not an error, where a side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
