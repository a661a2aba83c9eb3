"""Exact percentiles and average ranks that do not need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once
from .scan import is_hot, scan


def quantiles(df: DataFrame, keys: list[str], value: str, bound: int | None = None, **qs: float) -> DataFrame:
    """Linear-interpolation percentiles per key as columns ``name=q``."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not is_hot(rows, keys, bound):
        arr = F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs.values()]))
        out = rows.groupBy(*keys).agg(arr.alias("_q"))
        return out.select(*keys, *[F.col("_q")[n].alias(c) for n, c in enumerate(qs)])
    # Equal values collapse first; the running count then tells which value sits at each rank.
    freq = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    cum = scan(freq, keys, ["_v"], _cum=("sum", F.col("_n")))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_t"))
    cum = cum.join(total, keys) if keys else cum.crossJoin(F.broadcast(total))
    picks = []
    for c, q in qs.items():
        pos = F.lit(float(q)) * (F.col("_t") - 1)
        picks += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v"))).alias(f"_lo_{c}"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v"))).alias(f"_hi_{c}"),
            F.first(pos - F.floor(pos)).alias(f"_f_{c}"),
        ]
    out = cum.groupBy(*keys).agg(*picks)
    return out.select(
        *keys, *[(F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * F.col(f"_f_{c}")).alias(c) for c in qs]
    )


def with_quantiles(df: DataFrame, keys: list[str], value: str, bound: int | None = None, **qs: float) -> DataFrame:
    """Percentiles joined back to the rows (skewed keys are split by AQE); the input is run once."""
    df = once(df)
    q = quantiles(df, keys, value, bound, **qs)
    return df.join(q, keys, "left") if keys else df.crossJoin(F.broadcast(q))


def rank_table(df: DataFrame, value: str, group: str, keys: list[str] | None = None) -> DataFrame:
    """Counts per (value, group) with the average rank of the value among all rows of the key.

    Columns: keys, value, group, ``n`` (rows), ``ties`` (rows with that value), ``rank``.
    """
    keys = keys or []
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value, group).agg(F.count("*").alias("n"))
    ties = per.groupBy(*keys, value).agg(F.sum("n").alias("ties"))
    cum = scan(ties, keys, [value], _cum=("sum", F.col("ties")))
    cum = cum.select(*keys, value, "ties", (F.col("_cum") - (F.col("ties") - 1) / 2).alias("rank"))
    return per.join(cum, [*keys, value])
