"""As-of joins: one union and one ordered scan, never an inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, bound: int | None = None, **take: str) -> DataFrame:
    """Match every left row with right rows before and after it in ``on``.

    ``take`` maps a new column to ``before``, ``after``, ``before_open`` or ``after_open``; the
    column is a struct of the right row. Times of the right side are unique within a key.
    """
    lcols = [c for c in left.columns if c not in keys and c != on]
    rcols = [c for c in right.columns if c not in keys]
    l = left.select(*keys, F.col(on).alias("_t"), F.struct(*(lcols or [F.lit(0).alias("_x")])).alias("_l"))
    r = right.select(*keys, F.col(on).alias("_t"), F.struct(*rcols).alias("_r"))
    both = l.withColumn("_tag", F.lit(1)).unionByName(r.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    kinds = set(take.values())
    # At equal times rights come first for a closed "before" and an open "after", last otherwise.
    out = None
    for tag_order, wanted in ((1, {"before", "after_open"}), (-1, {"before_open", "after"})):
        hit = kinds & wanted
        if not hit:
            continue
        src = both if out is None else out
        specs = {n: ("last" if k.startswith("before") else "after", F.col("_r")) for n, k in take.items() if k in wanted}
        out = scan(src.withColumn("_o", F.col("_tag") * tag_order), keys, ["_t", "_o"], bound, **specs).drop("_o")
    out = out.filter("_tag = 1")
    return out.select(*keys, F.col("_t").alias(on), *[F.col(f"_l.{c}").alias(c) for c in lcols], *take)


def closer(before: Column, after: Column, t: Column, on: str = "t") -> Column:
    """The nearer of two as-of structs; the earlier one on a tie."""
    nearer_after = before.isNull() | (after[on] - t < t - before[on])
    return F.when(after.isNotNull() & nearer_after, after).otherwise(before)
