"""Ordered scans over keyed rows: numbering, running sums, carries and neighbours.

A plain window sends a whole key to one task. That is right while the largest key
is small, which is checked first. Beyond that the rows of the hot keys, and only they,
are range-partitioned on (keys, order) and cut into even blocks; windows run inside the
blocks and a table with one row per block carries state from block to block.
"""

from __future__ import annotations

from collections import OrderedDict
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, once

TASK_ROWS = 2_000_000
# Sizes counted before, the oldest forgotten first.
_seen: OrderedDict = OrderedDict()
SEEN = 1024


def task_rows(df: DataFrame) -> int:
    """Rows one task may sort (setting ``tessera.task.rows``)."""
    return int(df.sparkSession.conf.get("tessera.task.rows", str(TASK_ROWS)))


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest key and of the whole table; the answer is remembered per plan.

    It only chooses between two plans with equal results, so an old answer is harmless.
    """
    spark = df.sparkSession
    probe = df.select(*keys) if keys else df.select(F.lit(1).alias("_one"))
    plan = probe._jdf.queryExecution().analyzed().canonicalized().toString()
    tag = (spark.sparkContext.applicationId, probe.semanticHash(), md5(plan.encode()).hexdigest(), tuple(keys))
    if tag not in _seen:
        while len(_seen) >= SEEN:
            _seen.popitem(last=False)
        counts = probe.groupBy(*keys).count() if keys else probe.agg(F.count("*").alias("count"))
        row = counts.agg(F.max("count").alias("m"), F.sum("count").alias("s")).first()
        _seen[tag] = (row["m"] or 0, row["s"] or 0)
    return _seen[tag]


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key, to pass on as a bound for tables derived from ``df``."""
    return group_sizes(df, keys)[0]


def is_hot(df: DataFrame, keys: list[str], bound: int | None = None) -> bool:
    """True if one key holds more rows than a task should sort.

    ``bound`` is a known upper limit of the rows per key; only if it is too high, or missing, are
    the rows counted.
    """
    limit = task_rows(df)
    if bound is not None and bound <= limit:
        return False
    return group_sizes(df, keys)[0] > limit


def _hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more rows than a task should sort; at most one per ``task_rows`` rows of the table."""
    return durable(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > task_rows(df)))


def _of_keys(df: DataFrame, hot: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of ``df`` whose key is (``left_semi``) or is not (``left_anti``) in ``hot``."""
    h = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    return df.join(h, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], how)


def _blocks(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Even blocks of rows in the order of (keys, order), written once: a row's block must not change between reads."""
    cut = df.repartitionByRange(-(-rows // task_rows(df)) + 1, *keys, *order)
    return durable(cut.withColumn("_blk", F.spark_partition_id()))


def scan(df: DataFrame, keys: list[str], order: list[str], bound: int | None = None, **cols: tuple[str, Column]) -> DataFrame:
    """Add one column per ``name=(kind, expr)`` along ``order`` within ``keys``.

    Kinds: ``index`` (0-based position), ``sum`` (running sum), ``max`` (running maximum),
    ``last`` (last non-null so far), ``after`` (first non-null from here on), ``prev`` and
    ``next`` (value of the neighbouring row). ``order`` must be a total order of non-null columns.
    """
    made = {f"_v_{n}": e for n, (k, e) in cols.items() if k != "index"}
    rows = df.withColumns(made) if made else df
    if not is_hot(rows, keys, bound):
        return _scan_blocks(rows.withColumn("_blk", F.lit(0)), keys, order, cols, False).drop(*made)
    if not keys:
        return _scan_blocks(_blocks(rows, keys, order, group_sizes(rows, keys)[1]), keys, order, cols, True).drop(*made)
    rows = once(rows)
    hot = _hot_keys(rows, keys)
    many = hot.agg(F.sum("_n")).first()[0] or 0
    cold = _scan_blocks(_of_keys(rows, hot, keys, "left_anti").withColumn("_blk", F.lit(0)), keys, order, cols, False)
    cut = _scan_blocks(_blocks(_of_keys(rows, hot, keys, "left_semi"), keys, order, many), keys, order, cols, True)
    return cold.unionByName(cut).drop(*made)


def _scan_blocks(blocks: DataFrame, keys: list[str], order: list[str], cols: dict, hot: bool) -> DataFrame:
    """The scan inside every (keys, block); with ``hot`` state is carried from block to block."""
    parts = [*keys, "_blk"]
    up = Window.partitionBy(*parts).orderBy(*order)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = (
        Window.partitionBy(*parts)
        .orderBy(*[F.col(o).desc() for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = {
        "index": lambda v: F.row_number().over(up).cast("long") - 1,
        "sum": lambda v: F.sum(v).over(so_far),
        "max": lambda v: F.max(v).over(so_far),
        "last": lambda v: F.last(v, ignorenulls=True).over(so_far),
        "after": lambda v: F.last(v, ignorenulls=True).over(back),
        "prev": lambda v: F.lag(v).over(up),
        "next": lambda v: F.lead(v).over(up),
    }
    if not hot:
        out = blocks.withColumns({n: within[k](f"_v_{n}") for n, (k, _) in cols.items()})
        return out.drop("_blk")

    place = F.struct(*order)
    edge = {
        "index": lambda v: F.count("*"),
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), place)),
        "after": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), place)),
        "prev": lambda v: F.max_by(F.struct(F.col(v).alias("v")), place),
        "next": lambda v: F.min_by(F.struct(F.col(v).alias("v")), place),
    }
    wk = Window.partitionBy(*keys).orderBy("_blk") if keys else Window.partitionBy(F.lit(0)).orderBy("_blk")
    wd = wk.orderBy(F.col("_blk").desc())
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "index": lambda s: F.sum(s).over(before),
        "sum": lambda s: F.sum(s).over(before),
        "max": lambda s: F.max(s).over(before),
        "last": lambda s: F.last(s, ignorenulls=True).over(before),
        "after": lambda s: F.last(s, ignorenulls=True).over(wd.rowsBetween(Window.unboundedPreceding, -1)),
        "prev": lambda s: F.lag(s).over(wk),
        "next": lambda s: F.lead(s).over(wk),
    }
    # One row per (key, block); only keys cut by a block border, at most two per block, are joined.
    ends = blocks.groupBy(*parts).agg(*[edge[k](f"_v_{n}").alias(f"_e_{n}") for n, (k, _) in cols.items()])
    ends = ends.withColumns({f"_c_{n}": carry[k](f"_e_{n}") for n, (k, _) in cols.items()})
    ends = ends.withColumn("_cut", F.count("*").over(wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.filter("_cut > 1").select(
        *[F.col(p).alias(f"_k_{p}") for p in parts], *[f"_c_{n}" for n in cols]
    )
    match = [F.col(p).eqNullSafe(F.col(f"_k_{p}")) for p in parts]
    joined = blocks.join(ends, match, "left")
    first, last = F.lag(F.lit(1)).over(up).isNull(), F.lead(F.lit(1)).over(up).isNull()

    def merged(n: str, k: str) -> Column:
        here, c = within[k](f"_v_{n}"), F.col(f"_c_{n}")
        if k == "index":
            return here + F.coalesce(c, F.lit(0))
        if k == "sum":
            return F.coalesce(here + c, here, c)
        if k == "max":
            return F.greatest(here, c)
        if k in ("last", "after"):
            return F.coalesce(here, c)
        return F.when(first if k == "prev" else last, c["v"]).otherwise(here)

    out = joined.withColumns({n: merged(n, k) for n, (k, _) in cols.items()})
    return out.drop("_blk", *[f"_k_{p}" for p in parts], *[f"_c_{n}" for n in cols])


def indexed(df: DataFrame, keys: list[str], order: list[str], name: str = "i", bound: int | None = None) -> DataFrame:
    """Dense 0-based position within the key."""
    return scan(df, keys, order, bound, **{name: ("index", F.lit(1))})


def halo(df: DataFrame, keys: list[str], before: int, after: int, i: str = "i", chunk: int = 65_536) -> tuple[DataFrame, Window]:
    """Cut densely indexed rows into chunks for short frames.

    Rows within ``before``/``after`` positions of a chunk border are copied to the neighbour, so a
    frame never needs a whole key in one task. Keep only rows with ``_own`` after the window step.
    """
    pos = F.col(i).cast("long")
    lo = F.greatest(F.floor((pos - after) / chunk), F.lit(0))
    hi = F.floor((pos + before) / chunk)
    cut = df.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn(
        "_own", F.col("_chunk") == F.floor(pos / chunk)
    )
    return cut, Window.partitionBy(*keys, "_chunk").orderBy(i)


def own(df: DataFrame) -> DataFrame:
    """Drop the copied border rows of :func:`halo`."""
    return df.filter("_own").drop("_own", "_chunk")
