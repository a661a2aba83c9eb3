"""Shared pieces of the text operators: tables, spare column names, exact scratch tables, ordered sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, scratch_root

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    Unlike a checkpoint the planner knows the size of what it reads, so it broadcasts it in a join
    only below its own limit and shuffles both sides otherwise.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(spark))
    path = f"{sc.getCheckpointDir()}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def match(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``columns``, nulls included; the result has these columns once.

    The key columns of ``right`` get spare names first, so that tables of one origin can be joined.
    """
    keys = spare(left, *[f"_of_{c}" for c in columns])
    other = right.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keys)], *[F.col(f"`{c}`").alias(c) for c in right.columns if c not in columns])
    cond = F.lit(True)
    for c, k in zip(columns, keys):
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"`{k}`"))
    out = left.join(other, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys)


def without(docs: DataFrame, keys: DataFrame, long: bool = False) -> DataFrame:
    """Rows of ``docs`` whose values in the columns of ``keys`` are not among its rows.

    ``keys`` is written first, so that the planner sees its size: a short list is broadcast and the
    texts stay where they are, a long one is joined by a shuffle. ``long`` tells that the list grows with
    ``docs``: it is then joined by a shuffle at any size.
    """
    gone = written(keys.distinct())
    gone = gone.hint("merge") if long else gone
    return match(docs, gone, gone.columns, "left_anti")


def block_count(rows: int, each: int) -> int:
    """Blocks of about ``each`` rows."""
    return max(1, -(-rows // each))


def running(rows: DataFrame, group: list[str], order: list[str], weight: str, before: str, each: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Distributed prefix sums of ``weight`` along ``order`` within ``group``.

    Rows are range-partitioned on (group, order), so that a hot group is cut into even blocks, and
    written once. Returns the rows with ``_block`` and ``before`` (the sum of the rows before them
    in their block), and one row per block: group, ``_block``, ``_offset`` (the sum of the blocks
    before it). A row's prefix is ``_offset + before``. Rows that tie in ``order`` are split over
    blocks like others; their mutual order is arbitrary but fixed by the written table.
    """
    rows = durable(rows)
    spread, = spare(rows, "_spread")
    n = block_count(rows.count(), each)
    cut = rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, spread)
    cut = durable(cut.withColumn("_block", F.spark_partition_id()))
    blocks = cut.groupBy(*group, "_block").agg(F.sum(weight).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_sum").over(upto), F.lit(0).cast("long")))
    inside = Window.partitionBy(*group, "_block").orderBy(*order, spread).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn(before, F.coalesce(F.sum(weight).over(inside), F.lit(0).cast("long"))).drop(spread)
    return out, blocks
