"""Streaming forms of batch operators: event time ``ts``, watermarks, bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.keys import antijoin
from ..session import scratch_path


def stream_new_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", name_filter: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as a stream; the checkpoint of the query remembers which were read."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (r.option("pathGlobFilter", name_filter) if name_filter else r).load(path)


def run_available(df: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> str:
    """Process all that is there into a folder of parquet files; returns the folder."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint or f"{path}-state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return path


BUCKET = "_bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    """Folder of a key in the target; of its text, so that it does not depend on the type a function gives back."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def populated(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The target of :func:`stream_populate`, or only some of its folders, of which nothing else is listed; none if there are none."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if only is None:
        return spark.read.parquet(path).drop(BUCKET) if fs.exists(base) else None
    folders = [f"{path}/{BUCKET}={k}" for k in only]
    folders = [f for f in folders if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
    return spark.read.option("basePath", path).parquet(*folders).drop(BUCKET) if folders else None


def stream_populate(source: DataFrame, keys: list[str], fn: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, buckets: int = 64) -> None:
    """Append the results of keys that are not in the target yet, micro-batch by micro-batch.

    The target has a folder for every bucket of keys; a batch only lists and reads the key columns of the buckets that
    its own keys fall in. A batch that is repeated after a failure finds its keys already there and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        here = [r[0] for r in fresh.select(_bucket(keys, buckets)).distinct().collect()]
        old = populated(batch.sparkSession, path, here)
        if old is not None:
            fresh = antijoin(fresh, old.select(*keys), keys)
        out = fn(fresh).withColumn(BUCKET, _bucket(keys, buckets))
        out.repartition(BUCKET).write.partitionBy(BUCKET).mode("append").parquet(path)

    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_dedupe(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First event of every key; keys are forgotten once the watermark has passed."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_block_mean(events: DataFrame, keys: list[str], seconds: int, delay: str) -> DataFrame:
    """Mean per block of event time; late rows are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    g = events.withWatermark("ts", delay).groupBy(*keys, w).agg(F.avg("value").alias("y"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), "y", "n")


def stream_sliding_stats(events: DataFrame, keys: list[str], width: str, step: str, delay: str) -> DataFrame:
    """Rolling mean, spread and count over sliding windows."""
    w = F.window("ts", width, step)
    g = events.withWatermark("ts", delay).groupBy(*keys, w).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n")


def stream_bouts(events: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Groups of events separated by at least a gap."""
    g = events.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_triggers(events: DataFrame, keys: dict[str, str], threshold: float, min_gap_s: float, delay: str, forget_s: float | None = None) -> DataFrame:
    """Upward crossings with debounce; ``keys`` maps key columns to their types.

    Rows of a key wait in its state until the watermark has passed them and are then put in time order
    (by ``event_id`` at equal times), so a row that is late within ``delay`` counts like any other.
    Besides the waiting rows the state holds the last value and crossing, 24 bytes a key, so the first row after any
    silence is judged like the next. With ``forget_s`` these are dropped that long after the newest row,
    and the next row of the key is its first again.
    """
    names = list(keys)
    schema = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), "ts timestamp", "value double"])
    held = "t array<long>, e array<long>, v array<double>, last_t long, last_v double, last_c long"
    low = -(2**62)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, e, v, last_t, last_v, last_c = state.get if state.exists else ([], [], [], low, float("inf"), low)
        t, e, v = np.array(t, dtype=np.int64), np.array(e, dtype=np.int64), np.array(v, dtype=float)
        if not state.hasTimedOut:
            for p in parts:
                at = p["ts"].astype("datetime64[us, UTC]" if p["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
                t, e, v = np.append(t, at), np.append(e, p["event_id"]), np.append(v, p["value"])
        mark = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((e, t))
        t, e, v = t[order], e[order], v[order]
        n = int(np.searchsorted(t, mark, side="left"))
        done_t, done_v = t[:n], v[:n]
        up = np.flatnonzero((done_v >= threshold) & (np.concatenate(([last_v], done_v[:-1])) < threshold)) if n else np.zeros(0, dtype=int)
        before = np.concatenate(([last_c], done_t[up][:-1])) if len(up) else done_t[up]
        kept = up[done_t[up] - before >= min_gap_s * 1e6]
        if n:
            last_t, last_v = int(done_t[-1]), float(done_v[-1])
        if len(up):
            last_c = int(done_t[up[-1]])
        if n == len(t) and forget_s is not None and mark > last_t + forget_s * 1e6:
            state.remove()
        else:
            state.update((t[n:].tolist(), e[n:].tolist(), v[n:].tolist(), last_t, last_v, last_c))
            if n < len(t) or forget_s is not None:
                wake = int(t[n]) if n < len(t) else int(last_t + forget_s * 1e6)
                state.setTimeoutTimestamp(max(wake // 1000, mark // 1000) + 1)
        out = pd.DataFrame({c: [x] * len(kept) for c, x in zip(names, k)}, columns=names)
        out["ts"], out["value"] = pd.to_datetime(done_t[kept], unit="us"), done_v[kept]
        yield out

    src = events.withWatermark("ts", delay).select(*names, "event_id", "ts", "value")
    return src.groupBy(*names).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_interval_join(samples: DataFrame, triggers: DataFrame, key: str, after: str, delay: str) -> DataFrame:
    """Samples in a window after each trigger of their key; both sides are kept only that long."""
    s = samples.withWatermark("ts", delay).select(F.col(key).alias("_k"), F.col("ts").alias("sample_ts"), "value")
    g = triggers.withWatermark("ts", delay).select(key, F.col("ts").alias("trigger_ts"), "event_id")
    cond = (F.col("_k") == F.col(key)) & (F.col("sample_ts") >= F.col("trigger_ts")) & (F.col("sample_ts") < F.col("trigger_ts") + F.expr(f"interval {after}"))
    return g.join(s, cond).drop("_k")
