"""Queries for streams: the events file is read as a stream until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import streams as S
from .fixtures import table
from .registry import query


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = S.stream_new_files(spark, sf, schema, name_filter="events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _back(spark, path, *cols):
    """Timestamps as the tables have them, floats rounded."""
    d = spark.read.parquet(path)
    for n, t in d.dtypes:
        if t == "timestamp":
            d = d.withColumn(n, F.col(n).cast("timestamp_ntz"))
        elif t == "double":
            d = d.withColumn(n, F.round(n, 6) + 0.0)
    return d


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("SELECT event_id, user_id, value FROM events")
def stream_new_files(spark, sf):
    return _back(spark, S.run_available(_events(spark, sf).select("event_id", "user_id", "value"), "files"))


@query("SELECT user_id, user_id * 2 AS twice FROM (SELECT DISTINCT user_id FROM events)")
def stream_populate(spark, sf):
    path = scratch_path(spark, "populate")
    for run in ("first", "again"):
        S.stream_populate(_events(spark, sf), ["user_id"], lambda d: d.select("user_id", (F.col("user_id") * 2).alias("twice")), path, f"{path}-{run}")
    return S.populated(spark, path)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    d = S.stream_dedupe(_events(spark, sf), ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return _back(spark, S.run_available(d, "dedupe"))


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, round(avg(value), 6) AS y, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_block_mean(spark, sf):
    return _back(spark, S.run_available(S.stream_block_mean(_events(spark, sf), ["event_type"], 3600, "1 hour"), "blocks"))


@query(
    "WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start FROM events, range(3) r(k)) "
    f"SELECT event_type, start, start + INTERVAL 6 HOUR AS \"end\", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) + 0.0 AS std, count(*) AS n FROM w WHERE start + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY 1, 2"
)
def stream_sliding_stats(spark, sf):
    return _back(spark, S.run_available(S.stream_sliding_stats(_events(spark, sf), ["event_type"], "6 hours", "2 hours", "1 hour"), "sliding"))


@query(
    "WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INTEGER AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM g) "
    f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, b HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}"
)
def stream_bouts(spark, sf):
    return _back(spark, S.run_available(S.stream_bouts(_events(spark, sf), ["user_id"], "6 hours", "1 hour"), "bouts"))


@query(
    "WITH p AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM p WHERE value >= 50 AND b < 50) "
    f"SELECT user_id, ts, value FROM c WHERE (pt IS NULL OR ts - pt >= INTERVAL 12 HOUR) AND ts < {_CLOSED}"
)
def stream_triggers(spark, sf):
    return _back(spark, S.run_available(S.stream_triggers(_events(spark, sf), {"user_id": "bigint"}, 50.0, 43200.0, "1 hour"), "triggers"))


@query(
    "SELECT t.user_id, t.event_id, t.ts AS trigger_ts, s.ts AS sample_ts, s.value FROM events t JOIN events s ON s.user_id = t.user_id AND s.ts >= t.ts AND s.ts < t.ts + INTERVAL 12 HOUR WHERE t.event_type = 'click'"
)
def stream_interval_join(spark, sf):
    s = _events(spark, sf)
    g = _events(spark, sf).filter("event_type = 'click'")
    return _back(spark, S.run_available(S.stream_interval_join(s, g, "user_id", "12 hours", "1 hour"), "intervals"))
