"""Domain tables read from the given parquet tables, in Spark and in SQL.

samples: ``events`` per user in time order; triggers: every 8th sample from the 5th on;
vectors and pixels: ``embeddings`` with the 64 numbers as an 8 x 8 image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import indexed

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC, so that seconds keep their microseconds in a double


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(col: str = "ts"):
    return (F.unix_micros(F.col(col).cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_id", seconds().alias("t"), F.col("value").alias("y"))
    return indexed(ev, ["user_id"], ["t", "event_id"]).select("user_id", "i", "t", "y")


def typed_samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type", seconds().alias("t"), F.col("value").alias("y"))
    return indexed(ev, ["user_id"], ["t", "event_id"]).select("user_id", "i", "t", "y", "event_type")


def triggers(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf).filter("i % 8 = 4")
    return s.select("user_id", F.expr("(i - 4) div 8").alias("k"), "t")


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").filter("event_type = 'click'")
    ev = ev.select("user_id", "event_id", seconds().alias("t"))
    return indexed(ev, ["user_id"], ["t", "event_id"], "k").select("user_id", "k", "t")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("j", "v"))
    return e.withColumn("v", F.col("v").cast("double"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", "label", (F.col("j") % 8).alias("x"), F.expr("int(j div 8)").alias("y"), "v")


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """Label image: 1 for bright pixels, 2 for dark ones; the rest is background."""
    v = F.col("v")
    p = pixels(spark, sf).withColumn("roi_id", F.when(v > 0.1, 1).when(v < -0.1, 2))
    return p.filter("roi_id is not null").select("vec_id", "x", "y", "roi_id")


SQL_TABLES: dict[str, tuple[str, str]] = {
    "ev": ("", f"SELECT user_id, event_id, event_type, (epoch_us(ts) - {EPOCH_US})::DOUBLE / 1e6::DOUBLE AS t, value AS y FROM events"),
    "typed_samples": (
        "ev",
        "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, t, y, event_type FROM ev",
    ),
    "samples": ("typed_samples", "SELECT user_id, i, t, y FROM typed_samples"),
    "triggers": ("samples", "SELECT user_id, (i - 4) // 8 AS k, t FROM samples WHERE i % 8 = 4"),
    "clicks": (
        "ev",
        "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k, t FROM ev WHERE event_type = 'click'",
    ),
    "vectors": (
        "",
        "SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings",
    ),
    "pixels": ("vectors", "SELECT vec_id, label, j % 8 AS x, j // 8 AS y, v FROM vectors"),
    "mask": (
        "pixels",
        "SELECT vec_id, x, y, CASE WHEN v > 0.1 THEN 1 WHEN v < -0.1 THEN 2 END AS roi_id FROM pixels WHERE abs(v) > 0.1",
    ),
}
