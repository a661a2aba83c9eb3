"""Queries for user-defined tables and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import normalized_weights
from ..plans.registry import Registry, apply_table_function, scaled_with_border, vector_aggregate
from .fixtures import pixels, samples, table, vectors
from .registry import query


def _registry(spark, sf):
    """Block means of every recording and their peak, as user tables."""
    r = Registry()
    r.add_base("samples", samples(spark, sf))

    def blocks(s, down=4):
        return s.groupBy("user_id", F.floor(F.col("i") / down).alias("b")).agg(F.avg("y").alias("y"))

    def peak(b, floor=0.0):
        return b.groupBy("user_id").agg(F.round(F.greatest(F.max("y"), F.lit(floor)), 6).alias("peak"))

    r.register_table("blocks", ["user_id"], ["samples"], blocks, down=4)
    r.register_table("peaks", ["user_id"], ["blocks"], peak, floor=0.0)
    return r


def _peaks(n, floor, where="true"):
    return f"WITH b AS (SELECT user_id, i // {n} AS b, avg(y) AS y FROM samples GROUP BY 1, 2) SELECT user_id, round(greatest(max(y), {floor}::DOUBLE), 6) AS peak FROM b WHERE {where} GROUP BY 1"


@query(_peaks(4, 0.0), use="samples")
def register_table(spark, sf):
    r = _registry(spark, sf)
    done = r.populate("peaks").filter("user_id % 2 = 0")
    r.set_done("peaks", done)
    return r.fetch("peaks")


@query(_peaks(8, 0.0), use="samples")
def class_options(spark, sf):
    r = _registry(spark, sf)
    r.add(r._tables["blocks"].with_options(down=8))
    return r.fetch("peaks")


@query(_peaks(4, 100.0), use="samples")
def make_kwargs(spark, sf):
    return _registry(spark, sf).populate("peaks", floor=100.0)


@query(
    "WITH w AS (SELECT c_nationkey, c_custkey, 1 / (1 + abs(c_acctbal - 5000) / 1000) AS w FROM customer) SELECT c_custkey, round(w / sum(w) OVER (PARTITION BY c_nationkey), 10) AS w FROM w"
)
def weight_fun(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("d"))

    def fun(d, scale):
        return 1 / (1 + d / scale)

    out = normalized_weights(c, ["c_nationkey"], fun(F.col("d"), 1000.0), "w")
    return out.select("c_custkey", F.round("w", 10).alias("w"))


@query(
    "WITH m AS (SELECT vec_id, median(v) AS m, max(abs(v)) AS a FROM pixels GROUP BY 1) SELECT vec_id, x, y, round(CASE WHEN x < 2 THEN m ELSE v END / a, 8) + 0.0 AS v FROM pixels JOIN m USING (vec_id)", use="pixels"
)
def column_callables(spark, sf):
    """Border value and scaling are functions handed in by the caller."""
    img = pixels(spark, sf).select("vec_id", "x", "y", "v")
    out = scaled_with_border(img, ["vec_id"], "v", F.col("x") < 2, cval=F.median, norm=lambda v: F.max(F.abs(v)))
    return out.withColumn("v", F.round("v", 8) + 0.0)


@query("SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm FROM vectors GROUP BY 1", use="vectors", name="vector_aggregate")
def vector_aggregate_query(spark, sf):
    e = table(spark, sf, "embeddings")
    v = vector_aggregate(lambda a: (a * a).sum(axis=1) ** 0.5, F.col("embedding").cast("array<double>"), whole=True)
    return e.select("vec_id", F.round(v, 6).alias("norm"))


@query("SELECT vec_id, j // 16 AS part, round(sum(v), 6) + 0.0 AS total FROM vectors GROUP BY 1, 2", use="vectors")
def table_function(spark, sf):
    def parts(vec: list):
        for p in range(len(vec) // 16):
            yield p, float(sum(vec[p * 16 : p * 16 + 16]))

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    out = apply_table_function(e, parts, "part int, total double", ["vec"], ["vec_id"])
    return out.withColumn("total", F.round("total", 6) + 0.0)
