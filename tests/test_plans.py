import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.asof import asof, closer
from tessera.plans.components import components
from tessera.plans.near import nearest_point
from tessera.plans.quantile import quantiles, rank_table
from tessera.plans.scan import halo, own, scan


def frame(n=60, seed=1):
    r = random.Random(seed)
    # Two thirds of the rows share one key.
    return pd.DataFrame({"k": [r.choice([0, 0, 1]) if i % 5 else 2 for i in range(n)], "t": r.sample(range(1000), n), "v": [r.choice([None, 1.0, 2.5, 4.0]) for _ in range(n)]})


def test_scan_matches_pandas(either):
    pdf = frame().sort_values(["k", "t"]).reset_index(drop=True)
    df = either.createDataFrame(pdf.replace({np.nan: None}), "k int, t int, v double")
    out = scan(
        df, ["k"], ["t"], i=("index", F.lit(1)), s=("sum", F.col("v")), m=("max", F.col("v")), l=("last", F.col("v")),
        a=("after", F.col("v")), p=("prev", F.col("t")), n=("next", F.col("t")),
    ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.groupby("k")
    assert out["i"].tolist() == g.cumcount().tolist()
    np.testing.assert_allclose(out["s"].fillna(0), g["v"].transform(lambda v: v.fillna(0).cumsum()))
    np.testing.assert_array_equal(out["l"], g["v"].ffill())
    np.testing.assert_array_equal(out["a"], g["v"].bfill())
    np.testing.assert_array_equal(out["m"], g["v"].transform(lambda v: v.cummax().ffill()))
    np.testing.assert_array_equal(out["p"], g["t"].shift(1))
    np.testing.assert_array_equal(out["n"], g["t"].shift(-1))


def test_scan_without_keys_and_partition_count(either):
    df = either.range(50).select((F.col("id") * 7 % 50).alias("o"))
    for parts in (1, 13):
        out = scan(df.repartition(parts), [], ["o"], i=("index", F.lit(1)))
        assert out.filter("i != o").isEmpty()


def test_quantiles_interpolate(either):
    pdf = frame(80, 3).dropna()
    df = either.createDataFrame(pdf, "k int, t int, v double")
    out = quantiles(df, ["k"], "t", a=0.5, b=0.025, c=0.9).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(out.loc[k], np.percentile(g["t"], [50, 2.5, 90]))


def test_ranks_are_averaged(either):
    df = either.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "b"), (3.0, "b"), (2.0, "c")], "v double, g string")
    got = {(r["v"], r["g"]): r["rank"] for r in rank_table(df, "v", "g").collect()}
    assert got == {(1.0, "a"): 1.0, (2.0, "a"): 3.0, (2.0, "b"): 3.0, (2.0, "c"): 3.0, (3.0, "b"): 5.0}


def test_halo_frames_do_not_depend_on_chunks(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("y"))
    got = []
    for chunk in (4, 1000):
        cut, w = halo(df, ["k"], 3, 2, chunk=chunk)
        got.append(sorted(own(cut.withColumn("s", F.sum("y").over(w.rowsBetween(-3, 2)))).select("i", "s").collect()))
    assert got[0] == got[1] and len(got[0]) == 40


def test_nearest_in_time_takes_the_earlier_on_ties(either):
    s = either.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0)], "k int, t double")
    p = either.createDataFrame([(1, 0.5), (1, 1.6), (1, 2.0), (1, -1.0), (2, 0.0)], "k int, t double")
    d = asof(p, s.withColumn("y", F.col("t")), ["k"], "t", b="before", a="after_open")
    got = {(r["k"], r["t"]): r["n"] for r in d.select("k", "t", closer(F.col("b"), F.col("a"), F.col("t"))["t"].alias("n")).collect()}
    assert got == {(1, 0.5): 0.0, (1, 1.6): 2.0, (1, 2.0): 2.0, (1, -1.0): 0.0, (2, 0.0): None}


def test_nearest_point_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    # Copies, and a dense spot far smaller than a broadcast cell.
    cloud = np.concatenate([rng.normal(size=(150, 2)), np.tile([[3.0, 3.0]], (60, 1)), 1 + 1e-4 * rng.normal(size=(200, 2)), [[400.0, 400.0]]])
    pts = rng.normal(size=(80, 2)) * 3
    c = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "id int, x double, y double")
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(pts)], "pid int, x double, y double")
    got = {r["pid"]: r["id"] for r in nearest_point(p, c, ["pid"], ["x", "y"], "id").collect()}
    d = ((pts[:, None] - cloud[None]) ** 2).sum(axis=2)
    assert got == {i: int(row.argmin()) for i, row in enumerate(d)}


def test_components_of_chain_star_and_loner(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, j) for j in range(101, 130)]
    v = spark.createDataFrame([(i,) for i in [*range(31), *range(100, 130), 500]], "v long")
    e = spark.createDataFrame(edges, "a long, b long")
    got = dict(components(v, e).collect())
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 130)) and got[500] == 500
