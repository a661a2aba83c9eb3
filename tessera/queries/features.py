"""Queries for features and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as C
from .fixtures import table, vectors
from .registry import query

V = ["vec_id"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def _averages(spark, sf):
    """Two stimuli per vector; some lack the second, some have a shorter first."""
    v, k, j = vectors(spark, sf), F.col("vec_id"), F.col("j")
    first = v.filter((j < 32) & ((k % 5 != 0) | (j < 30))).select("vec_id", F.lit("chirp").alias("stim_name"), "j", "v")
    return first.unionByName(v.filter((j >= 32) & (k % 7 != 0)).select("vec_id", F.lit("spot").alias("stim_name"), (j - 32).alias("j"), "v"))


@query("SELECT vec_id, CASE WHEN j < 32 THEN 'chirp' ELSE 'spot' END AS stim_name, j % 32 AS j, v FROM vectors WHERE vec_id % 7 <> 0 AND label < 8 AND (j < 30 OR j >= 32)", use="vectors")
def feature_table(spark, sf):
    rois = table(spark, sf, "embeddings").filter("label < 8").select("vec_id")
    return C.feature_table(rois, _averages(spark, sf), V, ["chirp", "spot"])


@query()
def pca_features(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = C.pca_features(e, V, "embedding", 3)[0]
    return s.select("vec_id", *[F.round(F.col("score")[i], 6).alias(f"pc{i}") for i in range(3)])


@query("SELECT vec_id, j, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS v FROM vectors WINDOW w AS (PARTITION BY j)", use="vectors")
def standardize_features(spark, sf):
    e = C.standardize_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), V, "embedding")
    return _r(e.select("vec_id", F.posexplode("embedding").alias("j", "v")), 6, "v")


@query(
    "WITH c AS (SELECT vec_id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM vectors), t AS (SELECT vec_id, j // 32 AS k, sum(v) / 32 AS t FROM c GROUP BY 1, 2) "
    "SELECT round((SELECT sum(t * t) * 32 FROM t), 6) AS explained, round((SELECT sum(v * v) FROM c), 6) AS total",
    use="vectors",
)
def projection_variance(spark, sf):
    p = [[float(j < 32), float(j >= 32)] for j in range(64)]
    return _r(C.projection_variance(table(spark, sf, "embeddings"), "embedding", p), 6, "explained", "total")


def _features(spark, sf):
    t = C.feature_table(table(spark, sf, "embeddings").select("vec_id"), _averages(spark, sf), V, ["chirp", "spot"])
    return C.compute_features(t, V, {"chirp": 2, "spot": 2}, "pca", pre=True, post=True)


@query()
def compute_features(spark, sf):
    f = _features(spark, sf)
    return f.select("vec_id", "features_idx", *[F.round(F.col("features")[i], 5).alias(f"f{i}") for i in range(4)])


@query()
def hierarchical_clusters(spark, sf):
    return C.hierarchical_clusters(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", None, 0.9).select("vec_id", "cluster", "missed")


@query("SELECT vec_id, FALSE AS missed, TRUE AS near FROM embeddings")
def cluster_spread(spark, sf):
    """Every vector lies in a cluster whose root mean squared distance to its mean is at most the limit."""
    c = C.hierarchical_clusters(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", None, 0.9)
    x = c.select("cluster", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    wide = x.groupBy("cluster", "j").agg(F.var_pop("x").alias("s")).groupBy("cluster").agg((F.sqrt(F.sum("s")) <= 0.9 + 1e-9).alias("near"))
    return c.join(wide, "cluster").select("vec_id", "missed", "near")


_MEANS = "mn AS (SELECT label, j, avg(v) AS m FROM vectors GROUP BY 1, 2), ds AS (SELECT a.label AS a, b.label AS b, 1 - corr(a.m, b.m) AS d FROM mn a JOIN mn b ON a.j = b.j AND a.label < b.label GROUP BY 1, 2)"


def _distances(spark, sf):
    m = vectors(spark, sf).groupBy("label", "j").agg(F.avg("v").alias("m"))
    return C.correlation_distance(m, "label", "j", "m")


@query(f"WITH {_MEANS} SELECT a, b, round(d, 6) AS distance FROM ds", use="vectors")
def correlation_distance(spark, sf):
    return _r(_distances(spark, sf), 6, "distance")


@query(
    f"WITH {_MEANS}, e AS (SELECT a, b FROM ds WHERE d < 0.9 UNION ALL SELECT b, a FROM ds WHERE d < 0.9), r AS (SELECT DISTINCT label, label AS m FROM mn UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.label) SELECT label, min(m) AS cluster FROM r GROUP BY 1",
    use="vectors",
)
def correlation_clusters(spark, sf):
    return C.correlation_clusters(_distances(spark, sf), table(spark, sf, "embeddings").select("label").distinct(), "label", 0.9)


@query()
def mixture_clusters(spark, sf):
    f = _features(spark, sf)
    return C.mixture_clusters(f, V, "features", [1, 2, 3], "bic", folds=2)[0]


@query(
    "WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10.0::DOUBLE AS b FROM customer), g(k, w, ma, mb, va, vb, c) AS (VALUES (0, 0.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 4.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE), (1, 0.3, 5.0, 1.5, 9.0, 0.5, 0.0), (2, 0.2, 8.0, 1.0, 1.0, 2.0, -0.3)), "
    "d AS (SELECT c_custkey, k, w / (2 * pi() * sqrt(va * vb - c * c)) * exp(-0.5 * (vb * (a - ma) * (a - ma) - 2 * c * (a - ma) * (b - mb) + va * (b - mb) * (b - mb)) / (va * vb - c * c)) AS p FROM x, g) "
    "SELECT c_custkey, k, round(p / sum(p) OVER (PARTITION BY c_custkey), 6) AS share FROM d"
)
def mixture_responsibilities(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10.0).alias("x"))
    share = C.responsibilities(F.col("x"), [0.5, 0.3, 0.2], [[1.0, 0.5], [5.0, 1.5], [8.0, 1.0]], [[[4.0, 0.5], [0.5, 1.0]], [[9.0, 0.0], [0.0, 0.5]], [[1.0, -0.3], [-0.3, 2.0]]])
    return _r(c.select("c_custkey", F.posexplode(share).alias("k", "share")), 6, "share")


@query("SELECT vec_id, ('0x' || substr(md5('1:' || vec_id), 1, 8))::BIGINT % 3 AS fold FROM embeddings")
def md5_fold(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", C.md5_fold(["vec_id"], 3).cast("long").alias("fold"))


@query(
    "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) AS c FROM n WHERE n > 60) SELECT c_custkey, coalesce(c, -1)::INTEGER AS c_nationkey FROM customer LEFT JOIN k USING (c_nationkey)"
)
def drop_small_clusters(spark, sf):
    return C.drop_small_clusters(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


def _assigned(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") > 7, -1).otherwise(F.col("label") + 1).alias("cluster"))


_ASG = "asg AS (SELECT vec_id, CASE WHEN label > 7 THEN -1 ELSE label + 1 END AS cluster FROM embeddings)"


@query(
    f"WITH {_ASG}, mn AS (SELECT cluster, j, avg(v) AS m FROM vectors JOIN asg USING (vec_id) WHERE cluster <> -1 GROUP BY 1, 2), bg AS (SELECT arg_max(cluster, (n, -cluster)) AS b FROM (SELECT cluster, count(*) AS n FROM asg WHERE cluster <> -1 GROUP BY 1)), "
    "cc AS (SELECT a.cluster, round(corr(a.m, r.m), 9) AS c FROM mn a JOIN mn r ON r.j = a.j AND r.cluster = (SELECT b FROM bg) GROUP BY 1), k AS (SELECT cluster, row_number() OVER (ORDER BY c DESC, cluster) AS k FROM cc) "
    "SELECT vec_id, coalesce(k, -1)::INTEGER AS cluster FROM asg LEFT JOIN k USING (cluster)",
    use="vectors",
)
def order_clusters(spark, sf):
    return C.order_clusters(_assigned(spark, sf), vectors(spark, sf), V, "cluster")


@query()
def cluster_table(spark, sf):
    params = {"kind": "mixture", "decomposition": "pca", "ks": [2, 3], "min_count": 5}
    return C.cluster_table(_features(spark, sf), vectors(spark, sf), V, params)


@query(f"WITH {_ASG} SELECT cluster, j, round(avg(v), 8) + 0.0 AS mean, round(stddev_pop(v), 8) AS std, count(*) AS n FROM vectors JOIN asg USING (vec_id) WHERE j * 0.5 >= 1 AND j * 0.5 < 20 GROUP BY 1, 2", use="vectors")
def cluster_mean(spark, sf):
    v = vectors(spark, sf).withColumn("t", F.col("j") * F.lit(0.5))
    return _r(C.cluster_mean(_assigned(spark, sf), v, V, "cluster", (1.0, 20.0)), 8, "mean", "std")
