"""Queries for data set splits, models and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import series as T
from .fixtures import pixels, samples, table
from .registry import query

U = ["user_id"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# Split by length of items ``it (ident, pair, len)``, as parts ``sp (pair, kind)``.
_LENGTH = (
    "p AS (SELECT pair, sum(len) AS len, md5('42:' || pair) AS h FROM it GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY h, pair) - 1 AS k FROM p), "
    "a AS (SELECT *, sum(CASE WHEN k >= 2 THEN len ELSE 0 END) OVER (ORDER BY h, pair) AS upto, sum(len) OVER () AS tot, coalesce(sum(CASE WHEN k = 1 THEN len END) OVER (), 0) AS dev0 FROM k), "
    "b AS (SELECT *, k >= 2 AND upto - len < floor(tot * 0.7::DOUBLE) AS tr FROM a), t AS (SELECT *, coalesce(max(CASE WHEN tr THEN upto END) OVER (), 0) AS t FROM b), "
    "sp AS (SELECT pair, CASE WHEN k = 1 THEN 'dev' WHEN k = 0 THEN 'test' WHEN tr THEN 'train' WHEN dev0 + upto - len - t < floor(tot * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split_kind FROM t)"
)


@query(
    "WITH d AS (SELECT 'doc' || doc_id // 2 AS stem, CASE WHEN doc_id % 2 = 0 THEN '_left' ELSE '_right' END AS side, n_chars FROM documents), it AS (SELECT stem || '_*' AS pair, n_chars AS len FROM d), "
    f"{_LENGTH} SELECT stem || side AS stimulus_id, n_chars, split_kind FROM d JOIN sp ON sp.pair = stem || '_*'"
)
def length_split(spark, sf):
    """Documents as stimuli; neighbours with equal hundreds form mirror pairs."""
    side = F.when(F.col("doc_id") % 2 == 0, "_left").otherwise("_right")
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.expr("doc_id div 2").cast("string"), side).alias("stimulus_id"), "n_chars")
    return D.length_split(d, "stimulus_id", "n_chars")


@query(
    "WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) "
    "SELECT c_custkey, CASE WHEN k < greatest(least(round_even(n * 0.7::DOUBLE, 0), n - 1), 1) THEN 'train' ELSE 'test' END AS split_kind FROM s"
)
def count_split(spark, sf):
    return D.count_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 0.7)


def _points(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.withColumn("d", F.when(F.col("lang") != "de", F.col("n_chars").cast("double")))


def _fold0(rows: str, k: int, seed: int) -> str:
    """Sources in fold 0 of ``k``: in order of their strata counts and hash, dealt in turn."""
    return (
        f"SELECT source FROM (SELECT source, (row_number() OVER (ORDER BY p, md5('{seed}:' || source), source) - 1) % {k} AS f FROM "
        f"(SELECT source, list({{'s': s, 'n': -n}} ORDER BY s) AS p FROM (SELECT source, s, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1)) WHERE f = 0"
    )


@query(
    "WITH u AS (SELECT doc_id, source, n_chars::DOUBLE AS d FROM documents WHERE lang <> 'de'), e AS (SELECT quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM u), "
    f"s AS (SELECT u.*, len(list_filter(e, lambda x: d > x)) AS s FROM u, e), te AS ({_fold0('s', 4, 42)}), r AS (SELECT * FROM s WHERE source NOT IN (SELECT source FROM te)), de AS ({_fold0('r', 7, 43)}) "
    "SELECT doc_id, source, CASE WHEN lang = 'de' THEN 'none' WHEN source IN (SELECT source FROM te) THEN 'test' WHEN source IN (SELECT source FROM de) THEN 'dev' ELSE 'train' END AS split_kind FROM documents"
)
def distance_split(spark, sf):
    return D.distance_split(_points(spark, sf), "source", "d").select("doc_id", "source", "split_kind")


@query(
    "SELECT d.doc_id, lang, n_chars, n_max, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split_kind FROM documents d JOIN (SELECT lang, max(n_chars) AS n_max FROM documents GROUP BY 1) USING (lang) JOIN labels l ON l.doc_id = d.doc_id"
)
def dataset_view(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    norms = d.groupBy("lang").agg(F.max("n_chars").alias("n_max"))
    kind = F.when(F.col("quality") == 1, "train").otherwise("test")
    s = table(spark, sf, "labels").select("doc_id", kind.alias("split_kind"), F.lit(1).alias("split_id"))
    s = s.unionByName(s.withColumn("split_id", F.lit(2)))
    return D.dataset_view(d, norms, s, ["lang"], ["doc_id"], 1)


@query(
    "SELECT a.user_id, a.i AS frame, a.y AS x, b.y AS tx, count(*) OVER (PARTITION BY a.user_id) AS x_len FROM samples a JOIN samples b ON b.user_id = a.user_id AND b.i = a.i + 3 WHERE b.y < 100", use="samples"
)
def shift_target(spark, sf):
    s = samples(spark, sf).select("user_id", F.col("i").alias("frame"), F.col("y").alias("x"), F.col("y").alias("tx"))
    return D.shift_target(s, U, 3, ["tx"], F.col("tx") < 100)


@query(
    "SELECT vec_id, f::INTEGER AS flip, (CASE WHEN f IN (2, 3) THEN 7 - x ELSE x END)::INTEGER AS x, (CASE WHEN f IN (1, 3) THEN 7 - y ELSE y END)::INTEGER AS y, v, CASE WHEN f IN (2, 3) THEN -tx ELSE tx END + 0.0 AS tx, CASE WHEN f IN (1, 3) THEN -ty ELSE ty END + 0.0 AS ty "
    "FROM (SELECT vec_id, x, y, v, (vec_id % 5)::DOUBLE / 4 AS tx, (vec_id % 3)::DOUBLE / 2 AS ty FROM pixels), range(4) r(f)",
    use="pixels",
)
def augment_flips(spark, sf):
    k = F.col("vec_id")
    p = pixels(spark, sf).select("vec_id", "x", "y", "v", (k % 5 / F.lit(4.0)).alias("tx"), (k % 3 / F.lit(2.0)).alias("ty"))
    out = D.augment_flips(p, 8, 8)
    return out.withColumn("tx", F.col("tx") + 0.0).withColumn("ty", F.col("ty") + 0.0)


def _pairs(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (-F.col("l_quantity")).alias("x_wo"))
    return l.groupBy("l_orderkey", "l_linenumber").agg(F.max("x").alias("x"), F.min("x_wo").alias("x_wo"))


_PAIRS_SQL = "pr AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS x, min(-l_quantity) AS x_wo FROM lineitem GROUP BY 1, 2)"


@query(
    f"WITH {_PAIRS_SQL}, m AS (SELECT l_orderkey, l_linenumber, x, true AS p FROM pr UNION ALL SELECT l_orderkey, l_linenumber, x_wo, false FROM pr) "
    "SELECT *, row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || p), l_orderkey, l_linenumber, p) - 1 AS place FROM m"
)
def with_without_mix(spark, sf):
    return D.with_without_mix(_pairs(spark, sf), ["l_orderkey", "l_linenumber"], "x", "x_wo")


@query(
    f"WITH {_PAIRS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS k, row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) AS h, "
    "(('0x' || substr(md5('43:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 2)::INTEGER AS g FROM pr) "
    "SELECT a.l_orderkey, a.l_linenumber, a.g, CASE WHEN a.g = 0 THEN a.x ELSE b.x_wo END AS x_left, CASE WHEN a.g = 0 THEN b.x_wo ELSE a.x END AS x_right FROM n a JOIN n b ON b.h = a.k"
)
def random_sides(spark, sf):
    return D.random_sides(_pairs(spark, sf), ["l_orderkey", "l_linenumber"], "x", "x_wo")


@query()
def build_dataset(spark, sf):
    s = samples(spark, sf).select((F.col("user_id") % 4).alias("data_set_file"), "user_id", F.col("i").alias("frame"), F.col("y").alias("x"), (F.col("y") / 2).alias("x_wo"), F.col("y").alias("d"))
    splits = D.length_split(s.groupBy(F.col("user_id").cast("string").alias("sid")).agg(F.count("*").alias("n")), "sid", "n")
    splits = splits.select(F.col("sid").cast("long").alias("user_id"), "split_kind")
    out = D.build_dataset(s, U, splits, ["x"], ["d"], 2, ("x", "x_wo"))
    return _r(out, 6, "x_norm", "d_norm").select("user_id", "frame", "split_kind", "p", "x", "x_norm", "d_norm", "place")


@query(
    "SELECT c_nationkey, c_mktsegment, s::INTEGER AS sample, ('0x' || substr(md5('42:' || c_nationkey || ':' || c_mktsegment || ':' || s), 1, 8))::BIGINT % 2147483648 AS seed FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), range(3) r(s)"
)
def seeds_per_key(spark, sf):
    return D.seeds_per_key(table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 42, 3)


@query("SELECT l_orderkey, l_linenumber, round(pow(1 - coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount END, 1), 2), 10) AS w FROM lineitem")
def distance_weights(spark, sf):
    d = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(D.distance_weights(d), 10).alias("w"))


def _frames(spark, sf):
    """Vectors with a presence label, two targets and a split."""
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    x = F.col("embedding").cast("array<double>")
    kind = F.when(k % 5 == 0, "test").when(k % 5 == 1, "dev").otherwise("train")
    return e.select("vec_id", x.alias("x"), (F.col("label") < 5).alias("p"), (x[0] + x[1]).alias("tx"), (x[2] - x[3]).alias("ty"), F.abs(x[4]).alias("d"), kind.alias("split_kind"))


@query()
def train_presence(spark, sf):
    f = _frames(spark, sf)
    train, out = f.filter("split_kind = 'train'"), f.select("vec_id", "x", "p", "split_kind")
    for kind in ("baseline", "linear", "ridge", "tiniest_mlp"):
        out = D.train_presence(train, "x", "p", kind, max_iter=20)(out).withColumnRenamed("p_pred", f"p_{kind}")
    return _r(out.drop("x"), 6, "p_baseline", "p_linear", "p_ridge", "p_tiniest_mlp")


@query()
def train_position(spark, sf):
    f = _frames(spark, sf)
    train, out = f.filter("split_kind = 'train'"), f.select("vec_id", "x", "tx", "split_kind")
    for kind in ("baseline", "linear", "ridge", "boosted"):
        out = D.train_position(train, "x", ["tx"], kind)(out).withColumnRenamed("tx_pred", f"tx_{kind}")
    return _r(out.drop("x"), 6, "tx", "tx_baseline", "tx_linear", "tx_ridge", "tx_boosted")


@query()
def ensemble(spark, sf):
    f = _frames(spark, sf)
    train = f.filter("split_kind = 'train'")
    m = D.ensemble(lambda s: D.train_presence(train, "x", "p", "tiniest_mlp", seed=s, max_iter=10), 3, "p_pred")
    return _r(m(f.select("vec_id", "x", "p")).drop("x"), 6, "p_pred")


@query()
def prediction_table(spark, sf):
    f = _frames(spark, sf)
    m = D.train_presence(f.filter("split_kind = 'train'"), "x", "p", "linear")
    return _r(D.prediction_table(m, f, "linear_1", ["vec_id", "split_kind", "tx", "ty", "d", "p"]), 6, "p_pred", "tx", "ty", "d")


@query(
    "WITH p AS (SELECT l_orderkey, l_linenumber, 'dataset_w_and_wo_' || CASE WHEN l_returnflag = 'N' THEN 'nsl' ELSE 'tmp' END || '_bcnsmed' || CASE WHEN l_linestatus = 'F' THEN '_prnoise' ELSE '' END || '.pkl' AS f, (l_quantity / 25 - 1) * 500 AS x, (l_tax * 20 - 1) * 300 AS y, l_discount AS d, l_linenumber % 2 AS p, l_discount * 10 AS q FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round(d * 18 + 2, 6) AS distance, round(sqrt((x * x + y * y) / 2), 6) AS distance_center, round(least(500 - abs(x), 300 - abs(y)), 6) + 0.0 AS distance_border, (p >= 0.5) = (q >= 0.5) AS accuracy, "
    "'med' AS bc_noise, contains(f, 'prnoise')::INTEGER AS pr_noise, CASE WHEN contains(f, 'nsl') THEN 'nsl' ELSE 'tmp' END AS rgc FROM p WHERE least(500 - abs(x), 300 - abs(y)) >= 49.99999"
)
def accuracy_table(spark, sf):
    l = table(spark, sf, "lineitem")
    name = F.concat(F.lit("dataset_w_and_wo_"), F.when(F.col("l_returnflag") == "N", "nsl").otherwise("tmp"), F.lit("_bcnsmed"), F.when(F.col("l_linestatus") == "F", "_prnoise").otherwise(""), F.lit(".pkl"))
    p = l.select(
        "l_orderkey", "l_linenumber", name.alias("data_set_file"), (F.col("l_quantity") / 25 - 1).alias("tx"), (F.col("l_tax") * 20 - 1).alias("ty"), F.col("l_discount").alias("d"),
        (F.col("l_linenumber") % 2).alias("p"), (F.col("l_discount") * 10).alias("p_pred"),
    )
    norms = p.select("data_set_file").distinct().select(
        "data_set_file", F.lit(200.0).alias("y_scale_x"), F.lit(120.0).alias("y_scale_y"), F.lit(5.0).alias("pixel_size_um"), F.lit(2.0).alias("d_min"), F.lit(20.0).alias("d_max")
    )
    out = D.accuracy_table(p, norms, ["data_set_file"], "data_set_file", 49.99999)
    return _r(out, 6, "distance", "distance_center", "distance_border").drop("data_set_file", "tx", "ty", "d", "p", "p_pred")


def _curves(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return l, D.smooth_group_curves(l, "y", "l_quantity", "l_returnflag")


@query()
def smooth_group_curves(spark, sf):
    return _r(_curves(spark, sf)[1], 5, "x", "fit", "se")


@query()
def curve_difference(spark, sf):
    d = D.curve_difference(_curves(spark, sf)[1], "l_returnflag", "A", "N").withColumn("pair", F.lit("A-N"))
    hits = T.significant_intervals(d, ["pair"], "x", "est", "ci").groupBy("pair").agg(F.count("*").alias("n_intervals"))
    return _r(d.join(hits, "pair", "left").fillna(0, ["n_intervals"]), 5, "x", "est", "ci")


@query()
def curve_aic(spark, sf):
    l, _ = _curves(spark, sf)
    a = D.curve_aic(l, "y", "l_quantity", "l_returnflag", ["A", "N", "R"])
    b = D.curve_aic(l.withColumn("b", F.col("y") > 40), "b", "l_quantity", "l_returnflag", ["A", "N", "R"], "binomial", 1)
    return spark.createDataFrame([("gaussian", round(a, 3)), ("binomial", round(b, 3))], "family string, aic double")
