"""Operators without a SQL twin: what must hold for every result."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.special import chi2_sf, normal_sf, t_sf
from tessera.operators import datasets as D
from tessera.operators import features as C
from tessera.operators import grids as G
from tessera.operators import lagreg as L
from tessera.operators import trees as R

SF = "/root/testdata/sf0.001"


def test_tails(spark):
    d = spark.createDataFrame([(1.96, 5.991, 2.0, 2.228, 10.0)], "z double, x double, k double, t double, n double")
    r = d.select(normal_sf(F.col("z")), chi2_sf(F.col("x"), F.col("k")), t_sf(F.col("t"), F.col("n"))).first()
    np.testing.assert_allclose(list(r), [0.0249979, 0.0500116, 0.0250059], atol=2e-6)


def test_rank_one_split(spark):
    rng = np.random.default_rng(2)
    t, s = rng.normal(size=6), rng.normal(size=9)
    w = np.outer(t, s) + 0.01 * rng.normal(size=(6, 9))
    rf = spark.createDataFrame([(1, l, p, float(w[l, p])) for l in range(6) for p in range(9)], "k int, lag int, px int, w double")
    srf, trf, qi = L.separate_rf(rf, ["k"], 6)
    assert qi.first()["split_qidx"] > 0.99
    assert trf.agg(F.max("w")).first()[0] == 1.0
    tt = np.array([r["w"] for r in trf.orderBy("lag").collect()])
    assert abs(np.corrcoef(tt, t)[0, 1]) > 0.99 and srf.count() == 9


def test_least_squares_recovers_a_filter(spark):
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 1.0], size=(300, 2))
    true = np.array([[0.5, -1.0], [2.0, 0.25], [0.0, 1.5]])
    y = [sum(true[l] @ x[i + l - 2] for l in range(3) if i + l - 2 >= 0) for i in range(300)]
    resp = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, i long, y double")
    stim = spark.createDataFrame([(1, i, p, float(x[i, p])) for i in range(300) for p in range(2)], "k int, i long, px int, x double")
    w = L.least_squares_rf(resp, stim, ["k"], [0, 1], 3)
    got = np.array([r["w"] for r in w.orderBy("lag", "px").collect()]).reshape(3, 2)
    np.testing.assert_allclose(got, true, atol=1e-9)
    pred = L.predict_linear(w, stim, resp, ["k"], 3)
    assert pred.agg(F.max(F.abs(F.col("y") - F.col("y_pred")))).first()[0] < 1e-9


def test_spline_basis_sums_to_one():
    np.testing.assert_allclose(L.spline_basis(15, 6).sum(axis=1), 1.0)


def test_splits_are_disjoint_and_complete(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", F.col("n_chars").cast("double").alias("d"))
    s = D.distance_split(d, "source", "d")
    assert s.count() == d.count() and set(r[0] for r in s.select("split_kind").distinct().collect()) == {"train", "dev", "test"}
    assert s.groupBy("source").agg(F.count_distinct("split_kind").alias("n")).filter("n > 1").isEmpty()
    c = D.count_split(d.select("doc_id"), ["doc_id"], 0.7)
    assert c.filter("split_kind = 'train'").count() == round(0.7 * d.count())
    again = D.count_split(d.select("doc_id").repartition(7), ["doc_id"], 0.7)
    assert c.exceptAll(again).isEmpty()


def test_mix_has_every_row_twice(spark):
    d = spark.range(20).select(F.col("id"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("x_wo"))
    m = D.with_without_mix(d, ["id"], "x", "x_wo")
    assert sorted(r["place"] for r in m.collect()) == list(range(40)) and m.filter("p").count() == 20
    s = D.random_sides(d, ["id"], "x", "x_wo").toPandas()
    pos = np.where(s["g"] == 0, s["x_left"], s["x_right"])
    assert (pos == s["id"]).all() and set(s["x_left"].abs()) | set(s["x_right"].abs()) == set(range(20))


def test_pca_reconstruction_and_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5)) + 3.0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, vec array<double>")
    s, p, share = C.pca_features(df, ["id"], "vec", 2)
    rec = np.array([r["reconstructed"] for r in s.orderBy("id").collect()])
    np.testing.assert_allclose(rec, x, atol=1e-8)
    assert abs(share.sum() - 1) < 1e-9
    v = C.projection_variance(df, "vec", p.tolist()).first()
    assert abs(v["explained"] / v["total"] - 1) < 1e-9


def test_mixture_likelihood_grows_and_bic_finds_two(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(80, 2)), rng.normal(size=(80, 2)) + 8])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    c, table = C.mixture_clusters(df, ["id"], "vec", [1, 2], "likelihood")
    s = {r["k"]: r["score"] for r in table.collect()}
    assert s[2] > s[1]
    got = [r["cluster"] for r in c.orderBy("id").collect()]
    assert len(set(got[:80])) == 1 and len(set(got[80:])) == 1 and got[0] != got[-1]


def test_hull_of_hulls(spark):
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.uniform(0.1, 0.9, size=(200, 2)), [[0, 0], [1, 0], [1, 1], [0, 1]]])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in pts], "cell int, x double, y double")
    spark.conf.set("tessera.task.rows", "20")
    try:
        r = R.hull_area(df, ["cell"]).first()
    finally:
        spark.conf.unset("tessera.task.rows")
    assert r["n_corners"] == 4 and abs(r["hull_area"] - 1) < 1e-12


def test_quadratic_surface_is_exact(spark):
    rows = [(1, float(x), float(y), 1 + 2 * x - y + 0.5 * x * x + 0.25 * x * y - y * y) for x in range(6) for y in range(5)]
    s = R.fit_surface(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"])
    d = spark.createDataFrame(rows, "k int, x double, y double, z double").join(s, "k")
    assert d.agg(F.max(F.abs(F.col("z") - R.surface_at(F.col("x"), F.col("y"))))).first()[0] < 1e-9


def test_lost_labels_come_back(spark):
    m = spark.createDataFrame([(1, x, y, x * 4 + y + 1) for x in range(4) for y in range(4) if (x + y) % 2], "k int, x int, y int, roi_id int")
    small = G.resize_nearest(m, (4, 4), (3, 3))
    out = G.keep_lost_labels(m, small, ["k"], (4, 4), (3, 3))
    assert out.select("roi_id").distinct().count() == 8 and out.select("x", "y").distinct().count() == out.count()


def test_reconnect_attaches_every_loose_path(spark):
    tree = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(5)], "cell int, n long, x double, y double, z double")
    loose = spark.createDataFrame(
        [(1, 7, 0, 10, 4.0, 1.0, 0.0), (1, 7, 1, 11, 4.0, 3.0, 0.0), (1, 8, 0, 20, 4.0, 9.0, 0.0), (1, 8, 1, 21, 4.0, 5.0, 0.0)],
        "cell int, path_id int, j long, n long, x double, y double, z double",
    )
    got = {r["path_id"]: (r["attach_to"], r["by_j"], r["dist"]) for r in R.reconnect_paths(tree, loose, ["cell"]).collect()}
    assert got == {7: (4, 0, 1.0), 8: (11, 1, 2.0)}


def test_penalized_filters_are_fitted_per_key(spark):
    """Two keys with different smooth filters: each gets its own, and a useless penalty is not chosen."""
    rng = np.random.default_rng(7)
    rows, stim, true = [], [], {}
    for k in (1, 2):
        x = rng.normal(size=(400, 2))
        w = L.spline_basis(6, 5) @ rng.normal(size=(5, 2))
        true[k] = w
        y = [sum(w[l] @ x[i + l - 5] for l in range(6) if i + l - 5 >= 0) + 0.01 * rng.normal() for i in range(400)]
        rows += [(k, i, float(v)) for i, v in enumerate(y)]
        stim += [(k, i, p, float(x[i, p])) for i in range(400) for p in range(2)]
    resp = spark.createDataFrame(rows, "k int, i long, y double")
    stim = spark.createDataFrame(stim, "k int, i long, px int, x double")
    rf, scores = L.penalized_rf(resp, stim, ["k"], [0, 1], 6, [4, 5], [1e-4, 5.0], 0.5, 3, 2)
    for k in (1, 2):
        got = np.array([r["w"] for r in rf.filter(f"k = {k}").orderBy("lag", "px").collect()]).reshape(6, 2)
        np.testing.assert_allclose(got, true[k], atol=0.02)
    assert {(r["df"], r["alpha"]) for r in rf.collect()} == {(5, 1e-4)}
    assert scores.count() == 2 * 3 * 2 * 2 and scores.filter("mse is null").isEmpty()


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4)) * [1, 3, 0.5, 1] + 2
    y = x @ [1.0, 0.0, -2.0, 0.3] + rng.normal(size=200) + 5
    a = np.column_stack([x, np.ones(200), y])
    w, b = L.elastic_net(a.T @ a, 0.3, 0.5)
    z, sd = (x - x.mean(0)) / x.std(0), x.std(0)
    g = z.T @ (y - x @ w - b) / 200 - 0.15 * w * sd
    for j in range(4):
        assert abs(g[j] - 0.15 * np.sign(w[j])) < 1e-8 if w[j] else abs(g[j]) <= 0.15 + 1e-8
    assert abs((y - x @ w - b).mean()) < 1e-8 and abs(L.mean_squared_error(a.T @ a, w, b) - ((y - x @ w - b) ** 2).mean()) < 1e-8


def test_permuted_stimuli_predict_worse(spark):
    rng = np.random.default_rng(9)
    x, e = rng.choice([-1.0, 1.0], size=300), rng.normal(size=300)
    stim = spark.createDataFrame([(k, i, 0, float(x[i])) for k in (1, 2) for i in range(300)], "k int, i long, px int, x double")
    resp = spark.createDataFrame([(1, i, float(x[i])) for i in range(300)] + [(2, i, float(e[i])) for i in range(300)], "k int, i long, y double")
    rf = spark.createDataFrame([(k, 0, 0, 1.0) for k in (1, 2)], "k int, lag int, px int, w double")
    s = L.permutation_scores(rf, stim, resp, ["k"], 1, 20, 5)
    assert s.filter("perm = -1 and k = 1").first()["corrcoef"] > 0.999 and s.count() == 42
    assert s.filter("perm >= 0 and abs(corrcoef) > 0.3").isEmpty()
    q = {r["k"]: (r["perm_test_success"], r["quality"]) for r in L.permutation_quality(s, ["k"], min_cc=0.5).collect()}
    assert q[1] == (True, True) and not q[2][1]
