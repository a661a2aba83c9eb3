"""Clusters by parallel splits, mixtures fitted together, and tables without rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import features as C


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, vec array<double>")


def test_no_cluster_is_missed_without_a_limit(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 3)) * s + c for s, c in ((0.05, 0), (2.0, 20), (0.5, -9))] + [np.full((15, 3), 7.0)])
    out = C.hierarchical_clusters(vectors(spark, x), "vec", None, 1.2).toPandas().sort_values("id")
    assert not out["missed"].any() and len(out) == len(x)
    for _, part in out.groupby("cluster"):
        p = x[part["id"].to_numpy()]
        assert np.sqrt(((p - p.mean(0)) ** 2).sum(1).mean()) <= 1.2 + 1e-12
    same = out["cluster"].to_numpy()[180:]
    assert len(set(same)) == 1 and out["cluster"].nunique() > 4
    assert sorted(out["cluster"].unique()) == list(range(out["cluster"].nunique()))


def test_the_costliest_clusters_are_split_up_to_the_limit(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 2)) + c for c in ([0, 0], [50, 0], [50, 8])])
    out = C.hierarchical_clusters(vectors(spark, x), "vec", 3, 0.1).toPandas().sort_values("id")
    assert out["cluster"].nunique() == 3 and out["missed"].all()
    assert [out["cluster"].to_numpy()[40 * i : 40 * i + 40].std() for i in range(3)] == [0, 0, 0]


def test_splits_of_nothing_of_copies_and_of_broken_vectors(spark):
    schema = "id int, vec array<double>"
    assert C.hierarchical_clusters(spark.createDataFrame([], schema), "vec", None, 0.1).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0])]
    out = C.hierarchical_clusters(spark.createDataFrame(rows, schema), "vec", None, 0.0).collect()
    assert sorted((r["id"], r["cluster"], r["missed"]) for r in out) == [(1, 0, False), (2, 0, False)]


def test_all_mixtures_share_their_passes(spark, monkeypatch):
    """Jobs do not grow with the numbers of components and folds, and every fit is the one it would be alone."""
    rng = np.random.default_rng(3)
    d = vectors(spark, np.concatenate([rng.normal(size=(80, 2)) * s + c for s, c in ((0.5, 0), (1.0, 6), (0.3, -5))]))
    passes, gathered = [], C._gathered
    monkeypatch.setattr(C, "_gathered", lambda d, fits, update: passes.append(len(fits)) or gathered(d, fits, update))
    many, table = C.mixture_clusters(d, ["id"], "vec", [1, 2, 3, 4], "bic", folds=3, steps=25)
    assert max(passes) == 16 and len(passes) <= 26
    assert table.filter("best").first()["k"] == 3 and table.count() == 4
    got = [r["cluster"] for r in many.orderBy("id").collect()]
    assert all(len(set(got[80 * i : 80 * i + 80])) == 1 for i in range(3)) and len(set(got)) == 3


def test_a_step_is_that_of_the_textbook(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    fit = (np.array([0.3, 0.7]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([np.eye(2), [[2.0, 0.5], [0.5, 1.0]]]))
    d = spark.createDataFrame([([float(a) for a in v], i % 3) for i, v in enumerate(x)], "_x array<double>, _f int")
    got = C._gathered(d, {(2, 1): fit}, True)[2, 1]
    here = x[np.arange(50) % 3 != 1]
    p = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", here - m, np.linalg.inv(c), here - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(*fit)], axis=1)
    r = p / p.sum(axis=1, keepdims=True)
    want = np.concatenate([[len(here), np.log(p.sum(axis=1)).sum()], r.sum(0), (r.T @ here).ravel(), np.einsum("nk,ni,nj->kij", r, here, here).ravel()])
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_a_mixture_of_nothing(spark):
    out, table = C.mixture_clusters(spark.createDataFrame([], "id int, vec array<double>"), ["id"], "vec", [1, 2], folds=2)
    assert out.collect() == [] and out.columns == ["id", "cluster"]
    assert [(r["k"], r["score"]) for r in table.orderBy("k").collect()] == [(1, None), (2, None)]


def test_splits_and_curves_without_a_spread(spark):
    none = spark.createDataFrame([("a", None), ("b", None)], "g string, d double")
    assert {r["split_kind"] for r in D.distance_split(none, "g", "d").collect()} == {"none"}
    assert D.distance_split(none.limit(0), "g", "d").collect() == []
    flat = spark.createDataFrame([("a", 3.0, float(i)) for i in range(9)], "g string, x double, y double")
    assert [tuple(r) for r in D.smooth_group_curves(flat, "y", "x", "g").collect()] == [("a", 3.0, None, None)]
    assert D.smooth_group_curves(flat.limit(0), "y", "x", "g").collect() == [] and D.curve_aic(flat, "y", "x", "g", ["a"]) is None
    part = spark.createDataFrame([("a", float(i), float(i)) for i in range(21)] + [("b", float(i), 1.0) for i in range(5, 11)], "g string, x double, y double")
    got = {(r["g"], round(r["x"])): r["fit"] for r in D.smooth_group_curves(part, "y", "x", "g").collect()}
    assert got["b", 4] is None and got["b", 11] is None and got["b", 7] == pytest.approx(1.0, abs=1e-6)
    assert all(got["a", i] == pytest.approx(i, abs=1e-6) for i in range(21))


@pytest.mark.parametrize("tile", [512, 3])
def test_correlations_of_positions_in_tiles(spark, tile):
    from tessera.operators.stats import pairwise_corr

    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 8)) @ rng.normal(size=(8, 8)) + 1e6
    x[:, 5] = 4.0
    got = {(r["a"], r["b"]): r["r"] for r in pairwise_corr(vectors(spark, x).repartition(3), "vec", tile, 16).collect()}
    assert sorted(got) == [(a, b) for a in range(8) for b in range(a + 1, 8)]
    for (a, b), r in got.items():
        assert (r is None) == (5 in (a, b)) and (r is None or r == pytest.approx(np.corrcoef(x[:, a], x[:, b])[0, 1], abs=1e-6))
    assert pairwise_corr(vectors(spark, x).limit(0), "vec").collect() == []


def test_ridge_models_of_all_targets_come_from_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4)) * [1, 3, 0.2, 1] + 2
    y = np.stack([x @ [1, 0, -2, 0.5] + rng.normal(size=200), x @ [0, 1, 0, 0] + 3], axis=1)
    rows = [(i, [float(v) for v in x[i]], float(y[i, 0]), float(y[i, 1])) for i in range(200)] + [(900, None, 1.0, 1.0), (901, [0.0] * 4, None, 1.0)]
    d = spark.createDataFrame(rows, "id int, x array<double>, a double, b double")
    passes, grams = [], D._grams
    monkeypatch.setattr(D, "_grams", lambda *q: passes.append(1) or grams(*q))
    out = D.train_position(d, "x", ["a", "b"], "ridge", (0.01, 0.5))(d.filter("x is not null")).orderBy("id").collect()
    assert len(passes) == 1
    z = (x - x.mean(0)) / x.std(0)
    for k, t in enumerate(("a_pred", "b_pred")):
        fits = {a: z @ np.linalg.solve(z.T @ z / 200 + a * np.eye(4), z.T @ (y[:, k] - y[:, k].mean()) / 200) + y[:, k].mean() for a in (0.01, 0.5)}
        got = np.array([r[t] for r in out[:200]])
        assert min(np.abs(got - f).max() for f in fits.values()) < 1e-8
    plain = D.train_position(d.filter("id < 200"), "x", ["b"], "linear")(d.filter("id < 200")).orderBy("id").collect()
    np.testing.assert_allclose([r["b_pred"] for r in plain], y[:, 1], atol=1e-8)
    mean = D.train_position(d, "x", ["a"], "baseline")(d.filter("id < 3")).collect()
    assert {round(r["a_pred"], 9) for r in mean} == {round(float(y[:, 0].mean()), 9)}
    assert [r["a_pred"] for r in D.train_position(d.limit(0), "x", ["a"], "ridge")(d.filter("id = 1")).collect()] == [None]


def test_clusters_split_in_one_task_are_those_of_the_levels(spark, monkeypatch):
    """The same clusters and numbers, and no rounds over all tasks where a task holds the cluster."""
    rng = np.random.default_rng(12)
    df = vectors(spark, np.concatenate([rng.normal(size=(60, 4)) * s + rng.normal(size=4) * 5 for s in (0.2, 1.0, 2.0)]))
    calls, means = [], C._two_means
    monkeypatch.setattr(C, "_two_means", lambda *a: calls.append(1) or means(*a))
    got = {r["id"]: (r["cluster"], r["missed"]) for r in C.hierarchical_clusters(df, "vec", None, 1.0).collect()}
    assert not calls and len(set(got.values())) > 10
    for numbers in (0, 120):
        monkeypatch.setattr(C, "SPLIT_NUMBERS", numbers)
        want = {r["id"]: (r["cluster"], r["missed"]) for r in C.hierarchical_clusters(df, "vec", None, 1.0).collect()}
        assert calls and got == want
