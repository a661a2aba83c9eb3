"""Small frames with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import datasets as D
from tessera.operators import features as C
from tessera.operators import grids as G
from tessera.operators import joins as J
from tessera.operators import keys as K
from tessera.operators import series as T
from tessera.operators import stats as A
from tessera.operators import trees as R

KEY = ["k"]


def trace(spark, ys, dt=1.0):
    return spark.createDataFrame([(1, i, i * dt, float(y)) for i, y in enumerate(ys)], "k int, i long, t double, y double")


def col(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_trigger_crossings(either):
    assert col(T.detect_triggers(trace(either, [0, 0, 4e4, 4e4, 0, 0, 4e4]), KEY, 3e4, 1), "i") == [2, 6]


def test_trigger_debounce_compares_with_the_dropped_one_too(either):
    # Crossings at 1, 4, 7: the second is too close to the first, the third to the dropped second.
    y = [0, 9, 0, 0, 9, 0, 0, 9, 0]
    assert col(T.detect_triggers(trace(either, y), KEY, 5, 4), "i") == [1]


def test_trigger_on_at_the_start(either):
    # The other pulses last 2 samples beyond their first, so the first one began 2 before its end.
    y = [9, 9, 9, 0, 0, 9, 9, 9, 0, 0, 9, 9, 9, 0]
    assert col(T.detect_triggers(trace(either, y), KEY, 5, 1), "i") == [1, 5, 10]


def test_repetitions_and_dropped_last(either):
    s = either.createDataFrame([(1, i, i * 0.25, float(i)) for i in range(19)], "k int, i long, t double, y double")
    g = either.createDataFrame([(1, n, float(n + 1)) for n in range(4)], "k int, k2 long, t double").select("k", F.col("k2").alias("n"), "t")
    g = g.select(F.col("k").alias("cell"), F.col("n").alias("k"), "t")
    s = s.withColumnRenamed("k", "cell")
    r = T.repetition_starts(s, g, ["cell"], 1, tol=0.128)
    assert [(x["rep"], x["i0"], x["n_frames"], x["dropped_last"]) for x in r.orderBy("rep").collect()] == [(0, 4, 4, 1), (1, 8, 4, 1), (2, 12, 4, 1)]


def test_baseline_leaves_out_its_last_sample(either):
    s = trace(either, [1, 2, 100, 5, 6])
    t0 = either.createDataFrame([(1, 3.0)], "k int, t0 double")
    assert col(T.baseline(s, t0, KEY), "y") == [1.0, 2.0]
    assert col(T.subtract_baseline(s, t0, KEY), "y") == [-0.5, 0.5, 98.5, 3.5, 4.5]


def test_block_means_drop_the_remainder(spark):
    d = T.downsample_blocks(trace(spark, range(7)), KEY, 3)
    assert col(d, "y") == [1.0, 4.0] and col(d, "t") == [0.0, 3.0]


def test_detrend_removes_a_polynomial(spark):
    y = [0.5 * i**3 - 2 * i + 1 for i in range(25)]
    assert max(abs(v) for v in col(T.detrend_poly(trace(spark, y), KEY, 9, 3), "y")) < 1e-6


def test_peaks_and_prominence(either):
    y = [0, 2, 2, 1, 5, 0, 3, 1, 4, 0]
    got = T.find_peaks(trace(either, y), KEY, height=2.5, prominence=2.0).orderBy("i").collect()
    assert [(r["i"], r["y"], r["prominence"]) for r in got] == [(4, 5.0, 5.0), (6, 3.0, 2.0), (8, 4.0, 4.0)]
    assert col(T.find_peaks(trace(either, y), KEY), "i") == [1, 4, 6, 8]


def test_diagonal_pixels(spark):
    m = spark.createDataFrame([(1, x, x, 1) for x in range(4)], "k int, x int, y int, roi_id int")
    assert G.connected_components(m, KEY, 8).select("roi_id").distinct().count() == 1
    assert G.connected_components(m, KEY, 4).select("roi_id").distinct().count() == 4
    assert G.clean_labels(m, KEY, 0, 3, 8).count() == 4 and G.clean_labels(m, KEY, 0, 3, 4).count() == 0


def test_shifted_masks(spark):
    a = [(3, 3, 1), (3, 4, 1), (5, 5, 2)]
    mk = lambda k, px: [(k, x, y, r) for x, y, r in px]
    schema = "k int, x int, y int, roi_id int"
    one = spark.createDataFrame(mk(1, a) + mk(2, a) + mk(3, a), schema)
    two = spark.createDataFrame(mk(1, a) + mk(2, [(x - 1, y + 2, r) for x, y, r in a]) + mk(3, [(0, 0, 1), (3, 3, 9), (7, 7, 4)]), schema)
    got = {r["k"]: (r["relation"], r["dx"], r["dy"]) for r in J.compare_masks(one, two, KEY, 8, 8, 2).collect()}
    assert got == {1: ("same", 0, 0), 2: ("shifted", 1, -2), 3: ("different", None, None)}


def test_tree_paths_and_distance(spark):
    # 0-1-2, then branches 3-4 and 5; 6 hangs on 4 beside 7, 8 doubles the place of 7.
    rows = [(0, -1, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4), (5, 2, 9), (6, 4, 5), (7, 4, 6)]
    n = spark.createDataFrame([(1, a, p, float(x), 0.0, 0.0) for a, p, x in rows], "cell int, n long, parent long, x double, y double, z double")
    pts = R.split_paths(n, ["cell"])
    paths = {}
    for r in pts.orderBy("path_id", "j").collect():
        paths.setdefault(r["path_id"], []).append(r["n"])
    assert paths == {1: [0, 1, 2], 3: [2, 3, 4], 5: [2, 5], 6: [4, 6], 7: [4, 7]}
    par = R.path_parents(pts, ["cell"])
    far = {(r["path_id"], r["j"]): r["dist"] for r in R.distance_to_root(pts, par, ["cell"]).collect()}
    assert far[(7, 1)] == 6.0 and far[(5, 1)] == 9.0 and far[(3, 1)] == 3.0
    dup = n.unionByName(spark.createDataFrame([(1, 8, 4, 6.0, 0.0, 0.0)], n.schema))
    assert R.dedupe_nodes(dup, ["cell"]).count() == 7


def test_cluster_labels_and_order(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate([5, 7, 7, 7, 9, 9, 9])], "id int, c int")
    got = [r["c"] for r in C.drop_small_clusters(d, "c", 1).orderBy("id").collect()]
    assert got == [-1, 1, 1, 1, 2, 2, 2]
    assert {r["c"] for r in C.drop_small_clusters(d, "c", 3).collect()} == {-1}


def test_rank_tests_with_ties(spark):
    rows = [("a", v) for v in (1, 2, 2, 3)] + [("b", v) for v in (2, 4, 5, 5)] + [("c", v) for v in (6, 7, 7, 8)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    k = A.kruskal_wallis(df, "v", "g").first()
    # Rank sums 12, 24, 42; ties of three and two pairs. Two degrees of freedom: p = exp(-h / 2).
    assert k["h"] == pytest.approx((621 / 13 - 39) / (1 - 36 / 1716)) and k["p"] == pytest.approx(0.011349, abs=1e-5)
    p = A.dunn_posthoc(df, "v", "g").orderBy("group_a", "group_b").collect()
    assert [(r["group_a"], r["group_b"]) for r in p] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert all(r["p_adj"] >= r["p"] for r in p)


def test_mirror_pairs_stay_together(spark):
    rows = [("a_left", 10), ("a_right", 12), ("b", 5), ("c_left", 7), ("c_right", 7), ("d", 30), ("e", 9), ("f_left", 3)]
    d = D.length_split(spark.createDataFrame(rows, "s string, n long"), "s", "n")
    kind = {r["s"]: r["split_kind"] for r in d.collect()}
    assert len(kind) == 8 and kind["a_left"] == kind["a_right"] and kind["c_left"] == kind["c_right"]
    assert set(kind.values()) == {"train", "dev", "test"}


def test_relational_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    with pytest.raises(ValueError):
        K.natural_join(a, b, KEY)
    with pytest.raises(ValueError):
        K.merge_keys(a, b, KEY)
    with pytest.raises(ValueError):
        K.insert_or_check(a, b, KEY)
    once = K.insert_skip_duplicates(a, b, KEY)
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, K.insert_skip_duplicates(once, b, KEY).collect())) == sorted(map(tuple, once.collect()))


def test_values_outside_the_rules_raise(spark):
    d = spark.createDataFrame([(9, 10, 1.0)], "s int, n int, z double")
    with pytest.raises(Exception, match="out of range"):
        d.select(S.pixel_size(F.col("s"), F.col("n"), F.col("z"))).collect()
    v = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 2.0)], "k int, j int, v double")
    with pytest.raises(Exception, match="differ too much"):
        S.stack_rows(v, KEY, "j", "v", "truncate").collect()
