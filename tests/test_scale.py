"""No caps, no silent drops, no repeated reads: what the first version of these operators got wrong."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import features as C
from tessera.operators import grids as G
from tessera.operators import series as T
from tessera.operators import trees as R
from tessera.plans.near import nearest_point
from tessera.plans.registry import vector_aggregate
from tessera.plans.stats import join_stats
from tessera.queries import QUERIES
from tessera.session import once
from tessera.sources import files as N
from tessera.streaming import streams as S

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return len(re.findall(r"FileScan|Scan ExistingRDD", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name,most", [("preprocess", 10), ("response_quality_flags", 12), ("chirp_features", 12), ("normalize", 10), ("size_tuning", 12), ("average_snippets", 10)])
def test_chains_do_not_read_their_source_again_and_again(spark, name, most):
    assert scans(QUERIES[name](spark, SF)) <= most


def test_join_stats_runs_a_costly_input_once(spark):
    d = spark.range(100).groupBy((F.col("id") % 5).alias("k")).agg(F.sum("id").alias("v"))
    plan = join_stats(d, ["k"], m=F.max("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    plain = spark.range(5)
    assert once(plain) is plain


def test_many_groups_are_dealt_like_few(spark):
    rows = [(g, s) for g in range(3000) for s in range(g % 4 + 1)]
    folds = D.group_folds(spark.createDataFrame(rows, "g int, s int"), "g", "s", 5, 1).toPandas().set_index("g")["fold"]
    per = np.zeros((5, 4))
    for g, s in rows:
        per[folds[g], s] += 1
    assert len(folds) == 3000 and (np.ptp(per, axis=0) <= 4).all()


def test_every_centre_keeps_its_pixels(spark):
    pix = [(1, x, y, 1.0, 1.0 + (x % 6 == 3 and y % 6 == 3) * (1 + x / 100), 0.0, 0.0) for x in range(60) for y in range(60)]
    d = spark.createDataFrame(pix, "k int, x int, y int, cell double, centre double, ox double, oy double")
    lab = G.assign_to_centres(d, ["k"], 0.5, 1.5)
    assert lab.select("roi_id").distinct().count() == 100


def test_distances_of_many_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 7))
    m[4] = 2.0
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(7)], "k int, j int, v double")
    got = {(r["a"], r["b"]): r["distance"] for r in C.correlation_distance(long, "k", "j", "v", block=8).collect()}
    assert len(got) == 30 * 29 // 2
    for (a, b), d in got.items():
        assert a < b and (d is None) == (4 in (a, b))
        if d is not None:
            assert d == pytest.approx(1 - np.corrcoef(m[a], m[b])[0, 1])


def test_clusters_say_where_the_distance_is_missed(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.01 + c for c in ([0, 0], [9, 0], [0, 9], [9, 9], [20, 20])])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, vec array<double>")
    free = C.hierarchical_clusters(df, "vec", None, 0.1)
    assert free.filter("missed").isEmpty() and free.select("cluster").distinct().count() >= 5
    assert not C.hierarchical_clusters(df, "vec", 2, 0.1).filter("missed").isEmpty()


def loose_paths(n):
    return [(1, p, j, 1000 + 2 * p + j, float(p * 3 + 1 + j), 0.0, 0.0) for p in range(n) for j in range(2)]


def test_loose_paths_hang_on_whatever_is_nearest_then(spark):
    """A row of pieces, each nearest to the one before: as many rounds as pieces, the same answer as one by one."""
    schema = "cell int, path_id int, j long, n long, x double, y double, z double"
    tree = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "cell int, n long, x double, y double, z double")
    far = [(1, 90 + p, j, 5000 + 2 * p + j, 100.0 * (p + 1) + j, 0.0 + 50 * p, 7.0) for p in range(4) for j in range(2)]
    alone = [(2, 1, 0, 9000, 0.0, 0.0, 0.0)]
    got = {(r["cell"], r["path_id"]): (r["attach_to"], r["dist"]) for r in R.reconnect_paths(tree, spark.createDataFrame(loose_paths(5) + far + alone, schema), ["cell"]).collect()}
    tree_pts, todo = {0: (0.0, 0.0, 0.0)}, {}
    for _, p, j, n, *xyz in loose_paths(5) + far:
        todo.setdefault(p, []).append((j, n, tuple(xyz)))
    want = {(2, 1): (None, None)}
    while todo:
        d, p, at = min((math.dist(q, t), p, n) for p, pts in todo.items() for _, _, q in (pts[0], pts[-1]) for n, t in tree_pts.items())
        want[1, p] = (at, d)
        tree_pts.update({n: q for _, n, q in todo.pop(p)})
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1]) for k, v in got.items() if v[1] is not None)


def test_chain_totals_take_few_rounds(spark):
    links = spark.createDataFrame([(1, i, i - 1 if i else None, 1.0) for i in range(5000)], "k int, id long, ptr long, w double")
    got = {r["id"]: (r["steps"], r["total"]) for r in R.chain_totals(links, ["k"], "w").collect()}
    assert got == {i: (i, float(i)) for i in range(5000)}
    with pytest.raises(RuntimeError):
        R.chain_totals(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "k int, id long, ptr long"), ["k"])


def test_a_trigger_out_of_tolerance_is_an_error(spark):
    s = spark.createDataFrame([(1, i, i * 1.0, 0.0) for i in range(10)], "c int, i long, t double, y double")
    g = spark.createDataFrame([(1, n, t) for n, t in enumerate([0.0, 2.0, 4.45, 6.0])], "c int, k long, t double")
    with pytest.raises(Exception, match="no sample within"):
        T.repetition_starts(s, g, ["c"], 1, tol=0.2).collect()
    assert T.repetition_starts(s, g, ["c"], 1, tol=0.5).count() == 4


def test_a_recording_without_baseline_keeps_its_rows(spark):
    s = spark.createDataFrame([(k, i, float(i), float(i * i)) for k in (1, 2) for i in range(6)], "c int, i long, t double, y double")
    t0 = spark.createDataFrame([(1, 4.0), (2, 0.0)], "c int, t0 double")
    for out in (T.subtract_baseline(s, t0, ["c"]), T.standardize(s, ["c"], 1, t0)):
        assert out.count() == 12 and out.filter("c = 2 and y is not null").isEmpty() and out.filter("c = 1 and y is null").isEmpty()


def test_long_windows_plan_fast_and_fit_polynomials_exactly(spark):
    n = 2000
    y = [1 + 0.01 * i - 1e-5 * i * i + 1e-9 * i**3 for i in range(n)]
    s = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate(y)], "c int, i long, t double, y double")
    import time

    t = time.time()
    d = T.detrend_poly(s, ["c"], 481)
    d._jdf.queryExecution().executedPlan()
    assert time.time() - t < 5
    assert d.agg(F.max(F.abs("y"))).first()[0] < 1e-8


def test_long_kernels_and_frames_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(i), None if (k, i) == (2, 40) else float(v)) for k, n in ((1, 300), (2, 90), (3, 5)) for i, v in enumerate(rng.normal(size=n))]
    s = spark.createDataFrame(rows, "c int, i long, t double, y double")
    ker = rng.normal(size=31).tolist()
    for reflect in (False, True):
        a = {(r["c"], r["i"]): r["f"] for r in T.fir(s, ["c"], ker, "f", reflect=reflect).collect()}
        b = {(r["c"], r["i"]): r["f"] for r in T._fir_chunks(s, ["c"], ker, "f", "y", "i", reflect).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert (a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k]))


def test_rates_of_the_recordings_decide(spark):
    """The same signal at two rates: the low-pass in Hz gives the same curve at the shared times."""
    sig = lambda t: math.sin(0.3 * t) + 0.2 * math.sin(9 * t)
    rows = [(k, i, i / fs, sig(i / fs)) for k, fs in ((1, 10.0), (2, 20.0)) for i in range(int(60 * fs))]
    s = spark.createDataFrame(rows, "c int, i long, t double, y double")
    d = {(r["c"], round(r["t"], 6)): r["y"] for r in T.smooth_detrend(s, ["c"], cutoff=0.5).collect()}
    mid = [t / 10 for t in range(100, 500)]
    assert max(abs(d[1, t] - d[2, t]) for t in mid) < 0.02
    assert max(abs(d[1, t] - math.sin(0.3 * t)) for t in mid) < 0.05


def test_hidden_names_are_listed(spark, tmp_path):
    for folder, name in (("a", ".x.ini"), ("b", "_x.ini"), ("c", "x.ini"), ("c/d", "x.txt")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text("")
    last = lambda d: sorted(r["folder"].rsplit("/", 1)[1] for r in d.collect())
    assert last(N.list_files(spark, f"file:{tmp_path}", ".ini")) == ["a", "b", "c"]
    assert last(N.list_files(spark, str(tmp_path), ".ini", ignore_hidden=True)) == ["b", "c"]


def test_an_empty_cloud_has_no_nearest_row(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    out = nearest_point(p, spark.createDataFrame([], "n long, x double, y double"), ["id"], ["x", "y"], "n").collect()
    assert len(out) == 1 and out[0]["n"] is None and out[0]["dist"] is None


def test_vector_function_over_whole_batches(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0])], "id int, v array<double>")
    got = {r["id"]: r["n"] for r in d.select("id", vector_aggregate(lambda a: np.sqrt((a * a).sum(axis=1)), F.col("v"), whole=True).alias("n")).collect()}
    assert got == {1: 5.0, 2: None, 3: 1.0}


def test_a_late_row_within_the_delay_counts(spark, tmp_path):
    """Two files, read one after the other: the second holds a row older than the newest of the first."""
    src, schema = str(tmp_path / "src"), "user_id long, event_id long, ts timestamp, value double"
    at = lambda m: f"timestamp'2024-01-01 00:{m:02d}:00'"

    def put(rows, n):
        sql = " union all ".join(f"select {u}L user_id, {e}L event_id, {at(m)} ts, {v}D value" for u, e, m, v in rows)
        spark.sql(sql).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet") and not f.startswith("n"):
                os.rename(f"{src}/{f}", f"{src}/n{n}.parquet")
                os.utime(f"{src}/n{n}.parquet", (1e9 + n, 1e9 + n))

    put([(1, 1, 0, 0.0), (1, 3, 10, 9.0), (2, 9, 10, 0.0)], 1)
    put([(1, 2, 5, 9.0), (1, 4, 12, 0.0), (1, 5, 14, 9.0), (2, 10, 50, 0.0)], 2)
    put([(1, 6, 55, 0.0)], 3)
    events = S.stream_new_files(spark, src, schema, per_trigger=1)
    out = S.run_available(S.stream_triggers(events, {"user_id": "bigint"}, 5.0, 60.0, "20 minutes"), "late", path=str(tmp_path / "out"))
    got = sorted(r["ts"].minute for r in spark.read.parquet(out).collect())
    assert got == [5, 14]


def test_only_hot_keys_go_through_blocks(spark):
    from tessera.plans import scan as P

    rows = [(k, i) for k in range(50) for i in range(5)] + [(99, i) for i in range(200)] + [(None, i) for i in range(60)]
    d = spark.createDataFrame(rows, "k int, i int")
    seen = []
    blocks = P._blocks
    spark.conf.set("tessera.task.rows", "40")
    P._blocks = lambda df, *a: seen.append(sorted({r["k"] for r in df.select("k").distinct().collect()}, key=str)) or blocks(df, *a)
    try:
        got = P.scan(d, ["k"], ["i"], n=("index", F.lit(1)), s=("sum", F.col("i")), p=("prev", F.col("i")), q=("next", F.col("i"))).collect()
    finally:
        P._blocks = blocks
        spark.conf.unset("tessera.task.rows")
    assert seen == [[99, None]] and len(got) == len(rows)
    for r in got:
        last = {99: 199, None: 59}.get(r["k"], 4)
        assert (r["n"], r["s"], r["p"], r["q"]) == (r["i"], r["i"] * (r["i"] + 1) // 2, r["i"] - 1 if r["i"] else None, r["i"] + 1 if r["i"] < last else None)
