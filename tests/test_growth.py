"""Nearest points, growing trees and intervals against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import trees as R
from tessera.plans.near import nearest_point

POINTS = "cell int, path_id int, j long, n long, x double, y double, z double"


@pytest.mark.parametrize("kind", ["clusters", "line", "copies"])
def test_nearest_point_is_brute_force(spark, kind):
    """Clustered points at very different scales, points far outside, ties and copies."""
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        c = np.concatenate([rng.normal(size=(400, 3)) * s + rng.uniform(-1000, 1000, 3) for s in (1e-6, 0.1, 50.0)])
        p = np.concatenate([c[::7] + rng.normal(size=c[::7].shape) * 1e-3, rng.uniform(-5000, 5000, (60, 3))])
    elif kind == "line":
        c = np.stack([np.arange(900.0), np.zeros(900), np.zeros(900)], axis=1)
        p = np.stack([rng.integers(-50, 1000, 150) / 2, rng.integers(-3, 4, 150), np.zeros(150)], axis=1).astype(float)
    else:
        c = rng.integers(0, 4, (500, 3)).astype(float)
        p = rng.integers(-2, 7, (150, 3)).astype(float)
    cloud = spark.createDataFrame([(i % 2, i, *map(float, r)) for i, r in enumerate(c)], "k int, id int, x double, y double, z double")
    points = spark.createDataFrame([(i % 2, i, *map(float, r)) for i, r in enumerate(p)], "k int, p int, x double, y double, z double")

    def want(i, keyed):
        d = [((p[i][0] - q[0]) ** 2 + (p[i][1] - q[1]) ** 2 + ((p[i][2] - q[2]) * 0.5) ** 2, j) for j, q in enumerate(c) if not keyed or j % 2 == i % 2]
        return min(d)

    for keys in ([], ["k"]):
        got = {r["p"]: r for r in nearest_point(points, cloud, [*keys, "p"], ["x", "y", "z"], "id", {"z": 0.5}, keys).collect()}
        assert len(got) == len(p)
        for i, r in got.items():
            d, j = want(i, bool(keys))
            assert r["dist"] == pytest.approx(math.sqrt(d), abs=1e-9)
            assert kind == "clusters" or r["id"] == j


def test_nearest_of_another_label_within_a_distance(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 10, (300, 2))
    rows = [(i, i // 75, float(a), float(b), 0.2 if i % 2 else 2.0) for i, (a, b) in enumerate(p)]
    d = spark.createDataFrame(rows, "i int, part int, x double, y double, w double")
    got = {r["i"]: r["dist"] for r in nearest_point(d, d, ["i"], ["x", "y"], "i", other="part", within="w").collect()}
    for i, part, x, y, w in rows:
        near = min(math.dist((x, y), (q[2], q[3])) for q in rows if q[1] != part)
        assert (i in got) == (near <= w) and (i not in got or got[i] == pytest.approx(near))


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id int, x double, y double")
    p = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    r = nearest_point(p, none, ["p"], ["x", "y"], "id").collect()
    assert [(x["p"], x["id"], x["dist"]) for x in r] == [(1, None, None)]


def grow(tree, loose):
    """One loose path after another: always the nearest pair of a tail and a loose vertex."""
    tails = [{"n": n, "at": at, "path": p, "part": 0, "len": size} for n, at, p, size in tree]
    todo, out = {p: list(pts) for p, pts in loose.items()}, {}
    while todo:
        d, p, _, j, t = min((math.dist(t["at"], at), p, t["n"], j, k) for p, pts in todo.items() for j, (_, at) in enumerate(pts) for k, t in enumerate(tails))
        pts, tail = todo.pop(p), tails[t]
        inner, gap = 0 < j < len(pts) - 1, int(d > 0)
        out[p] = (tail["n"], tail["path"], tail["part"], tail["len"], j, round(d, 9), inner)
        end = pts[j] if inner else pts[-1 if j == 0 else 0]
        stays = not gap and (inner or len(pts) == 1)
        tails[t] = {**tail, "n": tail["n"] if stays else end[0], "at": end[1], "len": tail["len"] + (gap if inner else len(pts) - 1 + gap)}
        if inner:
            tails += [{"n": pts[0][0], "at": pts[0][1], "path": p, "part": 1, "len": j + 1}, {"n": pts[-1][0], "at": pts[-1][1], "path": p, "part": 2, "len": len(pts) - j}]
    return out


def scattered(rng, cell, paths, size, step=1.0):
    rows = []
    for p in range(paths):
        at = [rng.uniform(0, size) for _ in range(3)]
        for j in range(rng.choice([1, 2, 5, 9])):
            rows.append((cell, p, j, 1000 * (cell + 1) + len(rows), *at))
            at = [a + rng.uniform(-step, step) for a in at]
    return rows


@pytest.mark.parametrize("local", [20_000, 1])
def test_growth_is_the_same_in_one_task_and_in_rounds(spark, local):
    rng = random.Random(11)
    loose = scattered(rng, 0, 5, 6.0) + scattered(rng, 1, 3, 3.0, 2.0)
    tree = [(c, 900 + i, i, *[rng.uniform(0, 6) for _ in range(3)]) for c in (0, 1) for i in range(3)]
    points = [(c, 500 + n, 0, 5000 * (c + 1) + n, *at) for c, n, _, *at in tree]
    got = {}
    for r in R.reconnect_paths(spark.createDataFrame(points, POINTS), spark.createDataFrame(loose, POINTS), ["cell"], local).collect():
        got.setdefault(r["cell"], {})[r["path_id"]] = (r["attach_to"], r["to_path"], r["to_part"], r["at_j"], r["by_j"], round(r["dist"], 9), r["split"])
    for c in (0, 1):
        pieces = {}
        for cell, p, j, n, *at in loose:
            if cell == c:
                pieces.setdefault(p, []).append((n, at))
        want = grow([(n, at, p, 1) for cell, p, _, n, *at in points if cell == c], pieces)
        assert got[c] == want


def test_a_path_hit_in_the_middle_is_split_and_bridged(spark):
    tree = spark.createDataFrame([(1, 0, j, j, float(j), 0.0, 0.0) for j in range(3)], POINTS)
    loose = spark.createDataFrame([(1, 7, j, 10 + j, 3.0, float(j - 2), 0.0) for j in range(5)] + [(1, 8, 0, 20, 3.0, 4.0, 0.0), (1, 8, 1, 21, 3.0, 2.0, 0.0)], POINTS)
    got = R.reconnect_paths(tree, loose, ["cell"])
    by = {r["path_id"]: r for r in got.collect()}
    assert (by[7]["attach_to"], by[7]["to_path"], by[7]["by_j"], by[7]["dist"], by[7]["split"]) == (2, 0, 2, 1.0, True)
    assert (by[8]["attach_to"], by[8]["to_path"], by[8]["to_part"], by[8]["by_j"], by[8]["dist"], by[8]["split"]) == (14, 7, 2, 1, 0.0, False)
    points, links = R.reconnected(tree, loose, got, ["cell"])
    paths = {}
    for r in points.orderBy("j").collect():
        paths.setdefault((r["path_id"], r["part"]), []).append((r["j"], r["n"]))
    assert paths == {(0, 0): [(0, 0), (1, 1), (2, 2), (3, 12)], (7, 1): [(0, 12), (1, 11), (2, 10)], (7, 2): [(0, 12), (1, 13), (2, 14), (3, 20)]}
    assert sorted((r["path_id"], r["part"], r["connect_to"], r["connect_part"]) for r in links.collect()) == [(7, 1, 0, 0), (7, 2, 0, 0)]


def test_nothing_loose_and_nothing_reached_give_empty_frames(spark):
    tree = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 0.0)], POINTS)
    none = R.reconnect_paths(tree, tree.limit(0), ["cell"])
    assert none.collect() == [] and "attach_to" in none.columns
    alone = R.reconnect_paths(tree.limit(0), tree, ["cell"]).collect()
    assert [(r["path_id"], r["attach_to"], r["to_path"]) for r in alone] == [(0, None, None)]
    paths = spark.createDataFrame([(1, 5, 1, 2)], "cell int, path_id int, a int, b int")
    out = R.orient_paths(paths, spark.createDataFrame([(1, 99)], "cell int, n int"), ["cell"])
    assert out.collect() == [] and out.columns == ["cell", "path_id", "start", "end", "reversed", "connect_to", "level"]


def test_ten_thousand_loose_paths_all_hang(spark):
    rng = np.random.default_rng(12)
    at = rng.uniform(0, 100, (10_000, 3))
    loose = [(i % 40, i, j, 10 * i + j + 1000, *map(float, at[i] + j)) for i in range(10_000) for j in range(2)]
    tree = [(c, 0, 0, c, 50.0, 50.0, 50.0) for c in range(40)]
    got = R.reconnect_paths(spark.createDataFrame(tree, POINTS), spark.createDataFrame(loose, POINTS), ["cell"])
    s = got.agg(F.count("*"), F.count("attach_to"), F.count_distinct("path_id")).first()
    assert tuple(s) == (10_000,) * 3


def test_intervals_of_a_long_chain_and_a_bush(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(100_000)]
    bush = [(2, i, (i - 1) // 3 if i else None) for i in range(40)] + [(2, 90, None), (2, 91, 90)]
    links = spark.createDataFrame(chain + bush, "k int, id long, ptr long")
    iv = R.tree_intervals(links, ["k"]).cache()
    assert iv.filter("k = 1 and (enter <> id or exit <> 99999 or size <> 100000 - id)").isEmpty() and iv.filter("k = 1").count() == 100_000
    up = {i: p for _, i, p in bush}

    def above(a, i):
        while up[i] is not None:
            i = up[i]
            if i == a:
                return True
        return False

    pairs = spark.createDataFrame([(2, a, i) for a in up for i in up] + [(2, 0, 777)], "k int, anc long, id long")
    got = {(r["anc"], r["id"]): r["is_ancestor"] for r in R.mark_ancestors(pairs, iv, ["k"]).collect()}
    assert got.pop((0, 777)) is None
    assert got == {(a, i): above(a, i) for a in up for i in up}
    iv.unpersist()


def test_intervals_take_rounds_by_depth_not_by_length(spark, monkeypatch):
    """A bush of 4000 leaves is two deep: its walk has 8000 steps, which took 13 rounds of doubling."""
    cuts, durable, written = [], R.durable, R.written
    monkeypatch.setattr(R, "durable", lambda df: cuts.append(1) or durable(df))
    monkeypatch.setattr(R, "written", lambda df: cuts.append(1) or written(df))
    links = spark.createDataFrame([(1, 0, None)] + [(1, i, 0) for i in range(1, 4001)], "k int, id long, ptr long")
    got = R.tree_intervals(links, ["k"])
    assert len(cuts) <= 8
    assert got.filter("enter <> id or exit <> if(id = 0, 4000, id) or size <> if(id = 0, 4001, 1)").isEmpty() and got.count() == 4001
    with pytest.raises(RuntimeError):
        R.tree_intervals(spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], "k int, id long, ptr long"), ["k"])


def test_intervals_of_trees_without_their_root_do_not_overlap(spark):
    """Node 2 hangs on 9 and node 4 on 8, which are not there: they come after the tree of 1, and nobody is above them."""
    links = spark.createDataFrame([(1, 1, None), (1, 2, 9), (1, 3, 2), (1, 4, 8), (1, 5, 1), (1, 6, 1)], "k int, id long, ptr long")
    iv = R.tree_intervals(links, ["k"])
    assert sorted((r["id"], r["enter"], r["exit"], r["size"]) for r in iv.collect()) == [(1, 0, 2, 3), (2, 3, 4, 2), (3, 4, 4, 1), (4, 5, 5, 1), (5, 1, 1, 1), (6, 2, 2, 1)]
    pairs = spark.createDataFrame([(1, a, i) for a in range(1, 7) for i in range(1, 7)], "k int, anc long, id long")
    assert sorted((r["anc"], r["id"]) for r in R.mark_ancestors(pairs, iv, ["k"]).filter("is_ancestor").collect()) == [(1, 5), (1, 6), (2, 3)]


def test_levels_are_put_together_as_in_a_counter(spark):
    """A chain of paths takes a level each, the result is whole."""
    paths = [(1, i, i, i + 1) if i % 3 else (1, i, i + 1, i) for i in range(12)]
    out = R.orient_paths(spark.createDataFrame(paths, "cell int, path_id int, a int, b int"), spark.createDataFrame([(1, 0)], "cell int, n int"), ["cell"])
    assert sorted((r["path_id"], r["start"], r["end"], r["connect_to"], r["level"]) for r in out.collect()) == [(i, i, i + 1, i - 1 if i else None, i) for i in range(12)]


@pytest.mark.parametrize("most", [1000, 7])
def test_hulls_of_many_planes(spark, most):
    """A polygon of 60 sides, its planes in one array or in nine."""
    from tessera.operators import joins as J

    turn = [2 * math.pi * k / 60 for k in range(60)]
    planes = spark.createDataFrame([("a", math.cos(a), math.sin(a), 1.0) for a in turn], "h string, n_x double, n_y double, d double")
    rng = np.random.default_rng(1)
    p = [("a", i, *map(float, rng.uniform(-1.3, 1.3, 2))) for i in range(300)] + [("b", 900, 0.0, 0.0), ("a", 901, None, 0.0), ("a", 902, 0.0, 0.0), ("a", 903, 0.0, 0.0)]
    got = {r["i"]: r["inside"] for r in J.points_in_convex(spark.createDataFrame(p, "h string, i int, x double, y double"), planes, ["h"], ["x", "y"], most=most).collect()}
    for h, i, x, y in p:
        assert got[i] == (h == "a" and x is not None and all(math.cos(a) * x + math.sin(a) * y <= 1 for a in turn))


def test_a_lost_label_finds_a_free_pixel_far_away(spark):
    """All pixels near the lost label are taken; the nearest free one is 200 pixels off."""
    from tessera.operators import grids as G

    taken = [(1, x, y, 1) for x in range(202) for y in range(3)]
    before = spark.createDataFrame(taken + [(1, 0, 0, 2)], "k int, x int, y int, roi_id int")
    after = spark.createDataFrame([t for t in taken if t[1] < 201], "k int, x int, y int, roi_id int")
    out = G.keep_lost_labels(before, after, ["k"], (202, 3), (202, 3))
    assert [(r["x"], r["y"]) for r in out.filter("roi_id = 2").collect()] == [(201, 0)] and out.count() == len(taken) - 2
    full = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1)], "k int, x int, y int, roi_id int")
    got = {(r["x"], r["y"], r["roi_id"]) for r in G.keep_lost_labels(full.unionByName(spark.createDataFrame([(1, 0, 1, 5)], full.schema)), full, ["k"], (1, 2), (1, 2)).collect()}
    assert got == {(0, 0, 1), (0, 1, 5)}
    with pytest.raises(RuntimeError):
        one = full.filter("y = 0")
        G.keep_lost_labels(one.unionByName(spark.createDataFrame([(1, 0, 0, 5)], full.schema)), one, ["k"], (1, 1), (1, 1))


def test_a_bucket_of_many_pairs_is_cut(spark, monkeypatch):
    """All boxes in one bucket: its pairs are compared in several tasks, and every pair appears once."""
    monkeypatch.setattr(J, "BUCKET_PAIRS", 50)
    s = [(i, 1 + i % 5 * 0.7, 2.0, 1.5 + i % 3, 2.5 + i % 4) for i in range(40)]
    c = [(i, 1.0 + i % 6, 1.0 + i % 7 * 0.9, 0.8) for i in range(30)]
    out = J.box_candidates(spark.createDataFrame(s, "sid long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(c, "cell long, cx double, cy double, h double"), 100.0)
    rows = out.select("sid", "cell", F.spark_partition_id().alias("task")).collect()
    want = [(i, k) for i, x0, y0, x1, y1 in s for k, cx, cy, h in c if min(x0, x1) <= cx + h and max(x0, x1) >= cx - h and min(y0, y1) <= cy + h and max(y0, y1) >= cy - h]
    assert sorted((r["sid"], r["cell"]) for r in rows) == want
    assert len({r["task"] for r in rows}) > 1


def test_nearest_point_neither_broadcasts_the_cloud_nor_sorts_whole_blocks(spark):
    p = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 23).cast("double").alias("y"))
    plan = nearest_point(p, p, ["id"], ["x", "y"], "id")._jdf.queryExecution().sparkPlan().toString()
    lines = plan.splitlines()
    assert sum("SortMergeJoin" in l for l in lines) >= 2
    assert any("_ub" in l and "<=" in l and "SQRT" in l and "greatest" not in l for l in lines)


def test_hexagon_lengths_are_no_condition_of_the_join(spark):
    """Together with the join's conditions they would be too long to be compiled."""
    s = spark.range(9).selectExpr("id AS sid", "id * 1.0D AS x0", "1.0D AS y0", "id + 2.0D AS x1", "3.0D AS y1")
    c = spark.range(5).selectExpr("id AS cell", "id * 2.0D AS cx", "2.0D AS cy", "3.0D AS h")
    out = R.length_per_cell(J.box_candidates(s, c, 8.0), 2.5, ["cell"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("HYPOT" in l.upper() for l in plan if "Join" in l or "Filter" in l)
    assert out.count() == 5


def test_short_series_share_a_call(spark, monkeypatch):
    """Peaks of many short series: right, and not a call of Python for each of them."""
    from tessera.operators import series as S

    plans, write = [], S.written
    monkeypatch.setattr(S, "written", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    rng = random.Random(4)
    lines = {k: [rng.randint(0, 9) / 2 for _ in range(rng.randint(1, 25))] for k in range(60)}
    d = spark.createDataFrame([(k, i, v) for k, y in lines.items() for i, v in enumerate(y)], "k int, i long, y double")
    got = {(r["k"], r["i"]): r["prominence"] for r in S.find_peaks(d, ["k"], prominence=1.0).collect()}
    want = {}
    for k, y in lines.items():
        for a in range(1, len(y) - 1):
            b = a
            while b + 1 < len(y) and y[b + 1] == y[a]:
                b += 1
            if y[a - 1] < y[a] and b + 1 < len(y) and y[b + 1] < y[a]:
                left = next((j for j in range(a, -1, -1) if y[j] > y[a]), -1)
                right = next((j for j in range(b, len(y)) if y[j] > y[a]), len(y))
                high = y[a] - max(min(y[left + 1 : a]), min(y[b + 1 : right]))
                if high >= 1.0:
                    want[k, (a + b) // 2] = high
    assert got == want
    assert [p for p in plans if "FlatMapGroupsInPandas" in p] and not any("FlatMapGroupsInPandas [k" in p for p in plans)


def test_shifted_images_meet_their_reference_tile_by_tile(spark):
    """Larger than a tile, with gaps, nulls, places below zero and a pixel twice; only whole tiles are shuffled, not every shift of a pixel."""
    rng = random.Random(6)
    img = [(k, "a", x, y, rng.choice([None, 1.0, 2.0, 4.0])) for k in (1, 2) for x in range(-5, 21) for y in range(14, 20) if rng.random() < 0.8]
    ref = [("a", x, y, rng.choice([None, 0.0, 3.0])) for x in range(-4, 19) for y in range(13, 19) if rng.random() < 0.9] + [("a", 16, 16, 7.0), ("b", 0, 15, 1.0)]
    i = spark.createDataFrame(img, "k int, l string, x int, y int, v double")
    r = spark.createDataFrame(ref, "l string, x int, y int, v double")
    out = J.shift_scores(i, r, ["k", "l"], ["l"], 2, "mse")
    got = {(q["k"], q["dx"], q["dy"]): q["score"] for q in out.collect()}
    want = {}
    for k, _, x, y, v in img:
        for l, a, b, w in ref:
            if l == "a" and abs(a - x) <= 2 and abs(b - y) <= 2:
                want.setdefault((k, a - x, b - y), []).append(None if v is None or w is None else -((v - w) ** 2))
    for at, d in want.items():
        d = [q for q in d if q is not None]
        assert got.pop(at) == pytest.approx(sum(d) / len(d))
    assert not got
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(plan) if "Join" in line)
    assert "collect_list" in "".join(plan[join + 1 : join + 4])


def test_small_regions_share_a_call(spark):
    """Hulls of many regions: right, and not a call of Python for each of them."""
    from tessera.operators import grids as G

    rng = random.Random(5)
    shapes = {k: {(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(rng.randint(1, 9))} for k in range(50)}
    d = spark.createDataFrame([(k, x, y) for k, s in shapes.items() for x, y in s], "id int, x int, y int")
    out = G.region_irregularity(d, ["id"])
    got = {r["id"]: r["irregularity"] for r in out.collect()}
    for k, s in shapes.items():
        p = sorted({(x + a, y + b) for x, y in s for a in (0, 1) for b in (0, 1)})
        # Twice the area: edges of the hull are the pairs with no point to their right, cut at the farthest on the line.
        edges = [(a, b) for a in p for b in p if a != b and all((c := (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])) > 0 or (c == 0 and min(a, b) <= q <= max(a, b)) for q in p)]
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in edges) / 2
        assert got[k] == pytest.approx(1 - len(s) / area)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [_lot" in plan and "FlatMapGroupsInPandas [id" not in plan


def test_ends_of_windows_are_searched_one_by_one(spark, monkeypatch):
    """No stage holds the sorts of two searches, and the rows that windows ask for are not broadcast."""
    from tessera.operators import responses as W
    from tessera.operators import series as S

    plans, write = [], S.written
    monkeypatch.setattr(S, "written", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    rng = random.Random(6)
    lines = {k: sorted(rng.uniform(0, 100) for _ in range(rng.randint(12, 40))) for k in range(8)}
    s = spark.createDataFrame([(k, i, t, t * t) for k, ts in lines.items() for i, t in enumerate(ts)], "k_ int, j long, t double, y double")
    e = spark.createDataFrame([(k, n, ts[3 * n]) for k, ts in lines.items() for n in range(4)], "k_ int, k long, t double")
    out = W.window_mean(s, e, ["k_"], 2.0, 30.0)
    got = {(r["k_"], r["k"]): r["r"] for r in out.collect()}
    want = {}
    for k, ts in lines.items():
        for n in range(4):
            lo, hi = (min(range(len(ts)), key=lambda i: (abs(ts[i] - ts[3 * n] - off), i)) for off in (2.0, 30.0))
            if hi > lo:
                want[k, n] = pytest.approx(sum(t * t for t in ts[lo:hi]) / (hi - lo))
    assert got == want
    snips = S.snippets(s.withColumnRenamed("j", "i"), e, ["k_"], 1, base=(-5.0, 5.0))
    assert snips.count() > 0
    assert len(plans) >= 4 and all(p.count("Union") <= 1 for p in plans)
    for df in (out, snips):
        plan = df._jdf.queryExecution()
        assert "Union" not in plan.optimizedPlan().toString() and "BroadcastHashJoin" not in plan.sparkPlan().toString()


def test_lost_labels_are_not_broadcast(spark, monkeypatch):
    """Tables of a round are small as files, not as rows: none of them goes through the driver."""
    from tessera.operators import grids as G

    plans, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df, *a: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, *a))
    before = spark.createDataFrame([(k, x, 0, x) for k in range(3) for x in range(4)], "id int, x int, y int, roi_id int")
    out = G.keep_lost_labels(before, before.filter("x > 0"), ["id"], (4, 1), (4, 1))
    assert sorted(tuple(r) for r in out.collect()) == sorted((k, x, 0, x) for k in range(3) for x in range(4))
    assert sum("Join" in p for p in plans) > 3 and not any("BroadcastHashJoin" in p and "LeftAnti" in p for p in plans)
