"""Queries for joins beyond equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import series as T
from ..plans.near import nearest_point as _nearest
from .fixtures import clicks, mask, pixels, samples, table
from .registry import query


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


_SET = (
    "SELECT o_orderdate::DATE AS d, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS setup1, "
    "max(o_totalprice) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS setup2, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS setup3 FROM orders GROUP BY 1"
)


@query(
    f"WITH s AS ({_SET}), l AS (SELECT d, 1 AS setup, setup1 AS v FROM s UNION ALL SELECT d, 2, setup2 FROM s UNION ALL SELECT d, 3, setup3 FROM s), n AS (SELECT * FROM l WHERE v IS NOT NULL), "
    "q AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS setup, l_shipdate::DATE AS d FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round(v / 1000, 6) AS setting FROM q ASOF LEFT JOIN n ON n.setup = q.setup AND n.d <= q.d"
)
def asof_setting(spark, sf):
    o = table(spark, sf, "orders")

    def top(cond):
        return F.max(F.when(F.expr(cond), F.col("o_totalprice")))

    s = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        top("o_orderstatus = 'F' and o_orderkey % 3 = 0").alias("setup1"), top("o_orderstatus = 'O' and o_orderkey % 3 = 0").alias("setup2"), top("o_orderstatus = 'P'").alias("setup3")
    )
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3 + 1).alias("setup"), F.col("l_shipdate").alias("day"))
    out = J.asof_setting(l, s, "day", "setup", {1: "setup1", 2: "setup2", 3: "setup3"})
    return _r(out, 6, "setting").select("l_orderkey", "l_linenumber", "setting")


_OTHERS = "oth AS (SELECT user_id, i, t FROM typed_samples WHERE event_type <> 'click')"


def _others(spark, sf):
    from .fixtures import typed_samples

    return typed_samples(spark, sf).filter("event_type != 'click'").select("user_id", "i", "t", "y")


@query(
    f"WITH {_OTHERS}, b AS (SELECT c.user_id, c.k, c.t, b.t AS bt, b.i AS bi FROM clicks c ASOF LEFT JOIN oth b ON b.user_id = c.user_id AND b.t <= c.t), "
    "a AS (SELECT b.*, a.t AS a_t, a.i AS ai FROM b ASOF LEFT JOIN oth a ON a.user_id = b.user_id AND a.t > b.t) "
    "SELECT user_id, k, CASE WHEN least(coalesce(t - bt, 1e18::DOUBLE), coalesce(a_t - t, 1e18::DOUBLE)) > 20000 THEN NULL WHEN bt IS NULL OR a_t - t < t - bt THEN ai ELSE bi END AS si FROM a",
    use="clicks typed_samples",
)
def nearest_sample(spark, sf):
    return T.nearest_index(clicks(spark, sf), _others(spark, sf), ["user_id"], tol=20000.0).select("user_id", "k", "si")


@query(f"WITH {_OTHERS} SELECT c.user_id, c.k, b.i AS si FROM clicks c ASOF LEFT JOIN oth b ON b.user_id = c.user_id AND b.t <= c.t", use="clicks typed_samples")
def nearest_before(spark, sf):
    return T.nearest_index(clicks(spark, sf), _others(spark, sf), ["user_id"], side="before").select("user_id", "k", "si")


@query(f"WITH {_OTHERS} SELECT c.user_id, c.k, b.i AS si FROM clicks c ASOF LEFT JOIN oth b ON b.user_id = c.user_id AND b.t >= c.t", use="clicks typed_samples")
def nearest_after(spark, sf):
    return T.nearest_index(clicks(spark, sf), _others(spark, sf), ["user_id"], side="after").select("user_id", "k", "si")


_CLOUD = "cl AS (SELECT s_suppkey AS id, floor(s_acctbal / 10)::DOUBLE AS x, (s_suppkey * 37 % 1000)::DOUBLE AS y, (s_nationkey * 20)::DOUBLE AS z FROM supplier)"
_PTS = "pt AS (SELECT c_custkey, floor(c_acctbal / 10)::DOUBLE AS x, (c_custkey * 7 % 1000)::DOUBLE AS y, (c_nationkey * 20)::DOUBLE AS z FROM customer)"


def _cloud(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") / 10).cast("double").alias("x"), (F.col("s_suppkey") * 37 % 1000).cast("double").alias("y"), (F.col("s_nationkey") * 20).cast("double").alias("z"))


def _points(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.floor(F.col("c_acctbal") / 10).cast("double").alias("x"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("y"), (F.col("c_nationkey") * 20).cast("double").alias("z"))


@query(
    f"WITH {_CLOUD}, {_PTS} SELECT c_custkey, arg_min(id, (d, id)) AS id, round(min(d), 6) AS dist FROM "
    "(SELECT c_custkey, id, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow((p.z - c.z) * 0.5::DOUBLE, 2)) AS d FROM pt p, cl c) GROUP BY 1"
)
def nearest_point(spark, sf):
    out = _nearest(_points(spark, sf), _cloud(spark, sf), ["c_custkey"], ["x", "y", "z"], "id", {"z": 0.5})
    return _r(out, 6, "dist").select("c_custkey", "id", "dist")


@query(
    f"WITH {_CLOUD}, {_PTS}, a AS (SELECT c_custkey, arg_min(id, (d, id)) AS id, min(d) AS dist, min(d) FILTER (WHERE id % 10 = 3) AS dist_soma FROM "
    "(SELECT c_custkey, id, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2)) AS d FROM pt p, cl c) GROUP BY 1) "
    "SELECT c_custkey, a.id, round(dist, 6) AS dist, round(dist_soma, 6) AS dist_soma, (least(dist, dist_soma) <= 150)::INTEGER AS success, (least(dist, dist_soma) <= 150 AND dist_soma <= dist)::INTEGER AS soma_by_dist, "
    "CASE WHEN NOT (least(dist, dist_soma) <= 150 AND dist_soma <= dist) THEN c.x END AS near_x FROM a JOIN cl c ON c.id = a.id"
)
def snap_to_tree(spark, sf):
    cl = _cloud(spark, sf)
    out = J.snap_to_tree(_points(spark, sf), cl, cl.filter("id % 10 = 3"), ["c_custkey"], ["x", "y", "z"], 150.0)
    return _r(out, 6, "dist", "dist_soma").drop("near_y", "near_z")


@query(
    "WITH b AS (SELECT min(s_acctbal) / 100 AS x0, max(s_acctbal) / 100 AS x1 FROM supplier), g AS (SELECT *, unnest(range(20)) AS a FROM b), h AS (SELECT *, unnest(range(20)) AS c FROM g), "
    "s AS (SELECT a * 20 + c AS id, x0 + (x1 - x0) * a / 19 AS x, c * 5.0::DOUBLE AS y FROM h), p AS (SELECT c_custkey, c_acctbal / 100 AS x, (c_custkey % 100)::DOUBLE AS y FROM customer) "
    "SELECT c_custkey, arg_min(id, (d, id)) AS id, round(min(d), 6) AS dist FROM (SELECT c_custkey, id, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) AS d FROM p, s) GROUP BY 1"
)
def surface_distance(spark, sf):
    b = table(spark, sf, "supplier").agg((F.min("s_acctbal") / 100).alias("x0"), (F.max("s_acctbal") / 100).alias("x1"))
    g = b.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(19))))
    g = g.select((F.col("a") * 20 + F.col("c")).cast("long").alias("id"), (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("a") / 19).alias("x"), (F.col("c") * F.lit(5.0)).alias("y"))
    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return _r(_nearest(p, g, ["c_custkey"], ["x", "y"], "id"), 6, "dist").select("c_custkey", "id", "dist")


@query(
    "WITH pp AS (SELECT l_suppkey % 20 AS x, l_linenumber AS y, l_orderkey % 50 AS path_id, l_partkey AS j FROM lineitem), f AS (SELECT x, y, min({'p': path_id, 'j': j}) AS m FROM pp GROUP BY 1, 2) "
    "SELECT c_custkey, m.p AS path_id, m.j AS j FROM customer JOIN f ON x = c_custkey % 20 AND y = c_nationkey % 9"
)
def locate_on_path(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("x"), F.col("l_linenumber").cast("long").alias("y"), (F.col("l_orderkey") % 50).alias("path_id"), F.col("l_partkey").alias("j"))
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 20).alias("x"), (F.col("c_nationkey") % 9).cast("long").alias("y"))
    return J.locate_on_path(c, l, ["x", "y"]).select("c_custkey", "path_id", "j")


SEGS = "sg AS (SELECT c_custkey AS sid, c_acctbal / 100 AS x0, (c_custkey % 97)::DOUBLE AS y0, c_acctbal / 100 + (c_custkey % 11) - 5 AS x1, (c_custkey % 97) + (c_custkey % 7) * 1.5::DOUBLE - 4 AS y1 FROM customer)"
CELLS = "ce AS (SELECT s_suppkey AS cell, s_acctbal / 100 AS cx, (s_suppkey * 13 % 97)::DOUBLE AS cy, 3.0::DOUBLE AS h FROM supplier)"


def segments(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("sid"), (F.col("c_acctbal") / 100).alias("x0"), (k % 97).cast("double").alias("y0"), (F.col("c_acctbal") / 100 + (k % 11) - 5).alias("x1"), ((k % 97) + (k % 7) * F.lit(1.5) - 4).alias("y1")
    )


def cells(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("cell"), (F.col("s_acctbal") / 100).alias("cx"), (k * 13 % 97).cast("double").alias("cy"), F.lit(3.0).alias("h"))


@query(
    f"WITH {SEGS}, {CELLS} SELECT sid, cell, CASE WHEN least(x0, x1) > cx - h AND greatest(x0, x1) < cx + h AND least(y0, y1) > cy - h AND greatest(y0, y1) < cy + h THEN 'inside' ELSE 'may_cross' END AS relation "
    "FROM sg JOIN ce ON least(x0, x1) <= cx + h AND greatest(x0, x1) >= cx - h AND least(y0, y1) <= cy + h AND greatest(y0, y1) >= cy - h"
)
def segments_near_cells(spark, sf):
    return J.box_candidates(segments(spark, sf), cells(spark, sf), 8.0).select("sid", "cell", "relation")


@query(
    "WITH h AS (SELECT n_nationkey, cos(k * pi() / 3) AS nx, sin(k * pi() / 3) AS ny, 40 + n_nationkey::DOUBLE AS d FROM (SELECT n_nationkey, unnest(range(6)) AS k FROM nation)) "
    "SELECT c_custkey, bool_and(nx * (c_acctbal / 100 - 50) + ny * ((c_custkey % 100) - 50) <= d) AS inside FROM customer JOIN h ON n_nationkey = c_nationkey GROUP BY 1"
)
def points_in_convex(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("hull"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    planes = n.select("hull", F.cos(F.col("k") * F.pi() / 3).alias("n_x"), F.sin(F.col("k") * F.pi() / 3).alias("n_y"), (40 + F.col("hull")).cast("double").alias("d"))
    p = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("hull"), (F.col("c_acctbal") / 100 - 50).alias("x"), (F.col("c_custkey") % 100 - 50).cast("double").alias("y"))
    return J.points_in_convex(p, planes, ["hull"], ["x", "y"]).select("c_custkey", "inside")


_MASKS = "mb AS (SELECT vec_id - 1 AS vec_id, x, y, roi_id FROM mask WHERE vec_id > 0)"


def _mask_b(spark, sf):
    return mask(spark, sf).filter("vec_id > 0").withColumn("vec_id", F.col("vec_id") - 1)


@query(f"WITH {_MASKS} SELECT vec_id, a.roi_id AS roi_a, b.roi_id AS roi_b, count(*) AS n FROM mask a JOIN mb b USING (vec_id, x, y) GROUP BY ALL", use="mask")
def label_overlap(spark, sf):
    return J.label_overlap(mask(spark, sf), _mask_b(spark, sf), ["vec_id"])


@query(
    f"WITH {_MASKS}, na AS (SELECT vec_id, roi_id, count(*) AS n FROM mask GROUP BY 1, 2), nb AS (SELECT vec_id, roi_id, count(*) AS n FROM mb GROUP BY 1, 2), "
    "o AS (SELECT vec_id, a.roi_id AS roi_a, b.roi_id AS roi_b, count(*) AS n FROM mask a JOIN mb b USING (vec_id, x, y) GROUP BY ALL) "
    "SELECT o.vec_id, roi_a, roi_b, round(o.n / (na.n + nb.n - o.n)::DOUBLE, 8) AS iou FROM o JOIN na ON na.vec_id = o.vec_id AND na.roi_id = roi_a JOIN nb ON nb.vec_id = o.vec_id AND nb.roi_id = roi_b",
    use="mask",
)
def label_iou(spark, sf):
    return _r(J.label_iou(mask(spark, sf), _mask_b(spark, sf), ["vec_id"]), 8, "iou")


_SHIFTED = (
    "ms AS (SELECT vec_id, x - (vec_id % 3)::INTEGER + 1 AS x, y + (vec_id % 2)::INTEGER AS y, roi_id FROM mask WHERE vec_id % 5 <> 4 UNION ALL SELECT vec_id, x, y, 3 - roi_id FROM mask WHERE vec_id % 5 = 4), "
    "mt AS (SELECT * FROM ms WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7)"
)


def _mask_shifted(spark, sf):
    m, k = mask(spark, sf), F.col("vec_id")
    a = m.filter("vec_id % 5 != 4").select("vec_id", (F.col("x") - (k % 3).cast("int") + 1).alias("x"), (F.col("y") + (k % 2).cast("int")).alias("y"), "roi_id")
    b = m.filter("vec_id % 5 = 4").withColumn("roi_id", 3 - F.col("roi_id"))
    return a.unionByName(b).filter("x between 0 and 7 and y between 0 and 7")


@query(
    f"WITH {_SHIFTED}, sh AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2))::INTEGER AS dx) a, (SELECT unnest(range(-1, 2))::INTEGER AS dy) b), kk AS (SELECT DISTINCT vec_id FROM (SELECT vec_id FROM mask UNION ALL SELECT vec_id FROM mt)), "
    "pa AS (SELECT vec_id, dx, dy, x - dx AS x, y - dy AS y, roi_id AS r FROM mask, sh WHERE x - dx BETWEEN 0 AND 7 AND y - dy BETWEEN 0 AND 7), pb AS (SELECT vec_id, dx, dy, x, y, roi_id AS r FROM mt, sh WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7), "
    "bad AS (SELECT DISTINCT vec_id, dx, dy FROM ((SELECT * FROM pa EXCEPT SELECT * FROM pb) UNION ALL (SELECT * FROM pb EXCEPT SELECT * FROM pa))), "
    "ok AS (SELECT vec_id, dx, dy FROM kk, sh EXCEPT SELECT * FROM bad), g AS (SELECT vec_id, bool_or(dx = 0 AND dy = 0) AS same, min(dx) AS dx, arg_min(dy, (dx, dy)) AS dy FROM ok GROUP BY 1) "
    "SELECT kk.vec_id, CASE WHEN same THEN 'same' WHEN g.dx IS NOT NULL THEN 'shifted' ELSE 'different' END AS relation, CASE WHEN same THEN 0 ELSE g.dx END AS dx, CASE WHEN same THEN 0 ELSE g.dy END AS dy FROM kk LEFT JOIN g USING (vec_id)",
    use="mask",
)
def compare_masks(spark, sf):
    return J.compare_masks(mask(spark, sf), _mask_shifted(spark, sf), ["vec_id"], 8, 8, 1)


_REF = "ref AS (SELECT label, x, y, avg(v) AS w FROM pixels GROUP BY 1, 2, 3), sh AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3))::INTEGER AS dx) a, (SELECT unnest(range(-2, 3))::INTEGER AS dy) b)"


@query(
    f"WITH {_REF}, sc AS (SELECT vec_id, dx, dy, -avg((v - w) * (v - w)) AS score FROM pixels p, sh, ref r WHERE r.label = p.label AND r.x = p.x + dx AND r.y = p.y + dy GROUP BY 1, 2, 3) "
    "SELECT vec_id, arg_max(dx, (score, -dx, -dy)) AS dx, arg_max(dy, (score, -dx, -dy)) AS dy, round(max(score), 8) AS score FROM sc GROUP BY 1",
    use="pixels",
)
def best_shift(spark, sf):
    p = pixels(spark, sf)
    ref = p.groupBy("label", "x", "y").agg(F.avg("v").alias("v"))
    return _r(J.best_shift(p, ref, ["vec_id", "label"], ["label"], 2, "mse"), 8, "score").drop("label")


@query(
    f"WITH {_REF} SELECT vec_id, dx, dy, round(corr(v, w), 6) AS score FROM pixels p, sh, ref r WHERE r.label = p.label AND r.x = p.x + dx AND r.y = p.y + dy GROUP BY 1, 2, 3",
    use="pixels",
)
def shift_scores(spark, sf):
    p = pixels(spark, sf)
    ref = p.groupBy("label", "x", "y").agg(F.avg("v").alias("v"))
    return _r(J.shift_scores(p, ref, ["vec_id", "label"], ["label"], 2, "corr"), 6, "score").drop("label")


@query(
    "WITH t AS (SELECT x AS u, y AS v, avg(p.v) AS w FROM pixels p WHERE x < 3 AND y < 3 AND NOT (x = 1 AND y = 1) GROUP BY 1, 2), im AS (SELECT label, vec_id AS z, x, y, v FROM pixels), "
    "sc AS (SELECT label, z, x - u AS ox, y - t.v AS oy, -100 * sum((im.v - w) * (im.v - w)) / 9 - 0.01::DOUBLE * any_value(pow(x - u - 4 + 1, 2) + pow(y - t.v - 4 + 1, 2)) AS score FROM im, t WHERE x - u BETWEEN 0 AND 5 AND y - t.v BETWEEN 0 AND 5 GROUP BY 1, 2, 3, 4) "
    "SELECT label, arg_max(z, (score, -z, -oy, -ox)) AS z, arg_max(ox, (score, -z, -oy, -ox)) AS ox, arg_max(oy, (score, -z, -oy, -ox)) AS oy, round(max(score), 6) AS score FROM sc GROUP BY 1",
    use="pixels",
)
def match_template(spark, sf):
    p = pixels(spark, sf)
    t = p.filter("x < 3 and y < 3 and not (x = 1 and y = 1)").groupBy(F.col("x").alias("u"), F.col("y").alias("v")).agg(F.avg(p.v).alias("w"))
    im = p.select("label", F.col("vec_id").alias("z"), "x", "y", "v")
    return _r(J.match_template(im, t, ["label"], (8, 8), (3, 3), (4.0, 4.0), 0.01), 6, "score")


@query(
    "WITH c AS (SELECT vec_id, arg_max(x, (v, x, y)) AS cx, arg_max(y, (v, x, y)) AS cy FROM pixels GROUP BY 1), b AS (SELECT vec_id, floor(greatest(cx - 2.5::DOUBLE, 0))::INTEGER AS x0, ceil(least(cx + 2.5::DOUBLE, 8))::INTEGER AS x1, floor(greatest(cy - 1.5::DOUBLE, 0))::INTEGER AS y0, ceil(least(cy + 1.5::DOUBLE, 8))::INTEGER AS y1 FROM c) "
    "SELECT vec_id, x - x0 AS x, y - y0 AS y, v FROM pixels JOIN b USING (vec_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1",
    use="pixels",
)
def crop(spark, sf):
    p = pixels(spark, sf)
    m = F.max_by(F.struct("x", "y"), F.struct("v", "x", "y"))
    c = p.groupBy("vec_id").agg(m.alias("m")).select("vec_id", F.col("m.x").alias("cx"), F.col("m.y").alias("cy"))
    return J.crop(p, c, ["vec_id"], (5, 3), (8, 8)).select("vec_id", "x", "y", "v")


@query(
    "WITH k AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0::DOUBLE), (0, 2, 1.0::DOUBLE), (1, 0, 0.0::DOUBLE), (1, 1, 0.5::DOUBLE), (1, 2, 0.0::DOUBLE), (2, 0, -1.0::DOUBLE), (2, 1, -2.0::DOUBLE), (2, 2, -1.0::DOUBLE)) t(a, b, w)) "
    "SELECT vec_id, (x - a) // 2 AS u, (y - b) // 2 AS w, round(sum(CASE WHEN v > 0 THEN v ELSE 0 END * k.w) + 0.25::DOUBLE, 8) + 0.0 AS v FROM pixels, k WHERE x - a BETWEEN 0 AND 5 AND y - b BETWEEN 0 AND 5 AND (x - a) % 2 = 0 AND (y - b) % 2 = 0 GROUP BY 1, 2, 3",
    use="pixels",
)
def strided_kernel(spark, sf):
    k = [[1.0, 2.0, 1.0], [0.0, 0.5, 0.0], [-1.0, -2.0, -1.0]]
    return _r(J.strided_kernel(pixels(spark, sf), ["vec_id"], k, (8, 8), 2, relu=0.0, bias=0.25), 8, "v")
