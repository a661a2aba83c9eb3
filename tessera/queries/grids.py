"""Queries for pixel, label and volume grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as G
from .fixtures import mask, pixels, table
from .joins import _MASKS, _SHIFTED, _mask_b, _mask_shifted
from .registry import query

V = ["vec_id"]
L = ["label"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def _img(spark, sf):
    return pixels(spark, sf).select("vec_id", "x", "y", "v")


def _stack(spark, sf):
    """The images of a label as frames of one recording."""
    return pixels(spark, sf).select("label", F.col("vec_id").alias("frame"), "x", "y", "v")


def _volume(spark, sf):
    """Five images in a row as layers of one volume."""
    return pixels(spark, sf).select(F.expr("vec_id div 5").alias("cell"), (F.col("vec_id") % 5).cast("int").alias("z"), "x", "y", F.abs("v").alias("v"))


_VOL = "vol AS (SELECT vec_id // 5 AS cell, (vec_id % 5)::INTEGER AS z, x, y, abs(v) AS v FROM pixels)"


@query(
    "SELECT a.label, a.x, a.y, round(avg(r), 6) + 0.0 AS v FROM (SELECT a.label, a.x, a.y, corr(a.v, b.v) AS r FROM pixels a JOIN pixels b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.label, a.x, a.y, b.x, b.y) a GROUP BY 1, 2, 3",
    use="pixels",
)
def neighbour_corr(spark, sf):
    return _r(G.neighbour_corr(_stack(spark, sf), L), 6, "v")


@query("SELECT vec_id, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6 THEN v ELSE 0 END AS v FROM pixels", use="pixels")
def zero_border(spark, sf):
    return G.zero_border(_img(spark, sf), (8, 8), (1, 1), (2, 1))


@query(
    "WITH p AS (SELECT vec_id, y, quantile_cont(v, 0.7) AS q FROM pixels WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1, 2) SELECT vec_id, y, round(greatest(coalesce(q, 1), 0.02), 8) AS threshold FROM (SELECT DISTINCT vec_id, y FROM pixels) LEFT JOIN p USING (vec_id, y)",
    use="pixels",
)
def line_threshold(spark, sf):
    return _r(G.line_threshold(_img(spark, sf), V, (8, 8), (1, 1), (1, 1), 70, 0.02), 8, "threshold")


# Components of a mask table m by reachability: every pixel takes the smallest position it reaches.
_CC = (
    "cc AS (SELECT vec_id, roi_id, x, y, y * 8 + x AS root FROM {m} UNION SELECT n.vec_id, n.roi_id, n.x, n.y, cc.root FROM cc JOIN {m} n ON n.vec_id = cc.vec_id AND n.roi_id = cc.roi_id AND {adj}), "
    "rt AS (SELECT vec_id, x, y, min(root) AS root FROM cc GROUP BY 1, 2, 3), lab AS (SELECT vec_id, x, y, (dense_rank() OVER (PARTITION BY vec_id ORDER BY root))::INTEGER AS roi_id FROM rt)"
)
_A8 = "abs(n.x - cc.x) <= 1 AND abs(n.y - cc.y) <= 1"
_A4 = "abs(n.x - cc.x) + abs(n.y - cc.y) = 1"


@query(f"WITH {_CC.format(m='mask', adj=_A8)} SELECT * FROM lab", use="mask")
def connected_components(spark, sf):
    return G.connected_components(mask(spark, sf), V, 8)


@query(f"WITH {_CC.format(m='mask', adj=_A4)} SELECT * FROM lab", use="mask")
def connected_components_sides(spark, sf):
    return G.connected_components(mask(spark, sf), V, 4)


@query(
    "WITH mm AS (SELECT vec_id, x, y, 1 AS roi_id FROM pixels WHERE v >= 0.03), " + _CC.format(m="mm", adj=_A4) + ", ok AS (SELECT vec_id, roi_id FROM lab GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 20 AND max(x) - min(x) + 1 <= 6) "
    "SELECT vec_id, x, y, (dense_rank() OVER (PARTITION BY vec_id ORDER BY roi_id))::INTEGER AS roi_id FROM lab JOIN ok USING (vec_id, roi_id)",
    use="pixels",
)
def grow_regions(spark, sf):
    return G.grow_regions(_img(spark, sf), V, 0.03, 3, 20, (6, 8))


@query(
    "WITH rr AS (SELECT p.label, p.x, p.y, corr(p.v, s.v) AS r FROM pixels p JOIN pixels s ON s.vec_id = p.vec_id AND s.x = p.label % 8 AND s.y = 4 WHERE sqrt(pow(p.x - p.label % 8, 2) + pow(p.y - 4, 2)) <= 3 GROUP BY 1, 2, 3), "
    "mm AS (SELECT label, x, y FROM rr WHERE r >= -0.05), reach AS (SELECT label, x, y FROM mm WHERE x = label % 8 AND y = 4 UNION SELECT n.label, n.x, n.y FROM reach cc JOIN mm n ON n.label = cc.label AND abs(n.x - cc.x) + abs(n.y - cc.y) = 1) SELECT * FROM reach",
    use="pixels",
)
def similar_region(spark, sf):
    s = _stack(spark, sf)
    seeds = s.select("label").distinct().select("label", (F.col("label") % 8).alias("sx"), F.lit(4).alias("sy"))
    return G.similar_region(seeds, s, L, 3.0, -0.05)


@query(
    "SELECT c_custkey, x, y FROM (SELECT c_custkey, c_custkey % 20 AS cx, c_nationkey % 15 AS cy, c_custkey % 4 AS r FROM customer), (SELECT unnest(range(20))::INTEGER AS x), (SELECT unnest(range(15))::INTEGER AS y) WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= r"
)
def circular_mask(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select("c_custkey", (k % 20).alias("cx"), (F.col("c_nationkey") % 15).alias("cy"), (k % 4).alias("r"))
    return G.circular_mask(d, ["c_custkey"], 20, 15)


@query("SELECT * FROM mask WHERE (vec_id, roi_id) IN (SELECT (vec_id, roi_id) FROM mask GROUP BY vec_id, roi_id HAVING count(*) >= 12)", use="mask")
def remove_small(spark, sf):
    return G.remove_small(mask(spark, sf), V, 12).select("vec_id", "x", "y", "roi_id")


@query("SELECT * FROM mask WHERE x >= 2", use="mask")
def blank_artifact(spark, sf):
    return G.blank_artifact(mask(spark, sf), 2)


@query(
    "WITH mm AS (SELECT * FROM mask WHERE x >= 1), " + _CC.format(m="mm", adj=_A8) + ", ok AS (SELECT vec_id, roi_id FROM lab GROUP BY 1, 2 HAVING count(*) >= 3) "
    "SELECT vec_id, x, y, (dense_rank() OVER (PARTITION BY vec_id ORDER BY roi_id))::INTEGER AS roi_id FROM lab JOIN ok USING (vec_id, roi_id)",
    use="mask",
)
def clean_labels(spark, sf):
    return G.clean_labels(mask(spark, sf), V, 1, 3, 8).select("vec_id", "x", "y", "roi_id")


@query(
    "WITH nb AS (SELECT DISTINCT a.* FROM mask a JOIN mask b ON a.vec_id = b.vec_id AND a.roi_id = b.roi_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1), ok AS (SELECT vec_id, roi_id FROM nb GROUP BY 1, 2 HAVING count(*) >= 3) SELECT nb.* FROM nb JOIN ok USING (vec_id, roi_id)",
    use="mask",
)
def drop_isolated(spark, sf):
    return G.drop_isolated(mask(spark, sf), V).select("vec_id", "x", "y", "roi_id")


@query("SELECT label, x, y, (dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS roi_id FROM (SELECT label, vec_id, x, y FROM pixels WHERE v > 0.2)", use="pixels")
def consecutive_labels(spark, sf):
    p = pixels(spark, sf).filter("v > 0.2").select("label", "x", "y", F.col("vec_id").alias("roi_id"))
    return G.consecutive_labels(p, L)


@query(
    "WITH f AS (SELECT vec_id, x, y, abs(v) AS cell, v AS centre, v * 2 AS ox, -v AS oy FROM pixels), t AS (SELECT a.*, (SELECT max(b.centre) FROM f b WHERE b.vec_id = a.vec_id AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2) AS top FROM f a), "
    "c AS (SELECT vec_id, x AS cx, y AS cy, rank() OVER (PARTITION BY vec_id ORDER BY centre DESC) AS r FROM t WHERE centre = top AND centre >= 0.1 AND cell > 0.05), "
    "n AS (SELECT f.vec_id, f.x, f.y, min({'d': round(pow(cx - x - ox, 2) + pow(cy - y - oy, 2), 9), 'cx': cx, 'cy': cy}) AS b FROM f JOIN c ON c.vec_id = f.vec_id AND r <= 3 WHERE cell > 0.05 GROUP BY 1, 2, 3) "
    "SELECT vec_id, x, y, (dense_rank() OVER (PARTITION BY vec_id ORDER BY b.cx, b.cy))::INTEGER AS roi_id FROM n",
    use="pixels",
)
def assign_to_centres(spark, sf):
    v = F.col("v")
    p = _img(spark, sf).select("vec_id", "x", "y", F.abs(v).alias("cell"), v.alias("centre"), (v * 2).alias("ox"), (-v).alias("oy"))
    return G.assign_to_centres(p, V, 0.05, 0.1, 5, 3)


@query(
    f"WITH {_MASKS}, o AS (SELECT * FROM mask WHERE roi_id = 1), mm AS (SELECT vec_id, x, y, roi_id FROM mb n WHERE roi_id = 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.vec_id = n.vec_id AND abs(o.x - n.x) + abs(o.y - n.y) <= 1)), "
    + _CC.format(m="mm", adj=_A8) + ", ok AS (SELECT vec_id, roi_id FROM lab GROUP BY 1, 2 HAVING count(*) >= 3), mx AS (SELECT vec_id, max(roi_id) AS m FROM o GROUP BY 1) "
    "SELECT * FROM o UNION ALL SELECT lab.vec_id, x, y, (dense_rank() OVER (PARTITION BY lab.vec_id ORDER BY lab.roi_id) + coalesce(m, 0))::INTEGER FROM lab JOIN ok USING (vec_id, roi_id) LEFT JOIN mx USING (vec_id)",
    use="mask",
)
def add_labels(spark, sf):
    return G.add_labels(_mask_b(spark, sf).filter("roi_id = 2"), mask(spark, sf).filter("roi_id = 1"), V).select("vec_id", "x", "y", "roi_id")


@query(
    f"WITH {_MASKS}, na AS (SELECT vec_id, roi_id, count(*) AS n FROM mask GROUP BY 1, 2), nb AS (SELECT vec_id, roi_id, count(*) AS n FROM mb GROUP BY 1, 2), o AS (SELECT vec_id, a.roi_id AS ra, b.roi_id AS rb, count(*) AS n FROM mask a JOIN mb b USING (vec_id, x, y) GROUP BY ALL), "
    "bst AS (SELECT o.vec_id, rb, max(o.n / (na.n + nb.n - o.n)::DOUBLE) AS iou FROM o JOIN na ON na.vec_id = o.vec_id AND na.roi_id = ra JOIN nb ON nb.vec_id = o.vec_id AND nb.roi_id = rb GROUP BY 1, 2) "
    "SELECT mb.* FROM mb LEFT JOIN bst ON bst.vec_id = mb.vec_id AND rb = mb.roi_id WHERE coalesce(iou, 0) < 0.25",
    use="mask",
)
def suggest_labels(spark, sf):
    return G.suggest_labels(_mask_b(spark, sf), mask(spark, sf), V, 0.25).select("vec_id", "x", "y", "roi_id")


@query(
    "WITH f AS (SELECT vec_id, x, y, CASE WHEN vec_id % 3 = 0 THEN coalesce(roi_id, 0) WHEN vec_id % 3 = 1 THEN coalesce(-roi_id, 1) ELSE coalesce(-roi_id, 0) END AS v FROM pixels LEFT JOIN mask USING (vec_id, x, y)) "
    "SELECT vec_id, x, y, abs(v) AS roi_id, CASE WHEN vec_id % 3 = 0 THEN 'positive' ELSE 'negative' END AS format FROM f WHERE CASE WHEN vec_id % 3 = 1 THEN v <> 1 ELSE v <> 0 END",
    use="mask",
)
def mask_format(spark, sf):
    p = _img(spark, sf).select("vec_id", "x", "y").join(mask(spark, sf), ["vec_id", "x", "y"], "left")
    k = F.col("vec_id") % 3
    v = F.when(k == 0, F.coalesce("roi_id", F.lit(0))).when(k == 1, F.coalesce(-F.col("roi_id"), F.lit(1))).otherwise(F.coalesce(-F.col("roi_id"), F.lit(0)))
    return G.mask_format(p.select("vec_id", "x", "y", v.alias("v")), V)


@query(
    "SELECT vec_id, (x + d)::INTEGER AS x, (y - 1)::INTEGER AS y, roi_id FROM (SELECT *, vec_id % 3 - 1 AS d FROM mask WHERE x >= 1) WHERE x + d >= CASE WHEN d > 0 THEN d + 1 ELSE 0 END AND x + d < 8 AND y >= 1", use="mask",
)
def shift_mask(spark, sf):
    out = G.shift_mask(mask(spark, sf), (8, 8), (F.col("vec_id") % 3 - 1).cast("int"), -1, 1)
    return out


@query(
    "WITH s AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice AS b FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, o_orderkey AS roi_id FROM s WHERE b < 500000"
)
def select_near(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("roi_id"), "o_orderstatus", "o_orderdate", "o_totalprice")
    return G.select_near(o, ["o_custkey"], "o_orderdate", "o_totalprice", 500000.0, F.col("o_orderstatus") != "P").select("o_custkey", "roi_id")


@query(
    "WITH c AS (SELECT vec_id, arg_max(roi_id, (n, -roi_id)) AS roi_id FROM (SELECT vec_id, roi_id, count(*) AS n FROM mask GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, x, y, 1 AS roi_id FROM mask JOIN c USING (vec_id, roi_id)", use="mask"
)
def merge_rois(spark, sf):
    m = mask(spark, sf)
    n = m.groupBy("vec_id", "roi_id").agg(F.count("*").alias("n"))
    c = n.groupBy("vec_id").agg(F.max_by("roi_id", F.struct("n", -F.col("roi_id"))).alias("roi_id"))
    return G.merge_rois(m, c, V)


@query(
    f"WITH {_SHIFTED}, mm AS (SELECT vec_id AS field, 0 AS pres, x, y, roi_id FROM mask UNION ALL SELECT vec_id, 1, x, y, roi_id FROM mt), sh AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2))::INTEGER AS dx) a, (SELECT unnest(range(-1, 2))::INTEGER AS dy) b), "
    "kk AS (SELECT DISTINCT field, pres FROM mm), rf AS (SELECT kk.field, kk.pres, x, y, roi_id FROM kk JOIN mm m ON m.field = kk.field AND m.pres = 0), "
    "pa AS (SELECT field, pres, dx, dy, x - dx AS x, y - dy AS y, roi_id AS r FROM mm, sh WHERE x - dx BETWEEN 0 AND 7 AND y - dy BETWEEN 0 AND 7), pb AS (SELECT field, pres, dx, dy, x, y, roi_id AS r FROM rf, sh WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7), "
    "bad AS (SELECT DISTINCT field, pres, dx, dy FROM ((SELECT * FROM pa EXCEPT SELECT * FROM pb) UNION ALL (SELECT * FROM pb EXCEPT SELECT * FROM pa))), "
    "ok AS (SELECT field, pres, dx, dy FROM kk, sh EXCEPT SELECT * FROM bad), g AS (SELECT field, pres, bool_or(dx = 0 AND dy = 0) AS same, min(dx) AS dx, arg_min(dy, (dx, dy)) AS dy FROM ok GROUP BY 1, 2) "
    "SELECT kk.field, kk.pres, CASE WHEN same THEN 'same' WHEN g.dx IS NOT NULL THEN 'shifted' ELSE 'different' END AS relation, CASE WHEN same THEN 0 ELSE g.dx END AS dx, CASE WHEN same THEN 0 ELSE g.dy END AS dy FROM kk LEFT JOIN g USING (field, pres)",
    use="mask",
)
def field_masks(spark, sf):
    a = mask(spark, sf).withColumn("pres", F.lit(0))
    m = a.unionByName(_mask_shifted(spark, sf).withColumn("pres", F.lit(1))).withColumnRenamed("vec_id", "field")
    files = a.select(F.col("vec_id").alias("field"), "pres").distinct()
    return G.field_masks(m, files, ["field"], "pres", 8, 8, 1)


@query(
    "SELECT vec_id, ox AS x, oy AS y, v FROM pixels JOIN (SELECT unnest(range(11))::INTEGER AS ox) ON x = floor((ox + 0.5) * 8 / 11) JOIN (SELECT unnest(range(5))::INTEGER AS oy) ON y = floor((oy + 0.5) * 8 / 5)", use="pixels"
)
def resize_nearest(spark, sf):
    return G.resize_nearest(_img(spark, sf), (8, 8), (11, 5))


@query(
    "WITH p AS (SELECT vec_id, x, y, CASE WHEN v > 0.2 THEN NULL ELSE v END AS v FROM pixels), o AS (SELECT unnest(range(12))::INTEGER AS o), c AS (SELECT o, least(greatest((o + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0), 7) AS c, floor((o + 0.5::DOUBLE) * 8 / 12)::INTEGER AS s FROM o), "
    "k AS (SELECT p.vec_id, a.o AS x, b.o AS y, sum(coalesce(v, 0) * greatest(1 - abs(a.c - p.x), 0) * greatest(1 - abs(b.c - p.y), 0)) AS v, any_value(a.s) AS sx, any_value(b.s) AS sy FROM p, c a, c b WHERE abs(a.c - p.x) < 1 AND abs(b.c - p.y) < 1 GROUP BY 1, 2, 3) "
    "SELECT k.vec_id, k.x, k.y, round(k.v, 8) + 0.0 AS v FROM k JOIN p ON p.vec_id = k.vec_id AND p.x = sx AND p.y = sy WHERE p.v IS NOT NULL",
    use="pixels",
)
def rescale(spark, sf):
    p = _img(spark, sf).withColumn("v", F.when(F.col("v") <= 0.2, F.col("v")))
    return _r(G.rescale(p, V, (8, 8), 1.5, 1), 8, "v")


@query("SELECT vec_id, (x * 3 + a)::INTEGER AS x, (y * 3 + b)::INTEGER AS y, v FROM pixels, range(3) r(a), range(3) s(b)", use="pixels")
def int_upscale(spark, sf):
    return G.int_upscale(_img(spark, sf), 3)


@query("SELECT vec_id, (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, round(avg(v), 8) + 0.0 AS v FROM pixels GROUP BY 1, 2, 3", use="pixels")
def int_downscale(spark, sf):
    return _r(G.int_downscale(_img(spark, sf), V, 2), 8, "v")


@query()
def keep_lost_labels(spark, sf):
    quarter = F.col("roi_id") * 4 + F.expr("x div 4").cast("int") * 2 + F.expr("y div 4").cast("int")
    m = mask(spark, sf).withColumn("roi_id", quarter)
    return G.keep_lost_labels(m, G.resize_nearest(m, (8, 8), (5, 5)), V, (8, 8), (5, 5))


_KER = "kn AS (SELECT k, exp(-0.5::DOUBLE * k * k / {s2}) / (SELECT sum(exp(-0.5::DOUBLE * i * i / {s2})) FROM range(-{r}, {r1}) q(i)) AS w FROM range(-{r}, {r1}) q(k))"


@query(
    f"WITH {_KER.format(s2='1.0::DOUBLE', r=4, r1=5)} SELECT p.vec_id, p.x, p.y, round(sum(q.v * a.w * b.w), 8) + 0.0 AS v FROM pixels p, kn a, kn b JOIN pixels q ON q.vec_id = p.vec_id AND q.x = greatest(0, least(7, p.x + a.k)) AND q.y = greatest(0, least(7, p.y + b.k)) GROUP BY 1, 2, 3",
    use="pixels",
)
def blur2d(spark, sf):
    return _r(G.blur2d(_img(spark, sf), V, 1.0), 8, "v")


_MIRROR = "CASE WHEN {p} < 0 THEN -({p}) - 1 WHEN {p} >= {n} THEN 2 * {n} - 1 - ({p}) ELSE {p} END"


@query(
    f"WITH {_VOL}, {_KER.format(s2='0.49::DOUBLE', r=3, r1=4)}, bx AS (SELECT p.cell, p.x, p.y, p.z, sum(q.v * w) AS v FROM vol p, kn JOIN vol q ON q.cell = p.cell AND q.y = p.y AND q.z = p.z AND q.x = {_MIRROR.format(p='p.x + k', n=8)} GROUP BY 1, 2, 3, 4), "
    f"yb AS (SELECT p.cell, p.x, p.y, p.z, sum(q.v * w) AS v FROM bx p, kn JOIN bx q ON q.cell = p.cell AND q.x = p.x AND q.z = p.z AND q.y = {_MIRROR.format(p='p.y + k', n=8)} GROUP BY 1, 2, 3, 4), "
    f"zb AS (SELECT p.cell, p.x, p.y, p.z, sum(q.v * w) AS v FROM yb p, kn JOIN yb q ON q.cell = p.cell AND q.x = p.x AND q.y = p.y AND q.z = {_MIRROR.format(p='p.z + k', n=5)} GROUP BY 1, 2, 3, 4) "
    "SELECT cell, x, y, z, round(sqrt(v / max(v) OVER (PARTITION BY cell)), 8) AS v FROM zb",
    use="pixels",
)
def blur3d(spark, sf):
    return _r(G.blur3d(_volume(spark, sf), ["cell"], 0.7, 0.5), 8, "v")


_LAYERS = "ls AS (SELECT cell, z, sum(v) AS s FROM vol GROUP BY 1, 2), ly AS (SELECT cell, z FROM ls JOIN (SELECT cell, median(s) AS m FROM ls GROUP BY 1) USING (cell) WHERE s > m)"


@query(f"WITH {_VOL}, {_LAYERS} SELECT vol.cell, ly.z AS z0, x, y, round(max(v * exp(-pow(abs(vol.z - ly.z) / 2.0::DOUBLE, 2))), 8) AS v FROM vol JOIN ly USING (cell) GROUP BY 1, 2, 3, 4", use="pixels")
def weighted_z_max(spark, sf):
    v = _volume(spark, sf)
    return _r(G.weighted_z_max(v, G.dense_layers(v, ["cell"]), ["cell"], 2.0, 2.0), 8, "v")


@query(
    "SELECT vec_id // 5 AS cell, x, y, round(coalesce(sum(w * (vec_id % 5 / 4.0::DOUBLE)) / nullif(sum(w), 0), 0), 8) AS r, round(coalesce(sum(w * (vec_id % 2)) / nullif(sum(w), 0), 0), 8) AS g FROM (SELECT *, greatest(v, 0) AS w FROM pixels) GROUP BY 1, 2, 3",
    use="pixels",
)
def blend_stacks(spark, sf):
    k = F.col("vec_id")
    p = pixels(spark, sf).select(F.expr("vec_id div 5").alias("cell"), "x", "y", F.greatest("v", F.lit(0.0)).alias("w"), (k % 5 / F.lit(4.0)).alias("r"), (k % 2).cast("double").alias("g"))
    return _r(G.blend_stacks(p, ["cell", "x", "y"], ["r", "g"]), 8, "r", "g")


@query(
    f"WITH {_VOL} SELECT cell, x, y, round(least(greatest(max(v * pow(z / 4.0::DOUBLE + 1, 2) / ((1 + 1.5625::DOUBLE + 2.25 + 3.0625 + 4) / 5)), 0), 1), 8) AS v FROM vol GROUP BY 1, 2, 3", use="pixels"
)
def project_z(spark, sf):
    return _r(G.project_z(_volume(spark, sf), ["cell"], 5, ["v"]), 8, "v")


_HOLES = "hp AS (SELECT vec_id, x, y, CASE WHEN x + y <> 3 THEN v END AS v FROM pixels)"


@query(
    f"WITH {_HOLES}, s AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.2) AS lo FROM hp GROUP BY 1), a AS (SELECT hp.*, m, sd, v - lo AS d FROM hp JOIN s USING (vec_id)), "
    "h AS (SELECT vec_id, quantile_cont(d, 0.9) AS hi, max(d) AS mx FROM a GROUP BY 1) SELECT vec_id, x, y, CASE WHEN v IS NOT NULL THEN (v > m + 0.25::DOUBLE * sd)::INTEGER::DOUBLE END AS on_off, "
    "CASE WHEN v IS NOT NULL THEN round(least(greatest(d / CASE WHEN hi > 0.1 THEN hi ELSE mx END, 0), 1), 8) END AS scaled FROM a JOIN h USING (vec_id)",
    use="pixels",
)
def template_prep(spark, sf):
    p = _img(spark, sf).withColumn("v", F.when(F.col("x") + F.col("y") != 3, F.col("v")))
    a = G.template_threshold(p, V).withColumnRenamed("v", "on_off")
    b = G.template_scale(p, V).withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")))
    b = b.join(p.filter("v is not null").select("vec_id", "x", "y"), ["vec_id", "x", "y"], "left_semi")
    return a.join(_r(b, 8, "v").withColumnRenamed("v", "scaled"), ["vec_id", "x", "y"], "left")


@query(
    "WITH m AS (SELECT label, x, y, avg(v) AS v FROM pixels GROUP BY 1, 2, 3), s AS (SELECT label, avg(v) AS a, stddev_pop(v) AS sd FROM m WHERE x >= 2 GROUP BY 1) SELECT label, x, y, CASE WHEN x >= 2 THEN round((v - a) / sd, 6) + 0.0 END AS v FROM m JOIN s USING (label)",
    use="pixels",
)
def template_from_stack(spark, sf):
    return _r(G.template_from_stack(_stack(spark, sf), L, 2), 6, "v")


@query(
    "SELECT DISTINCT l_suppkey, least(round_even(l_quantity / 2.5::DOUBLE, 0), 15)::INTEGER AS x, least(round_even(l_linenumber / 0.75::DOUBLE, 0), 7)::INTEGER AS y FROM lineitem"
)
def voxelize(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"))
    return G.voxelize(l, ["l_suppkey"], {"x": 2.5, "y": 0.75}, {"x": 16, "y": 8})


@query(
    "WITH s AS (SELECT s_suppkey, round_even(s_acctbal / 200, 0)::INTEGER AS cx, round_even(s_nationkey / 0.5::DOUBLE, 0)::INTEGER AS cy, round_even(s_suppkey % 30 / 1.0::DOUBLE, 0)::INTEGER AS cz FROM supplier) "
    "SELECT s_suppkey, (cx + a)::INTEGER AS x, (cy + b)::INTEGER AS y, (cz + c)::INTEGER AS z FROM s, range(-5, 6) q(a), range(-6, 7) r(b), range(-3, 4) t(c) "
    "WHERE a * a / (25 - pow(c / 4.0::DOUBLE * 5, 2)) + b * b / (36 - pow(c / 4.0::DOUBLE * 5, 2)) < 1 AND cx + a BETWEEN 0 AND 49 AND cy + b BETWEEN 0 AND 39"
)
def soma_ellipsoid(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 30).cast("double").alias("z"))
    return G.soma_ellipsoid(s, ["s_suppkey"], (200.0, 0.5, 1.0), (1000.0, 3.0, 4.0), (50, 40))


@query(
    "WITH lv AS (SELECT vec_id, x, y, level, v FROM pixels, (VALUES (0.3::DOUBLE), (0.5::DOUBLE)) t(level)), mx AS (SELECT vec_id, max(abs(v)) AS m FROM pixels GROUP BY 1), mm AS (SELECT vec_id, level, x, y FROM lv JOIN mx USING (vec_id) WHERE v >= level * m), "
    "cc AS (SELECT vec_id, level, x, y, y * 8 + x AS root FROM mm UNION SELECT n.vec_id, n.level, n.x, n.y, cc.root FROM cc JOIN mm n ON n.vec_id = cc.vec_id AND n.level = cc.level AND abs(n.x - cc.x) + abs(n.y - cc.y) = 1), "
    "rt AS (SELECT vec_id, level, x, y, min(root) AS root FROM cc GROUP BY 1, 2, 3, 4), n AS (SELECT vec_id, level, root, count(*) AS n FROM rt GROUP BY 1, 2, 3) "
    "SELECT vec_id, level, row_number() OVER (PARTITION BY vec_id, level ORDER BY n DESC, root) AS place, n, round(n * 4.0::DOUBLE, 6) AS area_um2, round(2 * sqrt(n * 4.0::DOUBLE / pi()), 6) AS dia_um, "
    "round(n / sum(n) OVER (PARTITION BY vec_id, level)::DOUBLE, 8) AS share, count(*) OVER (PARTITION BY vec_id, level) = 1 AS single FROM n",
    use="pixels",
)
def level_regions(spark, sf):
    return _r(_r(G.level_regions(_img(spark, sf), V, [0.3, 0.5], 2.0), 6, "area_um2", "dia_um"), 8, "share")


@query("SELECT vec_id, roi_id, count(*) AS area, round(avg(x), 8) AS cx, round(avg(y), 8) AS cy FROM mask GROUP BY 1, 2", use="mask")
def region_moments(spark, sf):
    return _r(G.region_moments(mask(spark, sf), [*V, "roi_id"]), 8, "cx", "cy")


@query(
    "WITH co AS (SELECT DISTINCT vec_id, roi_id, x + a AS x, y + b AS y FROM mask, range(2) q(a), range(2) r(b)), e AS (SELECT a.vec_id, a.roi_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM co a JOIN co b ON a.vec_id = b.vec_id AND a.roi_id = b.roi_id AND (a.x <> b.x OR a.y <> b.y) "
    "WHERE NOT EXISTS (SELECT 1 FROM co c WHERE c.vec_id = a.vec_id AND c.roi_id = a.roi_id AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (b.x - a.x) * (c.x - b.x) + (b.y - a.y) * (c.y - b.y) > 0) "
    "OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < 0)))), h AS (SELECT vec_id, roi_id, sum(ax * by_ - ay * bx) / 2.0::DOUBLE AS hull_area FROM e GROUP BY 1, 2), "
    "m AS (SELECT vec_id, roi_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM mask GROUP BY 1, 2) SELECT vec_id, roi_id, area, round(cx, 8) AS cx, round(cy, 8) AS cy, hull_area, round(1 - area / hull_area, 8) + 0.0 AS irregularity FROM m JOIN h USING (vec_id, roi_id)",
    use="mask",
)
def region_irregularity(spark, sf):
    return _r(G.region_irregularity(mask(spark, sf), [*V, "roi_id"]), 8, "irregularity", "cx", "cy")


_PARTS = (
    "rg AS (SELECT vec_id, x, y FROM pixels WHERE v > 0.2), md AS (SELECT p.vec_id, p.x, p.y, p.v, (SELECT min((r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y)) FROM rg r WHERE r.vec_id = p.vec_id) AS d FROM pixels p WHERE p.vec_id IN (SELECT vec_id FROM rg)), "
    "pt AS (SELECT vec_id, x, y, v, CASE WHEN d = 0 THEN 'center' WHEN d < 4 THEN 'gap' WHEN d < 16 THEN 'surround' ELSE 'outside' END AS part FROM md)"
)


def _parts(spark, sf):
    return G.center_surround_masks(_img(spark, sf).filter("v > 0.2").select("vec_id", "x", "y"), V, (8, 8), 2, 4)


@query(f"WITH {_PARTS} SELECT vec_id, x, y, part FROM pt", use="pixels")
def center_surround_masks(spark, sf):
    return _parts(spark, sf)


@query(
    f"WITH {_PARTS} SELECT vec_id, round(sum(CASE WHEN part = 'center' THEN v ELSE 0 END) / sum(abs(v)), 8) + 0.0 AS center_index, round(sum(CASE WHEN part = 'surround' THEN v ELSE 0 END) / sum(abs(v)), 8) + 0.0 AS surround_index, "
    "round(sum(CASE WHEN part IN ('surround', 'outside') THEN v ELSE 0 END) / sum(abs(v)), 8) + 0.0 AS full_surround_index FROM pt GROUP BY 1",
    use="pixels",
)
def center_surround_index(spark, sf):
    out = G.center_surround_index(_img(spark, sf), _parts(spark, sf), V)
    return _r(out, 8, "center_index", "surround_index", "full_surround_index")


@query(
    "WITH g AS (SELECT label, vec_id AS frame, x, y, (floor(abs(v) * 255) + floor(abs(v) * 100)) / 2 / 255 AS v FROM pixels) SELECT label, frame, x, y, round((v - avg(v) OVER (PARTITION BY label)) / stddev_pop(v) OVER (PARTITION BY label), 6) + 0.0 AS v FROM g",
    use="pixels",
)
def gray_frames(spark, sf):
    s = _stack(spark, sf).withColumn("r", F.floor(F.abs("v") * 255).cast("double")).withColumn("g", F.floor(F.abs("v") * 100).cast("double")).drop("v")
    return _r(G.gray_frames(s, L, "r", "g"), 6, "v")


@query(
    "WITH o AS (SELECT unnest(range(7))::INTEGER AS o), c AS (SELECT o, 1.0::DOUBLE + o * 0.75::DOUBLE AS cx, 1.5::DOUBLE + o * 0.75::DOUBLE AS cy FROM o) "
    "SELECT vec_id, a.o AS x, b.o AS y, round(sum(v * greatest(1 - abs(a.cx - p.x), 0) * greatest(1 - abs(b.cy - p.y), 0)), 8) + 0.0 AS v FROM pixels p, c a, c b WHERE abs(a.cx - p.x) < 1 AND abs(b.cy - p.y) < 1 AND a.o < 7 AND b.o < 7 GROUP BY 1, 2, 3",
    use="pixels",
)
def resample_frames(spark, sf):
    return _r(G.resample_frames(_img(spark, sf), V, (8, 8), (3.5, 4.0), (5.0, 5.0), 0.75), 8, "v")
