"""Queries for trees and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import trees as T
from ..plans.scan import indexed
from ..session import once
from .fixtures import pixels, table
from .joins import CELLS, SEGS, cells, segments
from .registry import query

C = ["cell"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# A tree over the parts: every fourth node branches off at half its number, the others continue a chain.
_NODES = (
    "nd AS (SELECT 0 AS cell, p_partkey AS n, CASE WHEN p_partkey = 0 THEN -1 WHEN p_partkey % 4 = 0 THEN p_partkey // 2 ELSE p_partkey - 1 END AS parent, "
    "(p_partkey % 50)::DOUBLE AS x, (p_partkey // 50)::DOUBLE AS y, (p_partkey % 7)::DOUBLE AS z FROM part)"
)


def _nodes(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit(0).alias("cell"), n.alias("n"), F.when(n == 0, -1).when(n % 4 == 0, F.expr("p_partkey div 2")).otherwise(n - 1).alias("parent"),
        (n % 50).cast("double").alias("x"), F.expr("p_partkey div 50").cast("double").alias("y"), (n % 7).cast("double").alias("z"),
    )


@query(
    "WITH nd AS (SELECT 0 AS cell, p_partkey AS n, CASE WHEN p_partkey = 0 THEN -1 WHEN p_partkey % 4 = 0 THEN p_partkey // 2 ELSE p_partkey - 1 END AS p, p_partkey % 20 AS x, p_partkey // 20 % 7 AS y, p_partkey % 3 AS z FROM part), rp AS (SELECT cell, n, min(n) OVER (PARTITION BY cell, x, y, z) AS r FROM nd), "
    "e AS (SELECT nd.cell, a.r AS ra, b.r AS rb FROM nd JOIN rp a ON a.cell = nd.cell AND a.n = nd.n JOIN rp b ON b.cell = nd.cell AND b.n = nd.p WHERE nd.p >= 0) SELECT DISTINCT cell, least(ra, rb) AS u, greatest(ra, rb) AS v FROM e WHERE ra <> rb"
)
def dedupe_nodes(spark, sf):
    k = F.col("n")
    n = _nodes(spark, sf).select("cell", "n", "parent", (k % 20).alias("x"), F.expr("n div 20 % 7").alias("y"), (k % 3).alias("z"))
    return T.dedupe_nodes(n, C)


@query(f"WITH {_NODES} SELECT a.n, a.parent, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS length FROM nd a JOIN nd b ON a.parent = b.n")
def edge_lengths(spark, sf):
    return _r(T.edge_lengths(_nodes(spark, sf), C), 6, "length").drop("cell")


# Walk up from every node while its parent has one child and a parent itself.
_PATHS = (
    f"{_NODES}, kd AS (SELECT parent AS n, count(*) AS k FROM nd WHERE parent >= 0 GROUP BY 1), inn AS (SELECT nd.n FROM nd JOIN kd USING (n) WHERE k = 1 AND parent >= 0), "
    "wk AS (SELECT n, n AS cur, 0 AS s FROM nd WHERE parent >= 0 UNION ALL SELECT wk.n, nd.parent, s + 1 FROM wk JOIN nd ON nd.n = wk.cur JOIN inn ON inn.n = nd.parent), "
    "hd AS (SELECT n, arg_max(cur, s) AS path_id, max(s) + 1 AS j FROM wk GROUP BY 1), "
    "pp AS (SELECT path_id, j::BIGINT AS j, nd.n, x, y, z FROM (SELECT path_id, j, n FROM hd UNION ALL SELECT n, 0, parent FROM nd WHERE n IN (SELECT path_id FROM hd)) q JOIN nd ON nd.n = q.n), "
    "lst AS (SELECT path_id, arg_max(n, j) AS n, max(j) AS m FROM pp GROUP BY 1), par AS (SELECT f.path_id, l.path_id AS connect_to, f.n AS start FROM (SELECT path_id, n FROM pp WHERE j = 0) f LEFT JOIN lst l ON l.n = f.n), "
    "anc AS (SELECT path_id AS id, connect_to AS anc, 1 AS depth FROM par WHERE connect_to IS NOT NULL UNION ALL SELECT anc.id, par.connect_to, depth + 1 FROM anc JOIN par ON par.path_id = anc.anc WHERE par.connect_to IS NOT NULL)"
)


@query(f"WITH RECURSIVE {_PATHS} SELECT path_id, j, n FROM pp")
def split_paths(spark, sf):
    return T.split_paths(_nodes(spark, sf), C).select("path_id", "j", "n")


def _paths(spark, sf):
    return T.split_paths(_nodes(spark, sf), C)


@query(
    f"WITH RECURSIVE {_PATHS}, d AS (SELECT id, count(*) AS k FROM anc GROUP BY 1) SELECT par.path_id, start, lst.n AS \"end\", (par.path_id % 2)::INTEGER AS reversed, connect_to, coalesce(k, 0)::INTEGER AS level FROM par JOIN lst USING (path_id) LEFT JOIN d ON d.id = par.path_id"
)
def orient_paths(spark, sf):
    p = _paths(spark, sf).groupBy("cell", "path_id").agg(F.min_by("n", "j").alias("s"), F.max_by("n", "j").alias("e"))
    odd = F.col("path_id") % 2 == 1
    p = p.select("cell", "path_id", F.when(odd, F.col("e")).otherwise(F.col("s")).alias("a"), F.when(odd, F.col("s")).otherwise(F.col("e")).alias("b"))
    soma = _nodes(spark, sf).filter("parent < 0").select("cell", "n")
    return T.orient_paths(p, soma, C).drop("cell")


# One step a row: the nearest pair of a cell's tails and loose points, then the tails after it.
_TAIL = "{{'n': {n}, 'x': {x}, 'y': {y}, 'p': {p}, 'part': {part}, 'len': {len}}}"
_GROW = (
    "tr AS (SELECT s_nationkey AS cell, -1 - s_suppkey AS n, s_acctbal AS x, (s_suppkey % 97)::DOUBLE AS y FROM supplier), "
    "lo AS (SELECT c_nationkey AS cell, c_mktsegment AS path_id, row_number() OVER w - 1 AS j, c_custkey AS n, c_acctbal AS x, (c_custkey % 97)::DOUBLE AS y FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)), "
    "en AS (SELECT cell, path_id, max(j) AS last, arg_min({'n': n, 'x': x, 'y': y}, j) AS a, arg_max({'n': n, 'x': x, 'y': y}, j) AS b FROM lo GROUP BY 1, 2), "
    "lp AS (SELECT lo.*, last, a, b FROM lo JOIN en USING (cell, path_id)), "
    f"g0 AS (SELECT cell, list({_TAIL.format(n='n', x='x', y='y', p='n::VARCHAR', part='0', len='1::BIGINT')}) AS tails FROM tr GROUP BY 1), "
    "gr AS (SELECT g0.cell, tails, (SELECT list(path_id) FROM en WHERE en.cell = g0.cell) AS todo, NULL::STRUCT(path_id VARCHAR, tn BIGINT, p VARCHAR, part INTEGER, len BIGINT, j BIGINT, d DOUBLE, n BIGINT, x DOUBLE, y DOUBLE, last BIGINT, a STRUCT(n BIGINT, x DOUBLE, y DOUBLE), b STRUCT(n BIGINT, x DOUBLE, y DOUBLE)) AS h FROM g0 "
    "UNION ALL SELECT cell, list_concat(list_filter(tails, lambda t: t.n <> h.tn), CASE WHEN h.j > 0 AND h.j < h.last THEN ["
    + _TAIL.format(n="CASE WHEN h.d > 0 THEN h.n ELSE h.tn END", x="h.x", y="h.y", p="h.p", part="h.part", len="h.len + (h.d > 0)::BIGINT")
    + ", " + _TAIL.format(n="h.a.n", x="h.a.x", y="h.a.y", p="h.path_id", part="1", len="h.j + 1")
    + ", " + _TAIL.format(n="h.b.n", x="h.b.x", y="h.b.y", p="h.path_id", part="2", len="h.last - h.j + 1") + "] WHEN h.j = 0 THEN ["
    + _TAIL.format(n="CASE WHEN h.last = 0 AND h.d = 0 THEN h.tn ELSE h.b.n END", x="h.b.x", y="h.b.y", p="h.p", part="h.part", len="h.len + h.last + (h.d > 0)::BIGINT") + "] ELSE ["
    + _TAIL.format(n="h.a.n", x="h.a.x", y="h.a.y", p="h.p", part="h.part", len="h.len + h.last + (h.d > 0)::BIGINT")
    + "] END), list_filter(todo, lambda q: q <> h.path_id), h FROM (SELECT cell, tails, todo, arg_min({'path_id': path_id, 'tn': t.n, 'p': t.p, 'part': t.part, 'len': t.len, 'j': j, 'd': d, 'n': n, 'x': x, 'y': y, 'last': last, 'a': a, 'b': b}, {'d': d, 'q': path_id, 't': t.n, 'j': j}) AS h "
    "FROM (SELECT r.cell, r.tails, r.todo, r.t, lp.path_id, lp.j, lp.n, lp.x, lp.y, lp.last, lp.a, lp.b, sqrt((lp.x - r.t.x) * (lp.x - r.t.x) + (lp.y - r.t.y) * (lp.y - r.t.y)) AS d "
    "FROM (SELECT cell, tails, todo, unnest(tails) AS t FROM gr WHERE len(todo) > 0) r JOIN lp ON lp.cell = r.cell AND list_contains(r.todo, lp.path_id)) GROUP BY cell, tails, todo))"
)


def _loose(spark, sf):
    """Suppliers of a nation are the tree; customers of a nation and segment form loose paths."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("cell"), (-1 - F.col("s_suppkey")).alias("n"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))
    l = indexed(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], "j")
    return s, l.select(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("path_id"), "j", F.col("c_custkey").alias("n"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))


@query(
    f"WITH RECURSIVE {_GROW} SELECT cell, h.path_id AS path_id, h.tn AS attach_to, h.p AS to_path, h.part AS to_part, h.len AS at_j, h.j AS by_j, round(h.d, 6) AS dist, h.j > 0 AND h.j < h.last AS split FROM gr WHERE h IS NOT NULL "
    "UNION ALL SELECT cell, path_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM en WHERE cell NOT IN (SELECT cell FROM g0)"
)
def reconnect_paths(spark, sf):
    """Suppliers of a nation are the tree; customers of a nation and segment form loose paths."""
    return _r(T.reconnect_paths(*_loose(spark, sf), C), 6, "dist")


@query(
    f"WITH RECURSIVE {_GROW}, hung AS (SELECT lp.*, h FROM lp JOIN gr ON gr.cell = lp.cell AND gr.h.path_id = lp.path_id), "
    "pts AS (SELECT cell, n::VARCHAR AS path_id, 0 AS part, 0 AS j, n FROM tr "
    "UNION ALL SELECT cell, h.p, h.part, h.len + abs(j - h.j) - 1 + (h.d > 0)::BIGINT, n FROM hung WHERE (h.d > 0 OR j <> h.j) AND (j = h.j OR h.j = 0 OR h.j = h.last) "
    "UNION ALL SELECT cell, path_id, 1, h.j - j, n FROM hung WHERE h.j > 0 AND h.j < h.last AND j <= h.j "
    "UNION ALL SELECT cell, path_id, 2, j - h.j, n FROM hung WHERE h.j > 0 AND h.j < h.last AND j >= h.j) "
    "SELECT p.cell, p.path_id, p.part, p.j, p.n, g.h.p AS connect_to, g.h.part AS connect_part FROM pts p LEFT JOIN gr g ON p.part > 0 AND g.cell = p.cell AND g.h.path_id = p.path_id"
)
def reconnected_points(spark, sf):
    """The path table after reconnection, with what the halves of split paths connect to."""
    tree, loose = _loose(spark, sf)
    attached = once(T.reconnect_paths(tree, loose, C))
    points, links = T.reconnected(tree, loose, attached, C)
    return points.join(links, [*C, "path_id", "part"], "left").select("cell", "path_id", "part", "j", "n", "connect_to", "connect_part")


@query(
    f"WITH RECURSIVE {_NODES}, w AS (SELECT n, [n] AS p FROM nd WHERE parent < 0 UNION ALL SELECT nd.n, list_append(w.p, nd.n) FROM nd JOIN w ON nd.parent = w.n), s AS (SELECT unnest(p) AS n, count(*) AS size FROM w GROUP BY 1), "
    "e AS (SELECT n, row_number() OVER (ORDER BY p) - 1 AS enter FROM w) SELECT n AS id, enter, enter + size - 1 AS exit, size FROM e JOIN s USING (n)"
)
def tree_intervals(spark, sf):
    n = _nodes(spark, sf).select("cell", F.col("n").alias("id"), F.when(F.col("parent") >= 0, F.col("parent")).alias("ptr"))
    return T.tree_intervals(n, C).drop("cell")


@query(
    f"WITH RECURSIVE {_NODES}, a AS (SELECT n AS id, parent AS anc FROM nd WHERE parent >= 0 UNION ALL SELECT a.id, nd.parent FROM a JOIN nd ON nd.n = a.anc WHERE nd.parent >= 0), p AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS anc FROM lineitem) "
    "SELECT id, anc, CASE WHEN id IN (SELECT n FROM nd) AND anc IN (SELECT n FROM nd) THEN (id, anc) IN (SELECT (id, anc) FROM a) END AS is_ancestor FROM p"
)
def mark_ancestors(spark, sf):
    n = _nodes(spark, sf).select("cell", F.col("n").alias("id"), F.when(F.col("parent") >= 0, F.col("parent")).alias("ptr"))
    p = table(spark, sf, "lineitem").select(F.lit(0).alias("cell"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("anc")).distinct()
    return T.mark_ancestors(p, T.tree_intervals(n, C), C).drop("cell")


@query(f"WITH RECURSIVE {_NODES}, anc AS (SELECT n AS id, parent AS anc, 1 AS depth FROM nd WHERE parent >= 0 UNION ALL SELECT anc.id, nd.parent, depth + 1 FROM anc JOIN nd ON nd.n = anc.anc WHERE nd.parent >= 0) SELECT id, anc, depth::BIGINT AS depth FROM anc")
def ancestors(spark, sf):
    n = _nodes(spark, sf).select("cell", F.col("n").alias("id"), F.when(F.col("parent") >= 0, F.col("parent")).alias("ptr"))
    return T.ancestors(n, C).drop("cell")


_LEN = (
    f"{_PATHS}, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS s FROM pp WINDOW w AS (PARTITION BY path_id ORDER BY j)), ln AS (SELECT path_id, sum(s) AS len FROM st GROUP BY 1), "
    "ab AS (SELECT id AS path_id, sum(len) AS above, count(*) AS k FROM anc JOIN ln ON ln.path_id = anc.anc GROUP BY 1), "
    "ds AS (SELECT st.path_id, j, n, x, y, z, coalesce(above, 0) + sum(s) OVER (PARTITION BY st.path_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS dist, coalesce(k, 0) + 1 AS num_paths FROM st LEFT JOIN ab USING (path_id))"
)


@query(
    f"WITH RECURSIVE {_LEN}, en AS (SELECT path_id, arg_min(x, j) AS x0, arg_min(y, j) AS y0, arg_min(z, j) AS z0, arg_max(x, j) AS x1, arg_max(y, j) AS y1, arg_max(z, j) AS z1 FROM pp GROUP BY 1) "
    "SELECT ln.path_id, round(len, 6) AS real_length, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)), 6) AS euclidean_length, coalesce(k, 0) AS branch_order FROM ln JOIN en USING (path_id) LEFT JOIN ab USING (path_id)"
)
def path_lengths(spark, sf):
    p = _paths(spark, sf)
    return _r(T.path_lengths(p, C, T.path_parents(p, C)), 6, "real_length", "euclidean_length").drop("cell")


@query(f"WITH RECURSIVE {_LEN} SELECT path_id, j, round(dist, 5) AS dist, num_paths FROM ds")
def distance_to_root(spark, sf):
    p = _paths(spark, sf)
    return _r(T.distance_to_root(p, T.path_parents(p, C), C), 5, "dist").drop("cell")


@query(
    f"WITH RECURSIVE {_LEN}, fr AS (SELECT max(dist) AS far FROM ds), f AS (SELECT n, arg_min(path_id, (path_id, j)) AS path_id, arg_min(j, (path_id, j)) AS j FROM pp GROUP BY 1) "
    "SELECT f.n AS roi_id, f.path_id, f.j AS loc_on_path, round(dist, 5) AS d_dist, round(dist / far, 6) AS norm_d_dist, round(sqrt(x * x + y * y + z * z), 6) AS ec_dist, num_paths AS num_branches FROM f JOIN ds ON ds.path_id = f.path_id AND ds.j = f.j, fr"
)
def point_metrics(spark, sf):
    p, n = _paths(spark, sf), _nodes(spark, sf)
    rois = n.select("cell", F.col("n").alias("roi_id"), "x", "y", "z")
    soma = n.filter("parent < 0").select("cell", "x", "y", "z")
    out = T.point_metrics(rois, p, T.path_parents(p, C), soma, C)
    return _r(_r(out, 5, "d_dist"), 6, "norm_d_dist", "ec_dist").drop("cell", "x", "y", "z")


@query(
    "SELECT c_nationkey AS cell, arg_min(c_custkey, (t <> 1, c_custkey)) AS n, arg_min(c_acctbal, (t <> 1, c_custkey)) AS x, arg_min(t, (t <> 1, c_custkey)) AS type FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 3 ELSE 3 END AS t FROM customer) GROUP BY 1"
)
def soma_position(spark, sf):
    t = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000), 1).when(F.col("c_mktsegment") != "MACHINERY", 3)
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("cell"), F.col("c_custkey").alias("n"), t.alias("type"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return T.soma_position(c, C).drop("y", "z")


def _cloud(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("cell"), ((F.col("c_acctbal") - 4500) / 50).alias("x"), (k * 31 % 200 - 100).cast("double").alias("y"))


_CLOUD = "cl AS (SELECT c_nationkey AS cell, (c_acctbal - 4500) / 50 AS x, (c_custkey * 31 % 200 - 100)::DOUBLE AS y FROM customer)"


@query(
    # A pair of points is a hull edge if no point lies to its right; ends only, no points in between.
    f"WITH {_CLOUD}, u AS (SELECT DISTINCT * FROM cl), e AS (SELECT a.cell, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM u a JOIN u b ON a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.cell = a.cell AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)), "
    "h AS (SELECT cell, count(*) AS n_corners, sum(ax * by_ - ay * bx) / 2 AS hull_area FROM e GROUP BY 1) SELECT cell, n_corners::INTEGER AS n_corners, round(hull_area, 4) AS hull_area, round(2 * sqrt(hull_area / pi()), 6) AS hull_dia FROM h"
)
def hull_area(spark, sf):
    return _r(_r(T.hull_area(_cloud(spark, sf), C), 4, "hull_area"), 6, "hull_dia")


_KDE = (
    f"{_CLOUD}, sg AS (SELECT cell, count(*) AS n, var_samp(x) * pow(count(*), -1 / 3.0::DOUBLE) AS a, covar_samp(x, y) * pow(count(*), -1 / 3.0::DOUBLE) AS b, var_samp(y) * pow(count(*), -1 / 3.0::DOUBLE) AS c FROM cl GROUP BY 1), "
    "g AS (SELECT gx, gy, gx * 240.0::DOUBLE / 19 - 120 AS px, gy * 240.0::DOUBLE / 19 - 120 AS py FROM range(20) q(gx), range(20) r(gy)), "
    "ds AS (SELECT cl.cell, gx, gy, sum(exp(-0.5::DOUBLE * (c * (px - x) * (px - x) - 2 * b * (px - x) * (py - y) + a * (py - y) * (py - y)) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b) * n)) AS density FROM cl JOIN sg USING (cell), g GROUP BY 1, 2, 3)"
)


@query(f"WITH {_KDE} SELECT cell, gx, gy, round(density, 10) AS density FROM ds")
def density_map(spark, sf):
    return _r(T.density_map(_cloud(spark, sf), C, 120.0, 20), 10, "density")


@query(
    f"WITH {_KDE}, m AS (SELECT cell, sum(gx * density) / sum(density) AS mx, sum(gy * density) / sum(density) AS my FROM ds GROUP BY 1), w AS (SELECT *, mx * 240 / 20 - 120 AS cx, my * 240 / 20 - 120 AS cy FROM m) "
    "SELECT cell, round(mx, 6) AS mx, round(my, 6) AS my, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(sqrt(cx * cx + cy * cy), 6) AS asymmetry FROM w"
)
def density_center(spark, sf):
    d = T.density_map(_cloud(spark, sf), C, 120.0, 20)
    return _r(T.density_center(d, C, 120.0, 20), 6, "mx", "my", "cx", "cy", "asymmetry")


@query(f"WITH {_CLOUD} SELECT cell, (ceil(greatest(max(abs(x)), max(abs(y))) / 20) * 20)::DOUBLE AS lim FROM cl GROUP BY 1")
def path_limits(spark, sf):
    return T.path_limits(_cloud(spark, sf), C)


@query(
    f"WITH {_CLOUD}, lm AS (SELECT cell, (ceil(greatest(max(abs(x)), max(abs(y))) / 20) * 20)::DOUBLE AS lim FROM cl GROUP BY 1), "
    "st AS (SELECT cell, count(*) AS n, var_samp(x) * pow(count(*), -1 / 3.0::DOUBLE) AS a, covar_samp(x, y) * pow(count(*), -1 / 3.0::DOUBLE) AS b, var_samp(y) * pow(count(*), -1 / 3.0::DOUBLE) AS c FROM cl GROUP BY 1), "
    "g AS (SELECT cell, lim, i AS gx, j AS gy, 2 * lim / 19 * i - lim AS wx, 2 * lim / 19 * j - lim AS wy FROM lm, range(20) p(i), range(20) q(j)), "
    "ds AS (SELECT g.cell, lim, gx, gy, sum(exp(-0.5::DOUBLE * (c * (wx - x) * (wx - x) - 2 * b * (wx - x) * (wy - y) + a * (wy - y) * (wy - y)) / (a * c - b * b))) / (2 * pi() * sqrt(any_value(a * c - b * b)) * any_value(n)) AS density FROM g JOIN st USING (cell) JOIN cl USING (cell) GROUP BY 1, 2, 3, 4), "
    "m AS (SELECT cell, any_value(lim) AS lim, sum(gx * density) / sum(density) AS mx, sum(gy * density) / sum(density) AS my FROM ds GROUP BY 1) "
    "SELECT cell, round(mx, 6) AS mx, round(my, 6) AS my, round(mx * 2 * lim / 20 - lim, 6) + 0.0 AS cx, round(my * 2 * lim / 20 - lim, 6) + 0.0 AS cy, round(sqrt(pow(mx * 2 * lim / 20 - lim, 2) + pow(my * 2 * lim / 20 - lim, 2)), 6) AS asymmetry FROM m"
)
def density_center_own_extent(spark, sf):
    """Density maps whose extent is that of every cell's own points, and their centres."""
    p = _cloud(spark, sf)
    lim = once(T.path_limits(p, C))
    return _r(T.density_center(T.density_map(p, C, lim, 20), C, lim, 20), 6, "mx", "my", "cx", "cy", "asymmetry")


@query(
    f"WITH {_CLOUD}, u AS (SELECT DISTINCT * FROM cl), e AS (SELECT a.cell, a.x AS ax, a.y AS ay FROM u a JOIN u b ON a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.cell = a.cell AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)), "
    "ct AS (SELECT cell, avg(x) AS cx, avg(y) AS cy FROM cl GROUP BY 1), r AS (SELECT e.cell, sqrt(pow(ax - cx, 2) + pow(ay - cy, 2)) AS r, row_number() OVER (PARTITION BY e.cell ORDER BY ax, ay) AS k FROM e JOIN ct USING (cell)) "
    "SELECT cell, round(sum(r * CASE WHEN k = 1 THEN 2 ELSE 1 END) / (count(*) + 1), 6) AS radius FROM r GROUP BY 1"
)
def mean_radius(spark, sf):
    p = _cloud(spark, sf)
    c = p.groupBy("cell").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return _r(T.mean_radius(T.hull_points(p, C), c, C), 6, "radius")


@query(
    "WITH e AS (SELECT o_orderpriority AS grp, o_custkey AS cell, o_totalprice AS length, (o_orderkey % 100)::DOUBLE AS zm FROM orders), b AS (SELECT grp, cell, least(floor((zm - 10) / 8.0::DOUBLE), 9)::BIGINT AS bin, length FROM e WHERE zm BETWEEN 10 AND 90), "
    "p AS (SELECT grp, bin, sum(length) AS l, sum(sum(length)) OVER (PARTITION BY grp, cell) AS t FROM b GROUP BY grp, cell, bin), n AS (SELECT grp, count(DISTINCT cell) AS n FROM e GROUP BY 1) SELECT grp, bin, round(sum(l / t) / any_value(n), 8) AS density FROM p JOIN n USING (grp) GROUP BY 1, 2"
)
def depth_profile(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("cell"), F.col("o_totalprice").alias("length"), (F.col("o_orderkey") % 100).cast("double").alias("zm"))
    return _r(T.depth_profile(o, C, "grp", 10, 10.0, 90.0), 8, "density")


@query(
    f"WITH {SEGS}, {CELLS}, n AS (SELECT cos(radians(a)) AS nx, sin(radians(a)) AS ny FROM (VALUES (30), (90), (150)) t(a)), "
    "k AS (SELECT sid, cell, x0, y0, x1, y1, nx * (x0 - cx) + ny * (y0 - cy) AS a, nx * (x1 - x0) + ny * (y1 - y0) AS v FROM sg, ce, n), "
    "t AS (SELECT sid, cell, any_value(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS l, greatest(0, max(CASE WHEN abs(v) < 1e-12 THEN CASE WHEN abs(a) > 2.5 THEN 2 ELSE 0 END ELSE least((-2.5 - a) / v, (2.5 - a) / v) END)) AS t0, "
    "least(1, min(CASE WHEN abs(v) < 1e-12 THEN 1 ELSE greatest((-2.5 - a) / v, (2.5 - a) / v) END)) AS t1 FROM k GROUP BY 1, 2) SELECT cell, round(sum((t1 - t0) * l), 6) AS length FROM t WHERE t1 > t0 AND l > 0 GROUP BY 1"
)
def length_per_cell(spark, sf):
    cand = J.box_candidates(segments(spark, sf), cells(spark, sf), 8.0)
    return _r(T.length_per_cell(cand, 2.5, C), 6, "length")


_FIT = (
    "{s} AS (SELECT label, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg(z) AS c0, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, covar_pop(x, y) AS xy FROM {t} GROUP BY 1), "
    "{f} AS (SELECT *, (xz / sx - xy / (sx * sy) * yz / sy) / (1 - pow(xy / (sx * sy), 2)) AS c1, (yz / sy - xy / (sx * sy) * xz / sx) / (1 - pow(xy / (sx * sy), 2)) AS c2 FROM {s})"
)
_PTS = "pa AS (SELECT label, x, y, v * 10 + x + 0.5::DOUBLE * y AS z FROM pixels), pb AS (SELECT label, x, y, v * 5 + 12 - 0.25::DOUBLE * x AS z FROM pixels)"


def _surf(spark, sf):
    p = pixels(spark, sf)
    a = p.select("label", "x", "y", (F.col("v") * 10 + F.col("x") + 0.5 * F.col("y")).alias("z"))
    return a, p.select("label", "x", "y", (F.col("v") * 5 + 12 - 0.25 * F.col("x")).alias("z"))


@query(f"WITH {_PTS}, {_FIT.format(s='sa', f='fa', t='pa')} SELECT label, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM fa", use="pixels")
def fit_surface(spark, sf):
    s = T.fit_surface(_surf(spark, sf)[0], ["label"], "linear")
    return s.select("label", *[F.round(F.col("coef")[i], 6).alias(f"c{i}") for i in range(3)])


@query()
def fit_surface_quadratic(spark, sf):
    s = T.fit_surface(_surf(spark, sf)[0], ["label"], "quadratic")
    return s.select("label", *[F.round(F.col("coef")[i], 6).alias(f"c{i}") for i in range(6)])


@query(
    f"WITH {_PTS}, {_FIT.format(s='sa', f='fa', t='pa')} SELECT label, i * 0.5::DOUBLE AS x, j * 0.5::DOUBLE AS y, round(c0 + c1 * (i * 0.5::DOUBLE - mx) / sx + c2 * (j * 0.5::DOUBLE - my) / sy, 6) AS z FROM fa, range(15) q(i), range(9) r(j)",
    use="pixels",
)
def surface_grid(spark, sf):
    a, _ = _surf(spark, sf)
    b = a.groupBy("label").agg(F.min("x").cast("double").alias("x0"), F.max("x").cast("double").alias("x1"), F.min("y").cast("double").alias("y0"), F.lit(4.0).alias("y1"))
    return _r(T.surface_grid(T.fit_surface(a, ["label"], "linear"), b, ["label"], 0.5), 6, "z")


@query(
    f"WITH {_PTS}, {_FIT.format(s='sa', f='fa', t='pa')}, {_FIT.format(s='sb', f='fb', t='pb')}, sh AS (SELECT DISTINCT label, x, y FROM pixels), "
    "gp AS (SELECT sh.label, median(b.c0 + b.c1 * (x - b.mx) / b.sx + b.c2 * (y - b.my) / b.sy - a.c0 - a.c1 * (x - a.mx) / a.sx - a.c2 * (y - a.my) / a.sy) AS m FROM sh JOIN fa a USING (label) JOIN fb b USING (label) GROUP BY 1) "
    "SELECT vec_id, x, y, round((abs(v) * 20 - c0 - c1 * (x - mx) / sx - c2 * (y - my) / sy) / m, 5) + 0.0 AS z_flat FROM pixels JOIN fa USING (label) JOIN gp USING (label)",
    use="pixels",
)
def flatten_depth(spark, sf):
    a, b = _surf(spark, sf)
    p = pixels(spark, sf).select("label", "vec_id", "x", "y", (F.abs("v") * 20).alias("z"))
    sh = p.select("label", "x", "y").distinct()
    out = T.flatten_depth(p, T.fit_surface(a, ["label"], "linear"), T.fit_surface(b, ["label"], "linear"), sh, ["label"])
    return _r(out, 5, "z_flat").select("vec_id", "x", "y", "z_flat")


@query(
    "WITH va AS (SELECT label, x, y, arg_max(vec_id % 50, (v, -(vec_id % 50)))::DOUBLE AS za FROM pixels GROUP BY 1, 2, 3), vb AS (SELECT label, x, y, arg_max(vec_id * 7 % 40, (-v, -(vec_id * 7 % 40)))::DOUBLE AS zb FROM pixels GROUP BY 1, 2, 3), "
    f"df AS (SELECT label, x, y, zb - za AS z FROM va JOIN vb USING (label, x, y)), {_FIT.format(s='sd', f='fd', t='df')} SELECT vec_id, x, y, round(v * 10 + c0 + c1 * (x - mx) / sx + c2 * (y - my) / sy, 5) + 0.0 AS z_new FROM pixels JOIN fd USING (label)",
    use="pixels",
)
def apply_depth_correction(spark, sf):
    p, k = pixels(spark, sf), F.col("vec_id")
    a = p.select("label", "x", "y", (k % 50).alias("z"), "v")
    b = p.select("label", "x", "y", (k * 7 % 40).alias("z"), (-F.col("v")).alias("v"))
    pts = p.select("label", "vec_id", "x", "y", (F.col("v") * 10).alias("z"))
    return _r(T.apply_depth_correction(pts, a, b, ["label"]), 5, "z_new").select("vec_id", "x", "y", "z_new")
