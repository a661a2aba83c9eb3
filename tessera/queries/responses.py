"""Queries for response features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as R
from ..operators import series as T
from .fixtures import samples, table, triggers, vectors
from .registry import query
from .stats import SNIPS, snips

U = ["user_id"]
V = ["vec_id"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def _avg(spark, sf):
    """Vectors as averages of 64 samples."""
    return vectors(spark, sf).select("vec_id", "j", F.col("v").alias("y"))


def _rep_vectors(spark, sf):
    """Vectors of a label as repetitions of one recording."""
    return vectors(spark, sf).select("label", F.col("vec_id").alias("rep"), "j", F.col("j").cast("double").alias("t"), F.col("v").alias("y"))


_W = (
    "wm AS (SELECT g.user_id, g.k, avg(s.y) AS r FROM (SELECT g.*, (SELECT arg_min(s.i, (abs(s.t - g.t - 10000), s.i)) FROM samples s WHERE s.user_id = g.user_id) AS a, "
    "(SELECT arg_min(s.i, (abs(s.t - g.t - 200000), s.i)) FROM samples s WHERE s.user_id = g.user_id) AS b FROM triggers g) g JOIN samples s ON s.user_id = g.user_id AND s.i >= a AND s.i < b GROUP BY 1, 2)"
)


def _wm(spark, sf):
    a = samples(spark, sf).withColumnRenamed("i", "j")
    return R.window_mean(a, triggers(spark, sf), U, 10000.0, 200000.0)


@query(f"WITH {_W} SELECT user_id, k, round(r, 6) AS r FROM wm", use="samples triggers")
def window_mean(spark, sf):
    return _r(_wm(spark, sf), 6, "r")


@query(
    f"WITH {_W}, s AS (SELECT user_id, max(r) FILTER (WHERE k = 0) AS small, max(r) FILTER (WHERE k = 1) AS large, max(r) FILTER (WHERE k > 1) AS o FROM wm GROUP BY 1) "
    "SELECT user_id, round(small, 6) AS small, round(large, 6) AS large, round(large - small, 6) + 0.0 AS surround_index, round(o - small, 6) + 0.0 AS offset_index FROM s",
    use="samples triggers",
)
def spot_indices(spark, sf):
    return _r(R.spot_indices(_wm(spark, sf), U), 6, "small", "large", "surround_index", "offset_index")


_SPOT = (
    "sp AS (SELECT label, vec_id, j // 10 AS spot, avg(v) FILTER (WHERE j % 10 >= 4) - median(v) FILTER (WHERE j % 10 < 4) AS r FROM vectors WHERE j < 60 GROUP BY 1, 2, 3)"
)


@query(f"WITH {_SPOT} SELECT label, vec_id AS rep, spot::BIGINT AS spot, round(r, 8) + 0.0 AS r FROM sp", use="vectors")
def spot_responses(spark, sf):
    return _r(R.spot_responses(_rep_vectors(spark, sf), ["label"], 4, 10, 6), 8, "r")


@query(
    f"WITH {_SPOT}, m AS (SELECT label, median(r) FILTER (WHERE spot = 0) AS l, median(r) FILTER (WHERE spot = 1) AS g FROM sp GROUP BY 1) "
    "SELECT label, round(l, 8) + 0.0 AS l_mu, round(g, 8) + 0.0 AS g_mu, round(g - greatest(l, 0), 8) + 0.0 AS surround_index FROM m",
    use="vectors",
)
def spot_surround(spark, sf):
    return _r(R.spot_surround(_rep_vectors(spark, sf), ["label"], 4, 10, 6), 8, "l_mu", "g_mu", "surround_index")


@query(
    "WITH sp AS (SELECT label, vec_id % 2 AS kind, vec_id, avg(v) FILTER (WHERE j >= 10) - median(v) FILTER (WHERE j < 10) AS r FROM vectors WHERE j < 25 GROUP BY 1, 2, 3), "
    "m AS (SELECT label, median(r) FILTER (WHERE kind = 0) AS l, median(r) FILTER (WHERE kind = 1) AS g FROM sp GROUP BY 1) "
    "SELECT label, round(l, 8) + 0.0 AS l_mu, round(g, 8) + 0.0 AS g_mu, round(g - greatest(l, 0), 8) + 0.0 AS surround_index FROM m WHERE l IS NOT NULL AND g IS NOT NULL",
    use="vectors",
)
def step_surround(spark, sf):
    v = _rep_vectors(spark, sf)
    out = R.step_surround(v.filter("rep % 2 = 0"), v.filter("rep % 2 = 1"), ["label"], 10, 25)
    return _r(out, 8, "l_mu", "g_mu", "surround_index")


@query(
    "WITH a AS (SELECT vec_id, greatest(avg(v) FILTER (WHERE j >= 4 AND j < 8), 0) AS a, greatest(avg(v) FILTER (WHERE j >= 10 AND j < 14), 0) AS b FROM vectors GROUP BY 1) "
    "SELECT vec_id, round(CASE WHEN a + b < 1e-9 THEN 0.5 ELSE (a - b) / (a + b) END, 6) + 0.0 AS polarity_index FROM a",
    use="vectors",
)
def polarity_index(spark, sf):
    return _r(R.polarity_index(_avg(spark, sf), V, 2.0), 6, "polarity_index")


_PEAK = (
    "{n} AS (SELECT s.vec_id, CASE WHEN any_value(py - base) <= 1e-9 THEN -1 ELSE least(greatest(avg(v - base) FILTER (WHERE abs(j - p - {d}) <= {h}), 0) / any_value(py - base), 1) END AS r FROM {t} s JOIN "
    "(SELECT vec_id, avg(v) FILTER (WHERE j < {a}) AS base, arg_max(j, (v, -j)) FILTER (WHERE j >= {a} AND j < {b}) AS p, max(v) FILTER (WHERE j >= {a} AND j < {b}) AS py FROM {t} GROUP BY 1) q USING (vec_id) GROUP BY 1)"
)


@query(f"WITH {_PEAK.format(n='pr', t='vectors', a=20, b=60, d=2, h=1)} SELECT vec_id, round(r, 6) + 0.0 AS peak_ratio FROM pr", use="vectors")
def peak_ratio(spark, sf):
    return _r(R.peak_ratio(_avg(spark, sf), V, 10.0, 0.21, 0.15, 2.0, 6.0), 6, "peak_ratio")


_TONIC = "{n} AS (SELECT vec_id, sum(greatest(m - v, 0)) / nullif(sum(abs(v - m)), 0) AS r FROM {t} JOIN (SELECT vec_id, median(v) AS m FROM {t} WHERE j >= {a} AND j < {b} GROUP BY 1) USING (vec_id) WHERE j >= {b} AND j < {c} GROUP BY 1)"


@query(f"WITH {_TONIC.format(n='tn', t='vectors', a=18, b=20, c=58)} SELECT vec_id, round(r, 6) AS tonic_index FROM tn", use="vectors")
def tonic_index(spark, sf):
    return _r(R.tonic_index(_avg(spark, sf), V, 2.0), 6, "tonic_index")


_BAND = "{n} AS (SELECT vec_id, max(v) FILTER (WHERE j >= 20 AND j < 24) AS low, max(v) FILTER (WHERE j >= 30 AND j < 34) AS high FROM {t} GROUP BY 1)"


@query(
    f"WITH {_BAND.format(n='bn', t='vectors')} SELECT vec_id, round(low, 8) + 0.0 AS low, round(high, 8) + 0.0 AS high, round(CASE WHEN low < 1e-9 THEN -1 ELSE high / low END, 6) + 0.0 AS lh_index FROM bn",
    use="vectors",
)
def band_ratio(spark, sf):
    return _r(_r(R.band_ratio(_avg(spark, sf), V, 2.0), 8, "low", "high"), 6, "lh_index")


_POWER = (
    "fq AS (SELECT k, (k * 10.0::DOUBLE / 60 >= 2)::INTEGER AS b FROM (SELECT unnest(range(31)) AS k) WHERE k * 10.0::DOUBLE / 60 BETWEEN 0.5 AND 1 OR k * 10.0::DOUBLE / 60 BETWEEN 2 AND 16), "
    "pw AS (SELECT {g} AS g, vec_id, k, b, pow(sum(v * cos(2 * pi() * k * j / 60)), 2) + pow(sum(v * sin(2 * pi() * k * j / 60)), 2) AS p FROM vectors, fq WHERE j < 60 GROUP BY 1, 2, 3, 4), "
    "bp AS (SELECT g, log10(1e4::DOUBLE * avg(p) FILTER (WHERE b = 1) / avg(p) FILTER (WHERE b = 0)) AS r FROM pw GROUP BY 1)"
)


@query(f"WITH {_POWER.format(g='label')} SELECT g AS label, round(r, 6) AS band_power_index FROM bp", use="vectors")
def band_power_index(spark, sf):
    return _r(R.band_power_index(_rep_vectors(spark, sf), ["label"], 10.0), 6, "band_power_index")


@query(
    "WITH sc AS (SELECT vec_id, j, v / max(abs(v)) OVER (PARTITION BY vec_id) AS v FROM vectors), "
    "nm AS (SELECT sc.vec_id, j, v - m AS v FROM sc JOIN (SELECT vec_id, median(v) AS m FROM sc WHERE j < 4 GROUP BY 1) USING (vec_id)), "
    "po AS (SELECT vec_id, greatest(avg(v) FILTER (WHERE j >= 4 AND j < 8), 0) AS a, greatest(avg(v) FILTER (WHERE j >= 10 AND j < 14), 0) AS b FROM nm GROUP BY 1), "
    f"{_PEAK.format(n='tr', t='nm', a=4, b=12, d=0, h=0)}, {_PEAK.format(n='pl', t='nm', a=4, b=12, d=4, h=0)}, {_TONIC.format(n='tn', t='nm', a=18, b=20, c=58)}, {_BAND.format(n='bn', t='nm')}, {_POWER.format(g='vec_id')} "
    "SELECT po.vec_id, round(CASE WHEN a + b < 1e-9 THEN 0.5 ELSE (a - b) / (a + b) END, 6) + 0.0 AS polarity_index, round(tr.r, 6) + 0.0 AS transience_index, round(pl.r, 6) + 0.0 AS plateau_index, round(tn.r, 6) + 0.0 AS tonic_index, "
    "round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(CASE WHEN low < 1e-9 THEN -1 ELSE high / low END, 6) + 0.0 AS lh_index, round(bp.r, 6) + 0.0 AS band_power_index "
    "FROM po JOIN tr ON tr.vec_id = po.vec_id JOIN pl ON pl.vec_id = po.vec_id JOIN tn ON tn.vec_id = po.vec_id JOIN bn ON bn.vec_id = po.vec_id JOIN bp ON bp.g = po.vec_id",
    use="vectors",
)
def chirp_features(spark, sf):
    a = _avg(spark, sf)
    s = a.select("vec_id", F.lit(0).alias("rep"), "j", "y")
    out = R.chirp_features(a, s, V, 2.0, 10.0)
    return _r(out, 6, *[c for c in out.columns if c != "vec_id"])


@query(
    "WITH z AS (SELECT label, vec_id, j, v - min(v) OVER (PARTITION BY vec_id) AS y FROM vectors), b AS (SELECT vec_id, median(y) FILTER (WHERE j < 12) AS bu, median(y) FILTER (WHERE j >= 20 AND j < 30) AS bd FROM z GROUP BY 1), "
    "m AS (SELECT label, avg(greatest(y - bu, 0)) FILTER (WHERE j >= 16 AND j < 22) AS a, avg(greatest(y - bd, 0)) FILTER (WHERE j >= 34 AND j < 40) AS o FROM z JOIN b USING (vec_id) GROUP BY 1) "
    "SELECT label, round(CASE WHEN a + o < 1e-10 THEN 0 ELSE (a - o) / (a + o) END, 6) + 0.0 AS on_off_index FROM m",
    use="vectors",
)
def on_off_index(spark, sf):
    s = _rep_vectors(spark, sf)
    starts = s.select("label", "rep").distinct().withColumn("t0", F.lit(0.0))
    return _r(R.on_off_index(s, starts, ["label"], 10, 12.0, 30.0, 4), 6, "on_off_index")


@query(
    # The grid halves the step; points in between are the means of their neighbours.
    "WITH g AS (SELECT label, vec_id, j * 2 AS i, v FROM vectors UNION ALL SELECT a.label, a.vec_id, a.j * 2 + 1, (a.v + b.v) / 2 FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id AND b.j = a.j + 1), "
    "z AS (SELECT label, vec_id, i, v - min(v) OVER (PARTITION BY vec_id) AS y FROM g), p AS (SELECT label, vec_id, arg_max(i, (y, -i)) AS p, max(y) AS py FROM z WHERE i < 96 GROUP BY 1, 2) "
    "SELECT p.label, round(avg(1 - y / nullif(py, 0)), 6) + 0.0 AS transience_index FROM p JOIN z ON z.vec_id = p.vec_id AND z.i = p.p + 5 GROUP BY 1",
    use="vectors",
)
def rep_transience(spark, sf):
    s = _rep_vectors(spark, sf)
    starts = s.select("label", "rep").distinct().withColumn("t0", F.lit(0.0))
    return _r(R.rep_transience(s, starts, ["label"], 0.5, 48.0, 2.5), 6, "transience_index")


def _spots(spark, sf):
    k = F.col("vec_id")
    v = vectors(spark, sf).withColumn("colour", F.when(k % 2 == 0, "W").otherwise("B"))
    v = v.withColumn("size", F.element_at(F.array(F.lit(100), F.lit(300), F.lit(400)), (F.expr("vec_id div 2") % 3 + 1).cast("int")))
    reps = R.tuning_curve_index(v.select("label", "colour", "size", "vec_id").distinct(), ["label", "colour", "size"], ["vec_id"])
    return v.join(reps.select("vec_id", "rep"), "vec_id").select("label", "colour", "size", "rep", "j", (F.col("v") * 20).alias("y"))


@query(
    "WITH s AS (SELECT label, vec_id, CASE vec_id % 2 WHEN 0 THEN 'W' ELSE 'B' END AS colour, [100, 300, 400][(vec_id // 2 % 3 + 1)::INTEGER]::INTEGER AS size, j, v * 20 AS y FROM vectors), "
    "r AS (SELECT label, vec_id, colour, size, row_number() OVER (PARTITION BY label, colour, size ORDER BY vec_id) - 1 AS rep FROM (SELECT DISTINCT label, vec_id, colour, size FROM s)), "
    "z AS (SELECT s.label, s.colour, s.size, rep, j, y - median(y) FILTER (WHERE j < 8) OVER (PARTITION BY s.vec_id) AS y FROM s JOIN r ON r.vec_id = s.vec_id), "
    "p AS (SELECT label, colour, size, rep, avg(y) AS p FROM z WHERE j >= 8 AND j < 24 GROUP BY 1, 2, 3, 4), n AS (SELECT *, p / greatest(max(p) OVER (PARTITION BY label, rep), 1) AS q FROM p), "
    "c AS (SELECT label, colour, size, avg(q) AS t, count(*) AS n FROM n GROUP BY 1, 2, 3), d AS (SELECT label, colour, arg_max(size, (t, -size)) AS pref_size, greatest(arg_max(t, size) / nullif(max(t), 0), 0) - 1 AS si, max(n) AS n_reps FROM c GROUP BY 1, 2), "
    "qa AS (SELECT label, colour, var_pop(m) AS a FROM (SELECT label, colour, j, avg(y) AS m FROM z WHERE size IN (300, 400) GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "qb AS (SELECT label, colour, avg(v) AS b FROM (SELECT label, colour, size, rep, var_pop(y) AS v FROM z WHERE size IN (300, 400) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) "
    "SELECT label, colour, pref_size, round(si, 5) + 0.0 AS surround_index, n_reps, round(a / nullif(b, 0), 6) AS qidx FROM d LEFT JOIN qa USING (label, colour) LEFT JOIN qb USING (label, colour)",
    use="vectors",
)
def size_tuning(spark, sf):
    return _r(_r(R.size_tuning(_spots(spark, sf), ["label"], 8, (8, 24), [300, 400]), 5, "surround_index"), 6, "qidx")


@query(
    "WITH s AS (SELECT label, vec_id, CASE vec_id % 2 WHEN 0 THEN 'W' ELSE 'B' END AS colour, [100, 300, 400][(vec_id // 2 % 3 + 1)::INTEGER]::INTEGER AS size, j, v * 20 AS y FROM vectors), "
    "r AS (SELECT label, vec_id, colour, size, row_number() OVER (PARTITION BY label, colour, size ORDER BY vec_id) - 1 AS rep FROM (SELECT DISTINCT label, vec_id, colour, size FROM s)), "
    "z AS (SELECT s.label, s.colour, s.size, rep, j, y - median(y) FILTER (WHERE j < 8) OVER (PARTITION BY s.vec_id) AS y FROM s JOIN r ON r.vec_id = s.vec_id), "
    "p AS (SELECT label, colour, size, rep, avg(y) AS p FROM z WHERE j >= 8 AND j < 24 GROUP BY 1, 2, 3, 4), n AS (SELECT *, p / greatest(max(p) OVER (PARTITION BY label, rep), 1) AS q FROM p), "
    "c AS (SELECT label, colour, size, avg(q) AS t, count(*) AS n FROM n GROUP BY 1, 2, 3), d AS (SELECT label, colour, arg_max(size, (t, -size)) AS pref_size, greatest(arg_max(t, size) / nullif(max(t), 0), 0) - 1 AS si, max(n) AS n_reps FROM c GROUP BY 1, 2), "
    "qa AS (SELECT label, colour, var_pop(m) AS a FROM (SELECT label, colour, j, avg(y) AS m FROM z WHERE size IN (300, 400) GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "qb AS (SELECT label, colour, avg(v) AS b FROM (SELECT label, colour, size, rep, var_pop(y) AS v FROM z WHERE size IN (300, 400) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) "
    "SELECT label, CASE WHEN max(t) FILTER (colour = 'W') > max(t) FILTER (colour = 'B') OR count(*) FILTER (colour = 'B') = 0 THEN 'W' ELSE 'B' END AS pref_colour FROM c GROUP BY 1",
    use="vectors",
)
def size_tuning_colour(spark, sf):
    """Colour with the higher peak of its tuning curve."""
    return R.preferred_colour(R.size_tuning(_spots(spark, sf), ["label"], 8, (8, 24), [300, 400], curves=True), ["label"], ("W", "B"))