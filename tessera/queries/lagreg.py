"""Queries for lagged regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lagreg as R
from .fixtures import pixels, samples, table, typed_samples, vectors
from .registry import query

U = ["user_id"]
V = ["vec_id"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


_STIM = "st AS (SELECT user_id, i, px, CASE WHEN event_type = px THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS x FROM typed_samples, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) p(px))"


def stimulus(spark, sf):
    """One-hot event types as -1/+1 pixels."""
    s = typed_samples(spark, sf).withColumn("px", F.explode(F.array(*[F.lit(t) for t in TYPES])))
    return s.select("user_id", "i", "px", F.when(F.col("event_type") == F.col("px"), 1.0).otherwise(-1.0).alias("x"))


def _resp(spark, sf):
    # Roots, so that no mean falls exactly between two rounded values.
    return samples(spark, sf).select("user_id", "i", F.sqrt("y").alias("y"))


_LAGS = "lg AS (SELECT unnest(range(4))::INTEGER AS lag), rs AS (SELECT user_id, i, sqrt(y) AS y FROM samples)"
_STA = (
    f"{_STIM}, {_LAGS}, nn AS (SELECT user_id, count(*)::DOUBLE AS n, sum(y) AS sy FROM rs GROUP BY 1), "
    "sta AS (SELECT user_id, lag, px, coalesce(sum(s.y * st.x), 0) AS s FROM (SELECT DISTINCT user_id, px FROM st) k JOIN lg ON true LEFT JOIN rs s USING (user_id) LEFT JOIN st USING (user_id, px) WHERE st.i = s.i + lag - 4 + 1 + 1 GROUP BY 1, 2, 3)"
)


@query(f"WITH {_STA} SELECT user_id, lag, px, round(s / n, 6) + 0.0 AS w FROM sta JOIN nn USING (user_id)", use="samples typed_samples")
def spike_triggered_average(spark, sf):
    return _r(R.spike_triggered_average(_resp(spark, sf), stimulus(spark, sf), U, 4, -1), 6, "w")


@query(f"WITH {_STA} SELECT user_id, lag, px, round(s / sy, 6) + 0.0 AS w FROM sta JOIN nn USING (user_id)", use="samples typed_samples")
def event_triggered_average(spark, sf):
    return _r(R.spike_triggered_average(_resp(spark, sf), stimulus(spark, sf), U, 4, -1, events=True), 6, "w")


_PRED = f"{_STA}, pd AS (SELECT s.user_id, s.i, s.y, coalesce(sum(sta.s / n * st.x), 0) AS p FROM rs s JOIN nn USING (user_id) JOIN sta USING (user_id) LEFT JOIN st ON st.user_id = s.user_id AND st.px = sta.px AND st.i = s.i + lag - 4 + 1 + 1 GROUP BY 1, 2, 3)"


def _pred(spark, sf, floor=False):
    resp, stim = _resp(spark, sf), stimulus(spark, sf)
    return R.predict_linear(R.spike_triggered_average(resp, stim, U, 4, -1), stim, resp, U, 4, -1, floor)


@query(f"WITH {_PRED} SELECT user_id, i, round(p, 5) + 0.0 AS y_pred FROM pd", use="samples typed_samples")
def sta_batchwise(spark, sf):
    """Prediction as a sum over all pixels; sums combine before the shuffle in place of pixel batches."""
    return _r(_pred(spark, sf), 5, "y_pred").drop("y")


@query(f"WITH {_PRED} SELECT user_id, i, round(greatest(p, 0), 5) + 0.0 AS y_pred FROM pd", use="samples typed_samples")
def predict_linear(spark, sf):
    return _r(_pred(spark, sf, True), 5, "y_pred").drop("y")


@query(
    f"WITH {_STIM}, {_LAGS}, n AS (SELECT user_id, count(*) AS n FROM rs GROUP BY 1), sp AS (SELECT user_id, i, y, i >= floor(n * 0.8::DOUBLE) AS test, floor(n * 0.8::DOUBLE)::BIGINT AS m FROM rs JOIN n USING (user_id)), "
    "lo AS (SELECT user_id, test, CASE WHEN test THEN i - m ELSE i END AS i, i AS g, y FROM sp), ls AS (SELECT lo.user_id, test, lo.i, px, x FROM lo JOIN st ON st.user_id = lo.user_id AND st.i = lo.g), "
    "w AS (SELECT lo.user_id, lag, px, sum(y * x) / any_value(c) AS w FROM lo JOIN (SELECT user_id, count(*)::DOUBLE AS c FROM lo WHERE NOT test GROUP BY 1) USING (user_id), lg JOIN ls ON ls.user_id = lo.user_id AND NOT ls.test AND ls.i = lo.i + lag - 3 WHERE NOT lo.test GROUP BY 1, 2, 3), "
    "p AS (SELECT lo.user_id, lo.test, lo.i, lo.y, sum(w * x) AS p FROM lo JOIN w USING (user_id) JOIN ls ON ls.user_id = lo.user_id AND ls.test = lo.test AND ls.px = w.px AND ls.i = lo.i + lag - 3 WHERE lo.i >= 4 GROUP BY 1, 2, 3, 4) "
    "SELECT user_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split, round(corr(y, p), 5) + 0.0 AS cc, round(avg((y - p) * (y - p)), 4) AS mse FROM p GROUP BY 1, 2",
    use="samples typed_samples",
)
def fit_sta_table(spark, sf):
    scores = R.fit_sta_table(_resp(spark, sf), stimulus(spark, sf), U, 4)[1]
    return _r(_r(scores, 5, "cc"), 4, "mse")


@query()
def least_squares_rf(spark, sf):
    return _r(R.least_squares_rf(_resp(spark, sf), stimulus(spark, sf), U, TYPES, 2), 6, "w")


@query(
    f"WITH {_STIM} SELECT DISTINCT user_id, lag::INTEGER AS lag, px, 0.0::DOUBLE AS w FROM st, range(2) r(lag)",
    use="typed_samples",
)
def least_squares_residuals(spark, sf):
    """What a least-squares filter leaves is uncorrelated with every lagged pixel: the normal equations hold."""
    resp, stim = _resp(spark, sf), stimulus(spark, sf)
    left = R.predict_linear(R.least_squares_rf(resp, stim, U, TYPES, 2), stim, resp, U, 2)
    left = left.select("user_id", "i", (F.col("y") - F.col("y_pred")).alias("y"))
    return _r(R.spike_triggered_average(left, stim, U, 2), 6, "w")


@query()
def penalized_rf(spark, sf):
    return _r(R.penalized_rf(_resp(spark, sf), stimulus(spark, sf), U, TYPES, 6, [4, 5], [0.1, 2.0], 0.5, 2, 2)[0], 6, "w").select("user_id", "lag", "px", "w")


@query("SELECT DISTINCT p_partkey, least(a, p_size) AS df_t, b AS beta FROM part, (VALUES (5), (20), (40)) t(a), (VALUES (0.1::DOUBLE), (0.01::DOUBLE)) u(b)")
def hyper_grid(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return R.hyper_grid(p, {"df_t": [5, 20, 40], "beta": [0.1, 0.01]}, {"df_t": "p_size"}).drop("p_size")


@query(
    "WITH m AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS s FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_min(l_linenumber, (-round(s, 9), l_linenumber)) AS l_linenumber, round(max(s), 8) AS mean_score FROM m GROUP BY 1"
)
def best_hyper(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_discount")
    return _r(R.best_hyper(l, ["l_suppkey"], ["l_linenumber"], "l_discount", True), 8, "mean_score")


_PERM = (
    f"{_STA}, pm AS (SELECT user_id, i, perm, row_number() OVER (PARTITION BY user_id, perm ORDER BY md5('3:' || perm || ':' || user_id || ':' || i), i) - 1 AS k FROM (SELECT DISTINCT user_id, i FROM st), range(5) r(perm)), "
    "ms AS (SELECT user_id, perm, k AS i, px, x FROM st JOIN pm USING (user_id, i) UNION ALL SELECT user_id, -1, i, px, x FROM st), "
    "pp AS (SELECT s.user_id, perm, s.i, s.y, coalesce(sum(sta.s / n * ms.x), 0) AS p FROM rs s JOIN nn USING (user_id), range(-1, 5) r(perm) JOIN sta ON sta.user_id = s.user_id LEFT JOIN ms ON ms.user_id = s.user_id AND ms.perm = r.perm AND ms.px = sta.px AND ms.i = s.i + lag - 4 + 1 + 1 GROUP BY s.user_id, r.perm, s.i, s.y), "
    "sc AS (SELECT user_id, perm, corr(y, p) AS corrcoef, avg((y - p) * (y - p)) AS mse FROM pp GROUP BY 1, 2)"
)


def _scores(spark, sf):
    resp, stim = _resp(spark, sf), stimulus(spark, sf)
    return R.permutation_scores(R.spike_triggered_average(resp, stim, U, 4, -1), stim, resp, U, 4, 5, 3, -1)


@query(f"WITH {_PERM.replace('SELECT s.user_id, perm,', 'SELECT s.user_id, r.perm,')} SELECT user_id, perm::INTEGER AS perm, round(corrcoef, 6) + 0.0 AS corrcoef, round(mse, 5) AS mse FROM sc", use="samples typed_samples")
def permutation_scores(spark, sf):
    return _r(_r(_scores(spark, sf), 6, "corrcoef"), 5, "mse")


@query(
    f"WITH {_PERM.replace('SELECT s.user_id, perm,', 'SELECT s.user_id, r.perm,')}, a AS (SELECT user_id, avg(corrcoef) AS m, stddev_samp(corrcoef) AS sd, count(corrcoef) AS n FROM sc WHERE perm >= 0 GROUP BY 1) "
    "SELECT user_id, round(corrcoef, 6) + 0.0 AS score_test, round((m - corrcoef) / (sd / sqrt(n)), 3) + 0.0 AS t FROM sc JOIN a USING (user_id) WHERE perm = -1",
    use="samples typed_samples",
)
def permutation_quality(spark, sf):
    q = R.permutation_quality(_scores(spark, sf), U)
    return _r(_r(q, 6, "score_test"), 3, "t").select("user_id", "score_test", "t")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, -1.0::DOUBLE AS score_test FROM events")
def quality_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,double>").alias("q"))
    return R.quality_columns(e, "q", ["k", "score_test"])


_RF = "rf AS (SELECT label, y AS lag, x AS px, avg(v) + 0.02::DOUBLE * x AS w FROM pixels GROUP BY 1, 2, 3)"


def _rf(spark, sf):
    p = pixels(spark, sf).groupBy("label", F.col("y").alias("lag"), F.col("x").alias("px"))
    return p.agg((F.avg("v") + 0.02 * F.first("x")).alias("w"))


@query()
def separate_rf(spark, sf):
    srf, trf, qi = R.separate_rf(_rf(spark, sf), ["label"], 8)
    s = srf.select("label", F.lit("space").alias("part"), F.col("px").alias("pos"), "w")
    t = trf.select("label", F.lit("time").alias("part"), F.col("lag").alias("pos"), "w")
    return _r(s.unionByName(t).join(qi, "label"), 6, "w", "split_qidx")


@query(
    "WITH k AS (SELECT d, exp(-0.5::DOUBLE * d * d / (0.8::DOUBLE * 0.8::DOUBLE)) / (SELECT sum(exp(-0.5::DOUBLE * e * e / (0.8::DOUBLE * 0.8::DOUBLE))) FROM range(-2, 3) q(e)) AS g FROM range(-2, 3) p(d)), "
    "m AS (SELECT label, x, y, avg(v) AS v FROM pixels GROUP BY 1, 2, 3), b AS (SELECT m.label, m.x, m.y, sum(n.v * a.g * c.g) AS v FROM m, k a, k c JOIN m n ON n.label = m.label AND n.x = least(greatest(m.x + a.d, 0), 7) AND n.y = least(greatest(m.y + c.d, 0), 7) GROUP BY 1, 2, 3), "
    "t AS (SELECT i, least(greatest((i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), 7) AS c FROM range(16) r(i)), w AS (SELECT i, s, 1 - abs(c - s) AS w FROM t, range(8) q(s) WHERE abs(c - s) < 1), "
    "f AS (SELECT label, a.i AS x, c.i AS y, sum(v * a.w * c.w) AS v FROM b JOIN w a ON a.s = b.x JOIN w c ON c.s = b.y GROUP BY 1, 2, 3) "
    "SELECT label, x, y, round(v, 6) + 0.0 AS w FROM f",
    use="pixels",
)
def separate_image_rf(spark, sf):
    """A filter with one time course: its spatial part is the blurred image on a grid twice as fine, up to its scale."""
    img = pixels(spark, sf).groupBy("label", "x", "y").agg(F.avg("v").alias("w"))
    course = F.explode(F.array(*[F.struct(F.lit(l).alias("lag"), F.lit(c).alias("c")) for l, c in enumerate((0.25, 1.0, -0.5))]))
    rf = img.withColumn("_t", course).select("label", F.col("_t.lag").alias("lag"), "x", "y", (F.col("w") * F.col("_t.c")).alias("w"))
    return _r(R.separate_image_rf(rf, ["label"], 3, (8, 8), 0.8, 2, 2)[0], 6, "w")


@query(f"WITH {_RF}, s AS (SELECT label, px, avg(w) AS w FROM rf GROUP BY 1, 2), t AS (SELECT label, lag, avg(w) AS w FROM rf GROUP BY 1, 2) SELECT s.label, lag, px, round(s.w * t.w, 10) + 0.0 AS w_fit FROM s JOIN t USING (label)", use="pixels")
def merge_rf(spark, sf):
    rf = _rf(spark, sf)
    out = R.merge_rf(rf.groupBy("label", "px").agg(F.avg("w").alias("w")), rf.groupBy("label", "lag").agg(F.avg("w").alias("w")), ["label"])
    return _r(out, 10, "w_fit")


@query(
    f"WITH {_RF}, s AS (SELECT label, sign(arg_max(w, abs(w))) AS s FROM rf GROUP BY 1), t AS (SELECT label, sum(greatest(s * w, 0)) AS t FROM rf JOIN s USING (label) GROUP BY 1) SELECT label, lag, px, round(w / t, 8) + 0.0 AS w FROM rf JOIN t USING (label)",
    use="pixels",
)
def normalize_rf(spark, sf):
    return _r(R.normalize_rf(_rf(spark, sf), ["label"]), 8, "w")


_PEAKS = (
    "tr AS (SELECT vec_id, j::BIGINT AS i, (j - 63) * 0.1::DOUBLE AS t, v AS w FROM vectors), sd AS (SELECT vec_id, stddev_pop(w) AS s FROM tr GROUP BY 1), "
    "sv AS (SELECT vec_id, sg, i, sg * CASE WHEN t > -0.55 THEN 0 ELSE w END / s AS y FROM tr JOIN sd USING (vec_id), (VALUES (1), (-1)) g(sg)), "
    "nb AS (SELECT *, lag(y) OVER o AS b, lead(y) OVER o AS a FROM sv WINDOW o AS (PARTITION BY vec_id, sg ORDER BY i)), cd AS (SELECT * FROM nb WHERE y > b AND y > a AND y >= 1), "
    "lh AS (SELECT cd.*, coalesce((SELECT max(q.i) FROM sv q WHERE q.vec_id = cd.vec_id AND q.sg = cd.sg AND q.i < cd.i AND q.y > cd.y), -1) AS l, coalesce((SELECT min(q.i) FROM sv q WHERE q.vec_id = cd.vec_id AND q.sg = cd.sg AND q.i > cd.i AND q.y > cd.y), 1000) AS r FROM cd), "
    "pk AS (SELECT vec_id, i, (SELECT w FROM tr WHERE tr.vec_id = lh.vec_id AND tr.i = lh.i) AS y FROM lh WHERE y - greatest((SELECT min(q.y) FROM sv q WHERE q.vec_id = lh.vec_id AND q.sg = lh.sg AND q.i > l AND q.i < lh.i), (SELECT min(q.y) FROM sv q WHERE q.vec_id = lh.vec_id AND q.sg = lh.sg AND q.i < r AND q.i > lh.i)) >= 0.5), "
    "bg AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(y) DESC, i DESC) AS rn FROM pk), tm AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i DESC) AS q FROM bg WHERE rn <= 2), "
    "tw AS (SELECT vec_id, max(i) FILTER (WHERE q = 1) AS mi, max(y) FILTER (WHERE q = 1) AS my, max(y) FILTER (WHERE q = 2) AS py FROM tm GROUP BY 1), "
    "t2 AS (SELECT vec_id, mi, my, coalesce(py, CASE WHEN my > 0 THEN (SELECT min(w) FROM tr WHERE tr.vec_id = tw.vec_id AND tr.i < mi) ELSE (SELECT max(w) FROM tr WHERE tr.vec_id = tw.vec_id AND tr.i < mi) END) AS py FROM tw), al AS (SELECT DISTINCT vec_id FROM vectors)"
)


def _trf(spark, sf):
    """Vectors as temporal filters of 64 lags."""
    return vectors(spark, sf).select("vec_id", F.col("j").alias("lag"), ((F.col("j") - 63) * F.lit(0.1)).alias("t"), F.col("v").alias("w"))


def _peaks(spark, sf):
    t = _trf(spark, sf)
    return t, R.trf_peaks(t, V, 1.0, max_t=-0.55)


@query(f"WITH {_PEAKS} SELECT al.vec_id, CASE WHEN y IS NULL THEN 0 WHEN y > 0 THEN 1 ELSE -1 END AS polarity FROM al LEFT JOIN (SELECT vec_id, arg_max(y, i) AS y FROM pk GROUP BY 1) USING (vec_id)", use="vectors")
def polarity(spark, sf):
    t, p = _peaks(spark, sf)
    return R.polarity(t, p, V)


@query(
    f"WITH {_PEAKS} SELECT al.vec_id, round(CASE WHEN my IS NULL THEN -1 WHEN sign(py) <> sign(my) THEN 2 * abs(py) / (abs(my) + abs(py)) ELSE 0 END, 8) + 0.0 AS transience_index FROM al LEFT JOIN t2 USING (vec_id)", use="vectors"
)
def transience(spark, sf):
    t, p = _peaks(spark, sf)
    return _r(R.transience(t, p, V), 8, "transience_index")


@query(
    f"WITH {_PEAKS}, sg AS (SELECT tr.vec_id, tr.i, tr.t, mi, sign(my) * w AS lo, sign(my) * lead(w) OVER (PARTITION BY tr.vec_id ORDER BY tr.i) AS hi, abs(my) / 2 AS h FROM tr JOIN t2 USING (vec_id)), "
    "x AS (SELECT vec_id, min(t + 0.1::DOUBLE * (h - lo) / (hi - lo)) FILTER (WHERE i >= mi AND lo >= h AND hi < h) AS r, max(t + 0.1::DOUBLE * (h - lo) / (hi - lo)) FILTER (WHERE i < mi AND lo < h AND hi >= h) AS l, min(t) AS t0, max(t) AS t1 FROM sg GROUP BY 1) "
    "SELECT vec_id, round(coalesce(r, t1) - coalesce(l, t0), 8) + 0.0 AS half_width FROM x",
    use="vectors",
)
def half_width(spark, sf):
    t, p = _peaks(spark, sf)
    return _r(R.half_width(t, p, V), 8, "half_width")


@query(
    f"WITH {_PEAKS}, sg AS (SELECT vec_id, i, t, w, lag(w) OVER o AS a, lead(w) OVER o AS b FROM tr WINDOW o AS (PARTITION BY vec_id ORDER BY i)) SELECT sg.vec_id, round(-(t + coalesce((a - b) / (2 * nullif(a - 2 * w + b, 0)) * 0.1::DOUBLE, 0)), 8) + 0.0 AS main_peak_lag FROM sg JOIN t2 ON t2.vec_id = sg.vec_id AND mi = i",
    use="vectors",
)
def peak_lag(spark, sf):
    t, p = _peaks(spark, sf)
    return _r(R.peak_lag(t, p, V), 8, "main_peak_lag")


_MOM = (
    "sg AS (SELECT vec_id, sign(arg_max(v, abs(v))) AS s, arg_max(v, abs(v)) AS amplitude FROM pixels GROUP BY 1), ps AS (SELECT vec_id, x, y, v, amplitude, greatest(s * v, 0) AS p FROM pixels JOIN sg USING (vec_id)), "
    "mo AS (SELECT vec_id, any_value(amplitude) AS amplitude, sum(p * x) / sum(p) AS cx, sum(p * y) / sum(p) AS cy, sum(p * x * x) / sum(p) - pow(sum(p * x) / sum(p), 2) AS vxx, sum(p * y * y) / sum(p) - pow(sum(p * y) / sum(p), 2) AS vyy, sum(p * x * y) / sum(p) - sum(p * x) * sum(p * y) / (sum(p) * sum(p)) AS vxy FROM ps GROUP BY 1), "
    "ft AS (SELECT ps.vec_id, x, y, v, mo.amplitude * exp(-0.5::DOUBLE * (vyy * (x - cx) * (x - cx) - 2 * vxy * (x - cx) * (y - cy) + vxx * (y - cy) * (y - cy)) / (vxx * vyy - vxy * vxy)) AS f FROM ps JOIN mo USING (vec_id))"
)


def _srf(spark, sf):
    return pixels(spark, sf).select("vec_id", "x", "y", F.col("v").alias("w"))


@query(
    f"WITH {_MOM}, q AS (SELECT vec_id, 1 - var_pop(v - f) / var_pop(v) AS q FROM ft GROUP BY 1) SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy)), 6) AS std_major, "
    "round(sqrt((vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy)), 6) AS std_minor, round(2 * sqrt(4 * sqrt(vxx * vyy) * 600), 4) AS rf_cdia_um, round(q, 6) AS rf_qidx FROM mo JOIN q USING (vec_id)",
    use="pixels",
)
def rf_moments(spark, sf):
    m = R.rf_moments(_srf(spark, sf), V, (20.0, 30.0))
    return _r(_r(m, 6, "cx", "cy", "std_major", "std_minor", "rf_qidx"), 4, "rf_cdia_um").select("vec_id", "cx", "cy", "std_major", "std_minor", "rf_cdia_um", "rf_qidx")


@query(
    f"WITH {_MOM}, e AS (SELECT vec_id, x, y, CASE WHEN vec_id % 2 = 0 THEN greatest(f, 0) ELSE -greatest(-f, 0) END AS c FROM ft) SELECT vec_id, x, y, round(c, 8) + 0.0 AS w_center FROM e WHERE vec_id IN (SELECT vec_id FROM e GROUP BY 1 HAVING max(abs(c)) > 1e-8)",
    use="pixels",
)
def effective_center(spark, sf):
    s = _srf(spark, sf)
    f = R.gaussian_fit(s, R.rf_moments(s, V, (1.0, 1.0)), V).withColumn("pol", F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1))
    return _r(R.effective_center(f, V, "pol"), 8, "w_center").select("vec_id", "x", "y", "w_center")


@query(
    "WITH m AS (SELECT p_partkey, p_size % 6 + 2 AS n, p_retailprice / 10000 AS dt, -(p_partkey % 3) AS s FROM part) SELECT p_partkey, k::INTEGER AS lag, round(CASE WHEN p_partkey % 4 = 0 THEN k * 0.5::DOUBLE ELSE (k - n + 1 - s) * dt END, 8) + 0.0 AS t FROM (SELECT *, unnest(range(n)) AS k FROM m)"
)
def lag_axis_from_model(spark, sf):
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k, (F.col("p_size") % 6 + 2).alias("n"), (F.col("p_retailprice") / 10000).alias("dt"), (-(k % 3)).alias("s"))
    m = m.withColumn("axis", F.when(k % 4 == 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda l: l * F.lit(0.5))))
    return _r(R.lag_axis_from_model(m, ["p_partkey"], "axis", "n", "dt", "s"), 8, "t")
