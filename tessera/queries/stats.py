"""Queries for aggregations, rank tests and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as P
from ..operators import series as T
from ..operators import stats as A
from .fixtures import mask, pixels, samples, table, triggers, vectors
from .registry import query

U = ["user_id"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# One repetition per trigger, eight samples each; repetitions without all samples are left out.
SNIPS = (
    "sn AS (SELECT g.user_id, g.k AS rep, s.i - g.k * 8 - 4 AS j, s.t, s.y FROM triggers g JOIN samples s ON s.user_id = g.user_id AND s.i BETWEEN g.k * 8 + 4 AND g.k * 8 + 11 "
    "WHERE g.k * 8 + 12 <= (SELECT count(*) FROM samples x WHERE x.user_id = g.user_id))"
)


def snips(spark, sf):
    return T.snippets(samples(spark, sf), triggers(spark, sf), U, 1)


@query(
    "WITH mn AS (SELECT label, x, y, avg(v) AS m FROM pixels GROUP BY 1, 2, 3), mk AS (SELECT label, x, y, CASE WHEN m > 0 THEN 1 ELSE 2 END AS roi_id FROM mn WHERE abs(m) > 0.02), "
    "md AS (SELECT label, roi_id, median((y * 8 + x) * 0.001::DOUBLE) AS off FROM mk GROUP BY 1, 2) "
    "SELECT p.label, mk.roi_id, p.vec_id AS frame, round(p.vec_id * 0.1::DOUBLE + any_value(off), 8) AS t, round(avg(p.v), 8) AS y FROM pixels p JOIN mk USING (label, x, y) JOIN md ON md.label = p.label AND md.roi_id = mk.roi_id GROUP BY 1, 2, 3",
    use="pixels",
)
def roi_traces(spark, sf):
    p = pixels(spark, sf).withColumnRenamed("vec_id", "frame")
    m = p.groupBy("label", "x", "y").agg(F.avg("v").alias("m")).filter("abs(m) > 0.02")
    m = m.select("label", "x", "y", F.when(F.col("m") > 0, 1).otherwise(2).alias("roi_id"))
    times = p.select("label", "frame").distinct().withColumn("t", F.col("frame") * F.lit(0.1))
    off = p.select("label", "x", "y").distinct().withColumn("offset", (F.col("y") * 8 + F.col("x")) * F.lit(0.001))
    return _r(A.roi_traces(p, m, ["label"], times, off), 8, "t", "y")


@query(
    "SELECT vec_id, roi_id, count(*) AS roi_size, max((x < 2)::INTEGER) AS artifact_flag, round(count(*) * 2.25::DOUBLE, 6) AS roi_size_um2, round(2 * sqrt(count(*) * 2.25::DOUBLE / pi()), 6) AS roi_dia_um FROM mask GROUP BY 1, 2",
    use="mask",
)
def roi_stats(spark, sf):
    return _r(A.roi_stats(mask(spark, sf), ["vec_id"], 2, 1.5, 1.5), 6, "roi_size_um2", "roi_dia_um")


@query("SELECT vec_id, roi_id, row_number() OVER (PARTITION BY vec_id ORDER BY roi_id) - 1 AS place FROM (SELECT DISTINCT vec_id, roi_id FROM mask WHERE x >= 4)", use="mask")
def roi_ids(spark, sf):
    return A.roi_ids(mask(spark, sf), ["vec_id"], 4)


@query("SELECT vec_id, roi_id, round(avg(x), 8) AS cx, round(avg(y), 8) AS cy FROM mask GROUP BY 1, 2", use="mask")
def roi_centroid(spark, sf):
    return _r(A.roi_centroid(mask(spark, sf), ["vec_id"]), 8, "cx", "cy")


@query(
    "WITH c AS (SELECT vec_id, roi_id, (avg(x) - 4) * 2 AS dx, (avg(y) - 4) * 2 AS dy FROM mask GROUP BY 1, 2), r AS (SELECT vec_id, roi_id, dx * cos(radians(30)) - dy * sin(radians(30)) AS rx, dx * sin(radians(30)) + dy * cos(radians(30)) AS ry FROM c) "
    "SELECT vec_id, roi_id, round(rx, 6) + 0.0 AS dx_um, round(ry, 6) + 0.0 AS dy_um, round(sqrt(rx * rx + ry * ry), 6) AS d_um FROM r",
    use="mask",
)
def roi_offset(spark, sf):
    return _r(A.roi_offset(mask(spark, sf), ["vec_id"], (8, 8), 2.0, 30.0), 6, "dx_um", "dy_um", "d_um")


@query("SELECT label, x, y, round(median(v), 8) + 0.0 AS v FROM pixels GROUP BY 1, 2, 3", use="pixels")
def stack_median(spark, sf):
    return _r(A.stack_median(pixels(spark, sf), ["label"]), 8, "v")


@query(
    f"WITH {SNIPS}, r AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, rep) AS dt FROM sn) SELECT user_id, j, round(avg(dt), 2) AS t, stddev_pop(dt) <= 90000 AS consistent FROM r GROUP BY 1, 2",
    use="samples triggers",
)
def aligned_times(spark, sf):
    return _r(A.aligned_times(snips(spark, sf), U, 90000.0), 2, "t")


@query(
    f"WITH {SNIPS}, r AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, rep) AS dt FROM sn), a AS (SELECT user_id, j, avg(dt) AS t, avg(y) AS avg FROM r GROUP BY 1, 2) "
    "SELECT user_id, j, round(t, 2) AS t, round(avg, 6) AS avg, round(avg / max(abs(avg)) OVER (PARTITION BY user_id), 6) AS avg_norm FROM a",
    use="samples triggers",
)
def average_snippets(spark, sf):
    return _r(_r(A.average_snippets(snips(spark, sf), U), 2, "t"), 6, "avg", "avg_norm")


@query(
    "WITH g AS (SELECT user_id, k // 2 AS rep, k % 2 AS k, t FROM triggers), z AS (SELECT user_id, rep, min(t) FILTER (WHERE k = 0) AS t0 FROM g GROUP BY 1, 2) SELECT user_id, k, round(avg(t - t0), 2) AS t FROM g JOIN z USING (user_id, rep) GROUP BY 1, 2",
    use="triggers",
)
def relative_triggers(spark, sf):
    g = triggers(spark, sf)
    g = T.snippet_triggers(g, g.select("user_id", F.expr("k div 2").alias("rep")).distinct(), U, 2)
    return _r(A.relative_triggers(g, U), 2, "t")


_QI = (
    "qa AS (SELECT user_id, var_pop(m) AS a FROM (SELECT user_id, j, avg(y) AS m FROM sn GROUP BY 1, 2) GROUP BY 1), "
    "qb AS (SELECT user_id, avg(v) AS b, count(*) AS n FROM (SELECT user_id, rep, var_pop(y) AS v FROM sn GROUP BY 1, 2) GROUP BY 1), "
    "qi AS (SELECT user_id, a / nullif(b, 0) AS qidx, 1 / n::DOUBLE AS min_qidx FROM qa JOIN qb USING (user_id))"
)


@query(f"WITH {SNIPS}, {_QI} SELECT user_id, round(qidx, 6) AS qidx, round(min_qidx, 6) AS min_qidx FROM qi", use="samples triggers")
def repeat_quality(spark, sf):
    return _r(A.repeat_quality(snips(spark, sf), U), 6, "qidx", "min_qidx")


@query(
    "WITH t0 AS (SELECT user_id, min(t) AS t0 FROM triggers GROUP BY 1), pre AS (SELECT s.* FROM samples s JOIN t0 USING (user_id) WHERE s.t < t0), bl AS (SELECT * FROM pre WHERE t < (SELECT max(t) FROM pre p WHERE p.user_id = pre.user_id)), "
    "md AS (SELECT user_id, median(y) AS m, stddev_pop(y) AS sd FROM bl GROUP BY 1), pp AS (SELECT s.user_id, s.i, s.t, (s.y - m) / nullif(sd, 0) AS y FROM samples s JOIN md USING (user_id)), "
    "sn AS (SELECT g.user_id, g.k AS rep, s.i - g.k * 8 - 4 AS j, s.y FROM triggers g JOIN pp s ON s.user_id = g.user_id AND s.i BETWEEN g.k * 8 + 4 AND g.k * 8 + 11 WHERE g.k * 8 + 12 <= (SELECT count(*) FROM samples x WHERE x.user_id = g.user_id)), "
    f"{_QI} SELECT u.user_id, round(qidx, 5) AS qidx, CASE WHEN qi.user_id IS NULL THEN -1 WHEN round(qidx, 5) >= 0.13 THEN 1 ELSE 0 END AS quality FROM (SELECT DISTINCT user_id FROM samples) u LEFT JOIN qi USING (user_id)",
    use="samples triggers",
)
def response_quality_flags(spark, sf):
    """Baseline, spread, repetitions, repeat quality, flag: from raw events to usable recordings."""
    s, g = samples(spark, sf), triggers(spark, sf)
    t0 = g.groupBy("user_id").agg(F.min("t").alias("t0"))
    pre = T.standardize(T.subtract_baseline(s, t0, U), U, 1, t0)
    starts = T.repetition_starts(s, g, U, 1)
    qi = _r(A.repeat_quality(T.snippet_join(starts, pre, U), U), 5, "qidx").select("user_id", "qidx")
    flagged = P.quality_flag(s.select("user_id").distinct(), qi, U, "qidx", 0.13, "quality")
    return flagged.join(qi, "user_id", "left").select("user_id", "qidx", "quality")


@query(f"WITH {SNIPS}, {_QI} SELECT user_id % 10 AS grp, round(avg(qidx), 6) AS mean, round(min(qidx), 6) AS lowest, round(max(qidx), 6) AS highest FROM qi GROUP BY 1", use="samples triggers")
def quality_summary(spark, sf):
    qi = A.repeat_quality(snips(spark, sf), U).withColumn("grp", F.col("user_id") % 10)
    return _r(A.quality_summary(qi, ["grp"]), 6, "mean", "lowest", "highest")


@query("SELECT user_id, round(avg((y - 50 > 0)::INTEGER), 8) AS fraction FROM samples GROUP BY 1", use="samples")
def event_fraction(spark, sf):
    return _r(A.event_fraction(samples(spark, sf).withColumn("y", F.col("y") - 50), U), 8, "fraction")


@query("SELECT o_orderkey, round(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) + 0.0 AS o_totalprice_rel FROM orders")
def group_offset(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return _r(A.group_offset(o, ["o_orderpriority"], ["o_totalprice"]), 4, "o_totalprice_rel").select("o_orderkey", "o_totalprice_rel")


@query(
    "WITH m AS (SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_nationkey, arg_min(c_custkey, (abs(c_acctbal - m), c_custkey)) AS c_custkey, arg_min(c_acctbal, (abs(c_acctbal - m), c_custkey)) AS c_acctbal FROM customer JOIN m USING (c_nationkey) GROUP BY 1"
)
def median_member(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return A.median_member(c, ["c_nationkey"], "c_acctbal", ["c_custkey"])


@query("SELECT l_suppkey, arg_min(l_orderkey, (-l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def best_per_group(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return A.best_per_group(l, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY 1")
def pivot_counts(spark, sf):
    return A.pivot_counts(table(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type", _TYPES)


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id)::DOUBLE, 8) AS share FROM events GROUP BY 1, 2")
def share_within_group(spark, sf):
    return _r(A.share_within_group(table(spark, sf, "events"), ["user_id"], "event_type"), 8, "share")


@query("SELECT o_orderpriority, round(avg((o_totalprice < 100000)::INTEGER), 8) AS share FROM orders GROUP BY ROLLUP (o_orderpriority)")
def share_below(spark, sf):
    return _r(A.share_below(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 100000.0), 8, "share")


@query(
    "SELECT l_shipdate, " + ", ".join(f"round(avg(l_discount) FILTER (WHERE l_returnflag = '{f}'), 8) AS \"{f}\"" for f in "ANR") + " FROM lineitem GROUP BY 1"
)
def pivot_mean(spark, sf):
    return _r(A.pivot_mean(table(spark, sf, "lineitem"), ["l_shipdate"], "l_returnflag", list("ANR"), "l_discount"), 8, *"ANR")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def group_means(spark, sf):
    out = A.group_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return _r(_r(out, 6, "l_quantity"), 4, "l_extendedprice")


@query(
    "SELECT b::INTEGER AS bin, round(avg(l_tax), 8) AS error, count(*) AS n FROM lineitem, range(5) r(b) WHERE l_quantity >= b * 10 AND l_quantity <= b * 10 + 10 GROUP BY 1"
)
def binned_error(spark, sf):
    return _r(A.binned_error(table(spark, sf, "lineitem"), "l_quantity", "l_tax", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]), 8, "error")


@query(
    "WITH d AS (SELECT event_type, least(floor((value - 0) / (400 / 16.0::DOUBLE)), 15)::BIGINT AS bin FROM events WHERE value BETWEEN 0 AND 400 UNION ALL SELECT event_type, NULL FROM events WHERE value NOT BETWEEN 0 AND 400), "
    "s AS (SELECT event_type, count(*) AS size FROM d GROUP BY 1), g AS (SELECT event_type, size, unnest(range(16)) AS bin FROM s) "
    "SELECT g.event_type, g.bin, (SELECT count(*) FROM d WHERE d.event_type = g.event_type AND d.bin = g.bin) AS n, "
    "round((SELECT count(*) FROM d WHERE d.bin = g.bin) * size / (SELECT count(*) FROM d)::DOUBLE, 6) AS n_all_scaled FROM g"
)
def histogram(spark, sf):
    return _r(A.histogram(table(spark, sf, "events"), "value", 16, 0.0, 400.0, "event_type"), 6, "n_all_scaled")


@query("SELECT c_mktsegment, round(min(c_acctbal) - 0.05::DOUBLE * (max(c_acctbal) - min(c_acctbal)), 6) AS lo, round(max(c_acctbal) + 0.05::DOUBLE * (max(c_acctbal) - min(c_acctbal)), 6) AS hi FROM customer GROUP BY 1")
def padded_range(spark, sf):
    return _r(A.padded_range(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", 0.05), 6, "lo", "hi")


@query(
    "SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS r, round(corr(a, b) * corr(a, b), 6) AS r2, round(regr_slope(b, a), 4) AS slope, round(regr_intercept(b, a), 3) AS intercept FROM "
    "(SELECT l_returnflag, CASE WHEN l_linenumber < 7 THEN l_quantity END AS a, l_extendedprice AS b FROM lineitem) WHERE a IS NOT NULL GROUP BY 1"
)
def correlation(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"))
    return _r(_r(_r(A.correlation(l, "a", "b", ["l_returnflag"]), 6, "r", "r2"), 4, "slope"), 3, "intercept")


_RANKS = (
    "rk AS (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE AS r FROM {t}), ng AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS rs FROM rk GROUP BY 1), "
    "tot AS (SELECT count(*)::DOUBLE AS nn FROM rk), ti AS (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM {t} GROUP BY {v}))"
)


@query(
    f"WITH {_RANKS.format(g='o_orderpriority', v='floor(o_totalprice / 1000)', t='orders')}, h AS (SELECT (12 / (nn * (nn + 1)) * sum(rs * rs / n) - 3 * (nn + 1)) / (1 - any_value(t) / (nn * nn * nn - nn)) AS h, count(*) - 1 AS df FROM ng, tot, ti GROUP BY nn) "
    "SELECT round(h, 5) AS h, df, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h"
)
def kruskal_wallis(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return _r(_r(A.kruskal_wallis(o, "v", "o_orderpriority"), 5, "h"), 6, "p")


# Two-sided normal tail by Simpson's rule on 2000 steps.
_TAIL = "greatest(0, 1 - 2 * (z / 2000 / 3) * list_sum(list_transform(range(2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * pow(z * k / 2000, 2)) / sqrt(2 * pi()))))"


@query(
    f"WITH {_RANKS.format(g='l_returnflag || l_linestatus', v='l_quantity', t='lineitem')}, z AS (SELECT a.g AS group_a, b.g AS group_b, abs(a.rs / a.n - b.rs / b.n) / sqrt((nn * (nn + 1) / 12 - t / (12 * (nn - 1))) * (1 / a.n + 1 / b.n)) AS z FROM ng a JOIN ng b ON a.g < b.g, tot, ti), "
    f"p AS (SELECT *, {_TAIL} AS p FROM z), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, group_a, group_b) AS q, row_number() OVER (ORDER BY p, group_a, group_b) AS k FROM p) "
    "SELECT group_a, group_b, round(z, 6) AS z, round(p, 6) AS p, round(least(1, min(q) OVER (ORDER BY k DESC)), 6) AS p_adj FROM k"
)
def dunn_posthoc(spark, sf):
    l = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), "l_quantity")
    return _r(A.dunn_posthoc(l, "l_quantity", "g"), 6, "z", "p", "p_adj")


@query(
    f"WITH two AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')), {_RANKS.format(g='o_orderstatus', v='floor(o_totalprice / 1000)', t='two')}, "
    "m AS (SELECT max(n) FILTER (WHERE g = 'F') AS n1, max(n) FILTER (WHERE g = 'O') AS n2, max(rs) FILTER (WHERE g = 'F') AS r1 FROM ng), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM m), "
    "z AS (SELECT u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (nn + 1 - t / (nn * (nn - 1)))) AS z FROM u, tot, ti) "
    f"SELECT round(u, 3) AS u, round(z, 6) AS z, round(least(1, {_TAIL}), 6) AS p FROM z"
)
def mann_whitney(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return _r(_r(A.mann_whitney(o, "v", "o_orderstatus", "F", "O"), 3, "u"), 6, "z", "p")


@query(
    "WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT c_nationkey, (m - 5000) / (sd / sqrt(n)) AS t, (n - 1)::DOUBLE AS df FROM s) "
    # Upper tail of Student's t by Simpson's rule on its density.
    "SELECT c_nationkey, round(t, 6) AS t, round(0.5 + (t / 2000 / 3) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * list_sum(list_transform(range(2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * k / 2000, 2) / df, -(df + 1) / 2))), 6) AS p FROM t"
)
def permutation_p(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").alias("score"))
    true = c.select("c_nationkey").distinct().withColumn("true_score", F.lit(5000.0))
    return _r(A.permutation_p(c, true, ["c_nationkey"], "corrcoef"), 6, "t", "p")


@query("SELECT a.j AS a, b.j AS b, round(corr(a.v, b.v), 6) AS r FROM vectors a JOIN vectors b ON a.vec_id = b.vec_id AND a.j < b.j GROUP BY 1, 2", use="vectors")
def pairwise_corr(spark, sf):
    return _r(A.pairwise_corr(table(spark, sf, "embeddings"), "embedding"), 6, "r")


@query(
    "WITH z AS (SELECT label, vec_id, j, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM vectors WINDOW w AS (PARTITION BY vec_id)), s AS (SELECT label, j, sum(z) AS s FROM z GROUP BY 1, 2), "
    "sc AS (SELECT z.label, vec_id, sum(z * s) / 64 AS score FROM z JOIN s USING (label, j) GROUP BY 1, 2), t AS (SELECT label, arg_max(vec_id, (round(score, 9), -vec_id)) AS ref FROM sc GROUP BY 1), "
    "c AS (SELECT z.label, z.vec_id, ref, sum(z.z * r.z) / 64 AS corr FROM z JOIN t USING (label) JOIN z r ON r.vec_id = ref AND r.j = z.j GROUP BY 1, 2, 3) "
    "SELECT label, vec_id, round(corr, 6) AS corr, ref, row_number() OVER (PARTITION BY label ORDER BY round(corr, 9), vec_id) - 1 AS place FROM c",
    use="vectors",
)
def order_by_similarity(spark, sf):
    return _r(A.order_by_similarity(vectors(spark, sf), ["label"], "vec_id", "j", "v"), 6, "corr")


@query(
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity_norm, "
    "round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice_norm FROM lineitem"
)
def dataset_norm(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = A.dataset_norm(l, [], ["l_quantity"], ["l_extendedprice"])
    return _r(out, 6, "l_quantity_norm", "l_extendedprice_norm").drop("l_quantity", "l_extendedprice")


@query(
    "WITH p AS (SELECT quality::DOUBLE AS y, n_chars / 2000.0::DOUBLE AS p, lang FROM documents JOIN labels USING (doc_id)) SELECT lang, CASE WHEN isnan(corr(y, p)) THEN NULL ELSE round(corr(y, p), 6) END AS cc, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, "
    "round(avg(abs(y::INTEGER - (p > 0.5)::INTEGER)), 6) AS binary_error FROM p GROUP BY 1"
)
def score_predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / F.lit(2000.0)).alias("p"))
    d = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return _r(A.score_predictions(d, ["lang"], "y", "p"), 6, "cc", "mse", "mae", "binary_error")


@query("SELECT l_returnflag, round(1 - var_pop(l_extendedprice - 1500 * l_quantity) / nullif(var_pop(l_extendedprice), 0), 6) AS explained FROM lineitem GROUP BY 1")
def explained_fraction(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("fit", 1500 * F.col("l_quantity"))
    return _r(A.explained_fraction(l, ["l_returnflag"], "l_extendedprice", "fit"), 6, "explained")


@query(
    "WITH s AS (SELECT o_custkey AS c_custkey, o_totalprice / 20 AS sx, (o_orderkey % 30000)::DOUBLE AS sy FROM orders), m AS (SELECT c_custkey, median(sx) AS mx, median(sy) AS my FROM s GROUP BY 1), "
    "g AS (SELECT c_custkey, median(sx) AS gx, median(sy) AS gy FROM s WHERE abs(sx) <= 20000 AND abs(sy) <= 20000 GROUP BY 1), "
    "f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN mx + 10 ELSE c_acctbal END AS x, CASE WHEN c_custkey % 4 = 0 THEN my - 10 ELSE 5000 END AS y FROM customer LEFT JOIN m USING (c_custkey)), "
    "d AS (SELECT f.*, mx, my, gx, gy, coalesce(abs(mx - x) > 200 OR abs(my - y) > 200, false) AS far FROM f LEFT JOIN m USING (c_custkey) LEFT JOIN g USING (c_custkey)) "
    "SELECT c_custkey, round(CASE WHEN far THEN coalesce(gx, mx) ELSE x END, 6) AS x, round(CASE WHEN far THEN coalesce(gy, my) ELSE y END, 6) AS y, far AS replaced FROM d"
)
def retinal_position_fallback(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") / 20).alias("sx"), (F.col("o_orderkey") % 30000).cast("double").alias("sy"))
    m = s.groupBy("c_custkey").agg(F.percentile("sx", F.lit(0.5)).alias("mx"), F.percentile("sy", F.lit(0.5)).alias("my"))
    c = table(spark, sf, "customer").join(m, "c_custkey", "left")
    near = F.col("c_custkey") % 4 == 0
    f = c.select("c_custkey", F.when(near, F.col("mx") + 10).otherwise(F.col("c_acctbal")).alias("x"), F.when(near, F.col("my") - 10).otherwise(F.lit(5000.0)).alias("y"))
    return _r(A.retinal_position_fallback(f, s, ["c_custkey"]), 6, "x", "y")
