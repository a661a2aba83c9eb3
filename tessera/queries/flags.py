"""Queries for predicates, flags and case classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as P
from .fixtures import clicks, samples, table, triggers
from .registry import query


@query(
    "SELECT c.user_id, count(*) AS n, (count(*) % 3 = 0)::INTEGER AS repeated_flag, (count(*) = 12)::INTEGER AS single_flag FROM clicks c GROUP BY 1",
    use="clicks",
)
def trigger_count_flag(spark, sf):
    n = clicks(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select(
        "user_id", "n",
        P.trigger_count_flag(F.col("n"), F.lit(3), F.lit(1)).alias("repeated_flag"),
        P.trigger_count_flag(F.col("n"), F.lit(12), F.lit(0)).alias("single_flag"),
    )


@query(
    "SELECT c_custkey, coalesce(f, 0)::INTEGER AS trace_flag FROM customer LEFT JOIN "
    "(SELECT o_custkey, min((o_totalprice > 20000)::INTEGER) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def trace_valid_flag(spark, sf):
    # A price up to 20 000 has no logarithm here: the sample is missing and the trace is not valid.
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("t"), F.try_divide(F.lit(1.0), F.greatest(F.col("o_totalprice") - 20000, F.lit(0.0))).alias("y")
    )
    return P.trace_valid_flag(table(spark, sf, "customer"), o, ["c_custkey"])


@query(
    "WITH s AS (SELECT user_id, min(t) AS s0, max(t) AS s1 FROM samples WHERE i >= 5 GROUP BY 1), "
    "g AS (SELECT user_id, min(t) AS g0, max(t) AS g1 FROM clicks GROUP BY 1) "
    "SELECT s.user_id, coalesce(g0 >= s0 AND g1 <= s1, false)::INTEGER AS trigger_flag FROM s LEFT JOIN g USING (user_id)",
    use="samples clicks",
)
def triggers_inside_flag(spark, sf):
    return P.triggers_inside_flag(samples(spark, sf).filter("i >= 5"), clicks(spark, sf), ["user_id"])


_QI = (
    "SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') / 30 AS qa, "
    "avg(value) FILTER (WHERE event_type = 'view' AND value > 100) / 150 AS qb FROM events GROUP BY 1"
)


def _qualities(spark, sf):
    ev = table(spark, sf, "events")
    users = ev.select("user_id").distinct()
    qa = ev.filter("event_type = 'click'").groupBy("user_id").agg((F.avg("value") / 30).alias("qa"))
    qb = ev.filter("event_type = 'view' and value > 100").groupBy("user_id").agg((F.avg("value") / 150).alias("qb"))
    one = P.quality_flag(users, qa, ["user_id"], "qa", 1.0, "q_gchirp")
    return P.quality_flag(one, qb, ["user_id"], "qb", 1.0, "q_lchirp")


_FLAGS = (
    f"WITH q AS ({_QI}), f AS (SELECT user_id, CASE WHEN qa IS NULL THEN -1 WHEN qa >= 1 THEN 1 ELSE 0 END AS q_gchirp, "
    "CASE WHEN qb IS NULL THEN -1 WHEN qb >= 1 THEN 1 ELSE 0 END AS q_lchirp FROM q) "
)


@query(_FLAGS + "SELECT * FROM f")
def quality_flag(spark, sf):
    return _qualities(spark, sf)


@query(_FLAGS + "SELECT user_id, (q_gchirp = 1 OR q_lchirp = 1)::INTEGER AS q_or, (q_gchirp = 1 AND q_lchirp = 1)::INTEGER AS q_and FROM f")
def quality_total(spark, sf):
    both = ["q_gchirp", "q_lchirp"]
    return _qualities(spark, sf).select("user_id", P.quality_total(both, "or").alias("q_or"), P.quality_total(both, "and").alias("q_and"))


@query(
    "WITH s AS (SELECT user_id, min(value) AS p, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view' AND value > 100) AS b, "
    "avg(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY 1) SELECT user_id, "
    "((p <= 0.3)::INTEGER::DOUBLE + coalesce(a >= 40 AND coalesce(b >= 150, true) AND c >= 40, false)::INTEGER::DOUBLE "
    "+ coalesce(a <= 60 AND coalesce(b <= 200, true) AND c <= 60, false)::INTEGER::DOUBLE) / 3 AS q FROM s"
)
def model_quality_fraction(spark, sf):
    def mean(kind, more="true"):
        return F.avg(F.when((F.col("event_type") == kind) & F.expr(more), F.col("value")))

    s = table(spark, sf, "events").groupBy("user_id").agg(
        F.min("value").alias("p"), mean("click").alias("a"), mean("view", "value > 100").alias("b"), mean("error").alias("c")
    )
    corr = [F.col("a") / 100, F.col("b") / 100 - 1.1, F.col("c") / 100]
    mse = [F.col("a"), F.col("b") - 140, F.col("c")]
    q = P.model_quality_fraction(
        F.col("p"), {"corr": [F.coalesce(corr[0], F.lit(0.0)), corr[1], F.coalesce(corr[2], F.lit(0.0))], "mse": [F.coalesce(mse[0], F.lit(1e9)), mse[1], F.coalesce(mse[2], F.lit(1e9))]},
        perm_alpha=0.3, min_corr=0.4, max_mse=60.0,
    )
    return s.select("user_id", q.alias("q"))


_RF = (
    "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS main_peak_lag, l_extendedprice / 500 AS rf_cdia_um, "
    "1 - l_tax * 5 AS split_qidx, 1 - l_discount * 5 AS rf_qidx, 1 - l_discount AS largest_contour_ratio FROM lineitem"
)


def _rf(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("main_peak_lag"), (F.col("l_extendedprice") / 500).alias("rf_cdia_um"),
        (1 - F.col("l_tax") * 5).alias("split_qidx"), (1 - F.col("l_discount") * 5).alias("rf_qidx"), (1 - F.col("l_discount")).alias("largest_contour_ratio"),
    )


@query(
    f"WITH rf AS ({_RF}), ok AS (SELECT * FROM rf WHERE main_peak_lag <= 0.5 AND rf_cdia_um BETWEEN 20 AND 150 AND split_qidx > 0.72) "
    "SELECT 'gauss' AS kind, l_orderkey, l_linenumber FROM ok WHERE rf_qidx > 0.77 UNION ALL "
    "SELECT 'contour', l_orderkey, l_linenumber FROM ok WHERE largest_contour_ratio >= 0.945 UNION ALL "
    "SELECT 'none', l_orderkey, l_linenumber FROM rf WHERE main_peak_lag <= 0.5"
)
def rf_quality_filter(spark, sf):
    from ..operators.keys import union_all

    out = {k: P.rf_quality_filter(_rf(spark, sf), k, 0.5, (20.0, 150.0), 0.72, 0.77, 0.945) for k in ("gauss", "contour", "none")}
    return union_all(out, "kind").select("kind", "l_orderkey", "l_linenumber")


@query(
    "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%soma%' THEN 'soma' WHEN lower(p_name) LIKE '%stack%' THEN 'stack' WHEN lower(p_name) LIKE '%field%' THEN 'field' "
    "WHEN lower(p_name) LIKE 'd%' THEN 'roi' ELSE 'other' END AS kind_by_name, "
    "CASE WHEN lower(p_type) LIKE '%dard%' THEN 'standard' WHEN lower(p_type) LIKE 'p%' THEN 'promo' ELSE 'rest' END AS kind_by_type FROM "
    "(SELECT p_partkey, p_type, CASE p_partkey % 4 WHEN 0 THEN 'Soma_' WHEN 1 THEN 'D' WHEN 2 THEN 'ZStack' ELSE '' END || p_name AS p_name FROM part)"
)
def roi_kind(spark, sf):
    prefix = F.expr("case p_partkey % 4 when 0 then 'Soma_' when 1 then 'D' when 2 then 'ZStack' else '' end")
    by_type = P.name_kind(F.col("p_type"), [("dard", "standard"), ("^p", "promo")], "rest")
    return table(spark, sf, "part").select(
        "p_partkey", P.roi_kind(F.concat(prefix, F.col("p_name"))).alias("kind_by_name"), by_type.alias("kind_by_type")
    )


_POS = "SELECT c_custkey, c_acctbal - 5000 AS tn, (c_custkey % 1000 - 500) * 10.0::DOUBLE AS vd FROM customer"


def _positions(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") - 5000).alias("tn"), ((F.col("c_custkey") % 1000 - 500) * F.lit(10.0)).alias("vd")
    )


@query(
    f"WITH p AS ({_POS}), s AS (SELECT c_custkey, CASE WHEN tn < -500 THEN 't' WHEN tn > 500 THEN 'n' ELSE 'c' END AS nt_side, "
    "CASE WHEN vd < -500 THEN 'v' WHEN vd > 500 THEN 'd' ELSE 'c' END AS vd_side FROM p) "
    "SELECT *, nt_side || vd_side AS ntvd_side, CASE WHEN nt_side = 't' THEN nt_side || vd_side ELSE nt_side END AS n_tvd_side, "
    "CASE WHEN nt_side = 'n' THEN nt_side || vd_side ELSE nt_side END AS nvd_t_side FROM s"
)
def quadrant_category(spark, sf):
    return _positions(spark, sf).select("c_custkey", *[c.alias(n) for n, c in P.quadrant_category(F.col("tn"), F.col("vd"), 500.0).items()])


@query(
    f"WITH p AS ({_POS}) SELECT c_custkey, CASE WHEN sqrt(tn * tn + vd * vd) < 1000 THEN 'c' WHEN tn > vd AND -tn < vd THEN 'n' "
    "WHEN tn > vd THEN 'v' WHEN -tn < vd THEN 'd' ELSE 't' END AS wing_side FROM p"
)
def wing_category(spark, sf):
    return _positions(spark, sf).select("c_custkey", P.wing_category(F.col("tn"), F.col("vd"), 1000.0).alias("wing_side"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'goods' WHEN 'MACHINERY' THEN 'goods' ELSE 'home' END AS grp FROM customer")
def regroup(spark, sf):
    groups = {"AUTOMOBILE": "goods", "MACHINERY": "goods", "BUILDING": "home", "FURNITURE": "home", "HOUSEHOLD": "home"}
    return table(spark, sf, "customer").select("c_custkey", P.regroup(F.col("c_mktsegment"), groups).alias("grp"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars "
    "FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000000 AS p FROM lineitem)"
)
def significance_stars(spark, sf):
    p = F.col("l_extendedprice") / 1000000
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.significance_stars(p).alias("stars"))


@query(
    "SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS w_qidx, max(value) FILTER (WHERE event_type = 'click') AS g_qidx, "
    "max(value) FILTER (WHERE event_type = 'error') AS b_qidx, count(*) FILTER (WHERE event_type = 'signup') AS n_reps, avg(value) AS qidx FROM events GROUP BY 1 "
    "HAVING w_qidx > 120 AND (g_qidx > 120 OR b_qidx > 120) AND n_reps >= 10 AND qidx > 45"
)
def response_filter(spark, sf):
    ev = table(spark, sf, "events")

    def best(kind, name):
        return ev.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias(name))

    reps = ev.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n_reps"))
    chirp = ev.groupBy("user_id").agg(F.avg("value").alias("qidx"))
    joined = best("view", "w_qidx").join(best("click", "g_qidx"), "user_id", "left").join(best("error", "b_qidx"), "user_id", "left")
    joined = joined.join(reps, "user_id").join(chirp, "user_id")
    return P.response_filter(joined, 120.0, 10, 45.0)


@query(
    f"WITH p AS ({_POS}) SELECT c_custkey, CASE WHEN tn < 0 AND vd < 1000 THEN 't' WHEN tn > 0 THEN 'n' ELSE 'k' END AS region FROM p"
)
def region_split(spark, sf):
    boxes = {"t": {"tn": (None, 0.0), "vd": (None, 1000.0)}, "n": {"tn": (0.0, None)}}
    return _positions(spark, sf).select("c_custkey", P.region_split(boxes, "k").alias("region"))


@query(
    "SELECT k AS o_orderkey, coalesce(bool_and(q = floor(q) AND q > 0) AND sum(q) = 100 * (k % 2) + 50, false) AS valid "
    "FROM (SELECT l_orderkey AS k, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY k"
)
def validate_trial_info(spark, sf):
    # One trial per line number of an order, so that the lists stay short.
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.max("l_quantity").alias("ntrigger"))
    trial = F.struct(F.col("l_linenumber").cast("string").alias("name"), "ntrigger")
    l = l.groupBy("o_orderkey").agg(F.collect_list(trial).alias("trials"))
    per_rep = 100 * (F.col("o_orderkey") % 2) + 50
    return l.select("o_orderkey", P.validate_trial_info(F.col("trials"), per_rep).alias("valid"))
