"""Queries for scalar, string, array and normalisation functions, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from .fixtures import pixels, samples, table, vectors
from .registry import query


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 20")
def ordered_fetch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_neg"))
    return S.ordered_fetch(o, ["_neg", "o_orderkey"], 20).drop("_neg")


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag, l_linestatus DESC, l_orderkey, l_linenumber")
def sort_levels(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return S.sort_levels(l, "l_returnflag", "-l_linestatus", "l_orderkey", "l_linenumber")


@query(
    "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3"
)
def largest_first(spark, sf):
    from ..operators.stats import largest_first as lf

    return lf(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", ["c_custkey"], 3)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 10")
def random_rows(spark, sf):
    return S.random_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 10, 7)




def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("j"), F.length("text").cast("double").alias("y"))


@query(
    "WITH v AS (SELECT conv_id, turn AS j, length(text)::DOUBLE AS y FROM conversations), n AS (SELECT conv_id, max(j) + 1 AS n FROM v GROUP BY 1) SELECT conv_id, j, y FROM v WHERE j < (SELECT min(n) FROM n)"
)
def stack_rows_truncate(spark, sf):
    return S.stack_rows(_turns(spark, sf), ["conv_id"], "j", "y", "truncate", rtol=10.0)


@query(
    "WITH v AS (SELECT conv_id, turn AS j, length(text)::DOUBLE AS y FROM conversations), n AS (SELECT conv_id, max(j) + 1 AS n FROM v GROUP BY 1), g AS (SELECT conv_id, unnest(range((SELECT max(n) FROM n))) AS j, n FROM n) "
    "SELECT conv_id, j, y FROM v UNION ALL SELECT conv_id, j, NULL FROM g WHERE j >= n"
)
def stack_rows_pad(spark, sf):
    return S.stack_rows(_turns(spark, sf), ["conv_id"], "j", "y", "pad")


@query(
    "SELECT user_id, i, round((y - mi) / nullif(ma - mi, 0), 8) AS zero_one, round(y / am, 8) AS amp_one, round(y / sd, 8) AS std_one, round((y - av) / sd, 8) AS zscore FROM samples "
    "JOIN (SELECT user_id, min(y) AS mi, max(y) AS ma, max(abs(y)) AS am, stddev_pop(y) AS sd, avg(y) AS av FROM samples GROUP BY 1) USING (user_id)",
    use="samples",
)
def normalize(spark, sf):
    out = samples(spark, sf)
    kinds = ("zero_one", "amp_one", "std_one", "zscore")
    for k in kinds:
        out = S.normalize(out, ["user_id"], "y", k, k)
    return out.select("user_id", "i", *[F.round(k, 8).alias(k) for k in kinds])


@query(
    "SELECT user_id, i, round(least(greatest((y - lo) / nullif(abs(hi - lo), 0), 0), 1), 8) AS scaled FROM samples JOIN "
    "(SELECT user_id, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM samples GROUP BY 1) USING (user_id)",
    use="samples",
)
def normalize_soft(spark, sf):
    out = S.normalize_soft(samples(spark, sf), ["user_id"], "y", "scaled")
    return out.select("user_id", "i", F.round("scaled", 8).alias("scaled"))


@query(
    "WITH a AS (SELECT vec_id, x, y, greatest(v - lo, 0) AS f FROM pixels JOIN (SELECT vec_id, quantile_cont(v, 0.05) AS lo FROM pixels GROUP BY 1) USING (vec_id)) "
    "SELECT vec_id, x, y, round(least(f / nullif(hi, 0), 1), 8) AS v FROM a JOIN (SELECT vec_id, quantile_cont(f, 0.9995) AS hi FROM a GROUP BY 1) USING (vec_id)",
    use="pixels",
)
def normalize_stack(spark, sf):
    out = S.normalize_stack(pixels(spark, sf).withColumnRenamed("v", "raw"), ["vec_id"], "raw", "v")
    return out.select("vec_id", "x", "y", F.round("v", 8).alias("v"))


@query(
    "SELECT user_id, i, round(CASE WHEN b THEN 2 * s - 1 ELSE (s - m) / nullif(sd, 0) END, 8) AS s FROM "
    "(SELECT user_id, i, CASE WHEN user_id % 2 = 0 THEN (event_type = 'click')::INTEGER::DOUBLE ELSE y END AS s FROM typed_samples) JOIN "
    "(SELECT user_id, user_id % 2 = 0 AND max((event_type = 'click')::INTEGER) = 1 AND min((event_type = 'click')::INTEGER) = 0 AS b, "
    "avg(CASE WHEN user_id % 2 = 0 THEN (event_type = 'click')::INTEGER::DOUBLE ELSE y END) AS m, "
    "stddev_pop(CASE WHEN user_id % 2 = 0 THEN (event_type = 'click')::INTEGER::DOUBLE ELSE y END) AS sd FROM typed_samples GROUP BY 1) USING (user_id)",
    use="typed_samples",
)
def normalize_stimulus(spark, sf):
    from .fixtures import typed_samples

    s = F.when(F.col("user_id") % 2 == 0, (F.col("event_type") == "click").cast("double")).otherwise(F.col("y"))
    out = S.normalize_stimulus(typed_samples(spark, sf).withColumn("s", s), ["user_id"], "s", "s")
    return out.select("user_id", "i", F.round("s", 8).alias("s"))


_POS = "(SELECT c_custkey, c_acctbal AS x, (c_custkey % 997)::DOUBLE AS y, (c_custkey % 7) * 30.0::DOUBLE AS rot, CASE c_custkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS eye FROM customer)"


def _pos(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("x"), (k % 997).cast("double").alias("y"), ((k % 7) * F.lit(30.0)).alias("rot"),
        F.when(k % 3 == 0, "left").when(k % 3 == 1, "right").otherwise("unknown").alias("eye"),
    )


@query(
    f"SELECT c_custkey, round(cos(radians(22.1)) * (x - 10) - sin(radians(22.1)) * (y - 20) + 10 + 3, 6) + 0.0 AS rx, "
    f"round(sin(radians(22.1)) * (x - 10) + cos(radians(22.1)) * (y - 20) + 20 - 4, 6) + 0.0 AS ry FROM {_POS}"
)
def rotate(spark, sf):
    rx, ry = S.rotate(F.col("x"), F.col("y"), 22.1, 10.0, 20.0, 3.0, -4.0)
    return _pos(spark, sf).select("c_custkey", (F.round(rx, 6) + 0.0).alias("rx"), (F.round(ry, 6) + 0.0).alias("ry"))


@query(
    f"SELECT c_custkey, round(-(x * cos(radians(rot)) + y * sin(radians(rot))), 6) + 0.0 AS vd, "
    "CASE eye WHEN 'right' THEN round(-x * sin(radians(rot)) + y * cos(radians(rot)), 6) + 0.0 "
    f"WHEN 'left' THEN round(x * sin(radians(rot)) - y * cos(radians(rot)), 6) + 0.0 END AS tn FROM {_POS}"
)
def anatomical_position(spark, sf):
    vd, tn = S.anatomical_position(F.col("x"), F.col("y"), F.col("rot"), F.col("eye"))
    return _pos(spark, sf).select("c_custkey", (F.round(vd, 6) + 0.0).alias("vd"), (F.round(tn, 6) + 0.0).alias("tn"))


@query(
    "SELECT c_custkey, round(c_acctbal - s.bal, 6) AS rel FROM customer JOIN (SELECT s_nationkey, avg(s_acctbal) AS bal FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey"
)
def relative_position(spark, sf):
    o = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg("s_acctbal").alias("bal"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return S.relative_position(c, o, ["c_nationkey"], {"rel": ("c_acctbal", "bal")}).select("c_custkey", F.round("rel", 6).alias("rel"))


@query(
    "WITH o AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) "
    "SELECT c_custkey, coalesce(p, f, CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS pos, CASE WHEN p IS NOT NULL THEN 'pre' WHEN f IS NOT NULL THEN 'raw' ELSE 'header' END AS source_name "
    "FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE coalesce(p, f, CASE WHEN c_acctbal > 0 THEN c_acctbal END) IS NOT NULL"
)
def disc_position(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")

    def top(s):
        return o.filter(F.col("o_orderstatus") == s).groupBy("c_custkey").agg(F.max("o_totalprice").alias("pos"))

    head = c.filter("c_acctbal > 0").withColumnRenamed("c_acctbal", "pos")
    return S.first_available(c.select("c_custkey"), ["c_custkey"], {"pre": top("P"), "raw": top("F"), "header": head}, ["pos"])


@query(
    "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 112.0::DOUBLE ELSE 71.5::DOUBLE END / p_size / (0.5 + (p_partkey % 7) / 2.0::DOUBLE), 10) AS um FROM part"
)
def pixel_size(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(S.pixel_size((k % 3 + 1).cast("int"), F.col("p_size"), 0.5 + (k % 7) / 2.0), 10).alias("um"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN nx > 1 AND ny > 1 AND nz <= 1 THEN 'xy' WHEN nx > 1 AND ny <= 1 AND nz > 1 THEN 'xz' WHEN nx > 1 AND ny > 1 AND nz > 1 THEN 'xyz' END AS kind "
    "FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS nx, l_suppkey % 3 AS ny, l_linenumber % 3 AS nz FROM lineitem)"
)
def scan_type(spark, sf):
    kind = S.scan_type(F.col("l_partkey") % 4, F.col("l_suppkey") % 3, F.col("l_linenumber") % 3)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query(
    "SELECT p_partkey, round(l, 12) AS line_duration, round(l * ny, 12) AS scan_period, round(1 / nullif(l * ny, 0), 6) AS scan_frequency FROM "
    "(SELECT p_partkey, p_size * p_retailprice * 1e-6::DOUBLE AS l, p_partkey % 20 AS ny FROM part)"
)
def scan_rate(spark, sf):
    r = S.scan_rate(F.col("p_size"), F.col("p_partkey") % 20, F.col("p_retailprice"))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(r["line_duration"], 12).alias("line_duration"), F.round(r["scan_period"], 12).alias("scan_period"), F.round(r["scan_frequency"], 6).alias("scan_frequency")
    )


@query(
    "SELECT user_id, i, round(CASE WHEN a > 250 AND b > 1000 THEN t / 500 ELSE t END, 9) AS t FROM samples JOIN (SELECT user_id, min(t) AS a, max(t) AS b FROM samples GROUP BY 1) USING (user_id)",
    use="samples",
)
def trigger_units(spark, sf):
    return S.trigger_units(samples(spark, sf), ["user_id"]).select("user_id", "i", F.round("t", 9).alias("t"))


@query("SELECT o_orderkey, round(2 * sqrt(o_totalprice / pi()), 8) AS d FROM orders")
def equiv_diameter(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.equiv_diameter(F.col("o_totalprice")), 8).alias("d"))


@query(
    "SELECT vec_id, round(dx, 8) AS dx_um, round(dy, 8) AS dy_um, round(sqrt(dx * dx + dy * dy), 8) AS d_um FROM (SELECT vec_id, (cx + 0.5 - 4) * 30.0::DOUBLE + 5 AS dx, (cy + 0.5 - 4) * 30.0::DOUBLE AS dy FROM "
    "(SELECT vec_id, sum(x * abs(v)) / sum(abs(v)) AS cx, sum(y * abs(v)) / sum(abs(v)) AS cy FROM pixels GROUP BY 1))",
    use="pixels",
)
def offset_from_centre(spark, sf):
    w = F.abs(F.col("v"))
    c = pixels(spark, sf).groupBy("vec_id").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"))
    o = S.offset_from_centre(F.col("cx"), F.col("cy"), 8, 8, 30.0, dx=5.0)
    return c.select("vec_id", *[F.round(e, 8).alias(n) for n, e in o.items()])


@query(
    "SELECT l_orderkey, l_linenumber, round(l_quantity * p_size, 6) AS x_um, round(l_linenumber * p_retailprice, 6) AS z_um FROM lineitem JOIN part ON p_partkey = l_partkey"
)
def stack_to_um(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("z"))
    out = S.stack_to_um(l, table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], {"x": "p_size", "z": "p_retailprice"})
    return out.select("l_orderkey", "l_linenumber", F.round("x_um", 6).alias("x_um"), F.round("z_um", 6).alias("z_um"))


@query(
    "SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[5] AS page, regexp_replace(url, '[?#].*$', '') AS bare, contains(url, '/en/') AS english, "
    "CASE WHEN ends_with(url, '#top') THEN url[:length(url) - 4] ELSE url END AS no_suffix FROM pages"
)
def string_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", S.name_part(u, "/", 2).alias("host"), S.name_part(u, "/", 4).alias("page"), F.regexp_replace(u, "[?#].*$", "").alias("bare"),
        u.contains("/en/").alias("english"), S.strip_suffix(u, "#top").alias("no_suffix"),
    )


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_custkey::INTEGER AS number FROM orders")
def date_parts(spark, sf):
    ident = F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), "o_custkey")
    parts = S.date_parts(F.col("ident"))
    return table(spark, sf, "orders").withColumn("ident", ident).select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    "SELECT c.name, m.balance FROM (SELECT c_name || CASE WHEN c_custkey % 3 = 0 THEN '_roi' ELSE '' END AS name, c_name FROM customer) c LEFT JOIN "
    "(SELECT c_name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) m ON m.c_name = c.c_name"
)
def copy_parent_metrics(spark, sf):
    c = table(spark, sf, "customer")
    named = c.select(F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_roi").otherwise("")).alias("name"))
    m = c.filter("c_acctbal > 0").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return S.copy_parent_metrics(named, m, "name", "_roi")


@query(
    "SELECT event_id, round(1 / (1 + exp(-x)), 10) AS p, round(2 / pow(1 + 0.5::DOUBLE * exp(-1.5::DOUBLE * (x - 0.25::DOUBLE)), 1 / exp(0.7::DOUBLE)), 10) AS g FROM (SELECT event_id, (value - 50) / 50 AS x FROM events)"
)
def logistic(spark, sf):
    x = (F.col("value") - 50) / 50
    return table(spark, sf, "events").select("event_id", F.round(S.logistic(x), 10).alias("p"), F.round(S.sigmoid5(x, 2.0, 0.5, 1.5, 0.7, 0.25), 10).alias("g"))


@query(
    "SELECT l_orderkey, l_linenumber, round(1 / nullif(1 - l_discount, 0), 10) AS z, round(1 - 1 / (1 / (1 - l_discount) - 0.1::DOUBLE), 10) AS lower FROM lineitem"
)
def skew_transform(spark, sf):
    z = S.skew_transform(F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(z, 10).alias("z"), F.round(S.skew_inverse(z - 0.1), 10).alias("lower"))


@query(
    "SELECT l_returnflag, round(0.3::DOUBLE * abs(avg(pow(a - b, 2))) / 2 + 0.7::DOUBLE * (1 - corr(a, b)), 6) AS loss FROM "
    "(SELECT l_returnflag, l_extendedprice / 1000 AS a, l_quantity * 2 AS b FROM lineitem) GROUP BY 1"
)
def mixed_loss(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("a"), (F.col("l_quantity") * 2).alias("b"))
    return l.groupBy("l_returnflag").agg(F.round(S.mixed_loss("a", "b", 0.3), 6).alias("loss"))


@query(
    "WITH w AS (SELECT c_nationkey, c_custkey, CASE WHEN d > 4000 THEN 0 ELSE exp(-0.5::DOUBLE * pow(d / 1500, 2)) END AS w FROM (SELECT *, abs(c_acctbal - 5000) AS d FROM customer)) "
    "SELECT c_custkey, round(CASE WHEN s > 0 THEN w / s ELSE w END, 12) AS w FROM w JOIN (SELECT c_nationkey, sum(w) AS s FROM w GROUP BY 1) USING (c_nationkey)"
)
def radial_profile(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("d"))
    out = S.normalized_weights(c, ["c_nationkey"], S.radial_profile(F.col("d"), 1500.0, 4000.0), "w")
    return out.select("c_custkey", F.round("w", 12).alias("w"))


@query(
    "WITH z AS (SELECT c_nationkey, c_custkey, CASE WHEN d <= 1500 THEN pow(0.5 * cos(d * pi() / 1500) + 0.5, 1) WHEN d <= 5500 THEN -pow(0.5 * cos((d - 1500) * pi() / 2000 + pi()) + 0.5, 2) ELSE 0 END AS z "
    "FROM (SELECT *, abs(c_acctbal - 5000) AS d FROM customer)), t AS (SELECT c_nationkey, sum(greatest(z, 0)) AS p, sum(greatest(-z, 0)) AS n FROM z GROUP BY 1) "
    "SELECT c_custkey, round(CASE WHEN z > 0 THEN z / p WHEN z < 0 THEN z * 0.5 / n ELSE 0 END, 10) + 0.0 AS w FROM z JOIN t USING (c_nationkey)"
)
def center_surround_profile(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("d"))
    out = S.center_surround_profile(c, ["c_nationkey"], "d", "w", 1500.0, 1.0, 2000.0, 2.0, 1.0, 0.5)
    return out.select("c_custkey", (F.round("w", 10) + 0.0).alias("w"))


_BOX = "SELECT c_nationkey, min(c_acctbal) / 100 AS x0, max(c_acctbal) / 100 AS x1, -(count(*)::DOUBLE) AS y0, count(*)::DOUBLE AS y1 FROM customer GROUP BY 1"


def _boxes(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        (F.min("c_acctbal") / 100).alias("x0"), (F.max("c_acctbal") / 100).alias("x1"),
        (-F.count("*").cast("double")).alias("y0"), F.count("*").cast("double").alias("y1"),
    )


@query(
    f"WITH b AS ({_BOX}), n AS (SELECT c_nationkey, floor((x1 - x0 - 4) / 8)::BIGINT AS n FROM b), g AS (SELECT c_nationkey, n, unnest(range(n)) AS a FROM n), "
    "h AS (SELECT *, unnest(range(n)) AS b FROM g) SELECT c_nationkey, round((a - (n - 1) / 2.0::DOUBLE) * 8, 6) + 0.0 AS cx, round((b - (n - 1) / 2.0::DOUBLE) * 8, 6) + 0.0 AS cy FROM h"
)
def square_grid(spark, sf):
    g = S.square_grid(_boxes(spark, sf), ["c_nationkey"], 8.0, 2.0)
    return g.select("c_nationkey", (F.round("cx", 6) + 0.0).alias("cx"), (F.round("cy", 6) + 0.0).alias("cy"))


@query(
    f"WITH b AS ({_BOX}), s AS (SELECT sqrt(80 / (2 * sqrt(3.0::DOUBLE))) AS ri, sqrt(80 / (2 * sqrt(3.0::DOUBLE))) * 2 / sqrt(3.0::DOUBLE) AS ru), "
    "k AS (SELECT b.*, ri, ru, ceil((y0 + ru) / ri)::BIGINT AS k0, floor((y1 - ru) / ri)::BIGINT AS k1 FROM b, s), "
    "r AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM k), f AS (SELECT *, CASE WHEN (k - k0) % 2 = 0 THEN 0 ELSE 1.5::DOUBLE * ru END AS first FROM r), "
    "c AS (SELECT *, unnest(range(ceil((x0 + ru - first) / (3 * ru))::BIGINT, floor((x1 - ru - first) / (3 * ru))::BIGINT + 1)) AS j FROM f) "
    "SELECT c_nationkey, round(j * 3 * ru + first, 6) + 0.0 AS cx, round(k * ri, 6) + 0.0 AS cy FROM c"
)
def hex_grid(spark, sf):
    g = S.hex_grid(_boxes(spark, sf), ["c_nationkey"], 80.0)
    return g.select("c_nationkey", (F.round("cx", 6) + 0.0).alias("cx"), (F.round("cy", 6) + 0.0).alias("cy"))


@query(
    f"WITH b AS ({_BOX}), n AS (SELECT c_nationkey, x0, y0, sqrt(80 / (2 * sqrt(3.0::DOUBLE))) AS ri FROM b), "
    "h AS (SELECT *, ri * 2 / sqrt(3.0::DOUBLE) AS ru FROM n), c AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS corner FROM h) "
    "SELECT c_nationkey, corner::INTEGER AS corner, round(x0 + [-ru / 2, ru / 2, ru, ru / 2, -ru / 2, -ru][corner + 1], 6) + 0.0 AS hx, "
    "round(y0 + [ri, ri, 0, -ri, -ri, 0][corner + 1], 6) + 0.0 AS hy FROM c"
)
def hex_corners(spark, sf):
    b = _boxes(spark, sf).select("c_nationkey", F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    h = S.hex_corners(b, 80.0)
    return h.select("c_nationkey", "corner", (F.round("hx", 6) + 0.0).alias("hx"), (F.round("hy", 6) + 0.0).alias("hy"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[64]::DOUBLE AS e63, embedding[65]::DOUBLE AS e64 FROM embeddings")
def array_pick(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", *[S.array_pick(e, i).cast("double").alias(f"e{i}") for i in (0, 63, 64)])


@query(
    "SELECT vec_id, j, v AS a, v * 2 AS b FROM vectors WHERE j < 64 - vec_id % 5", use="vectors",
)
def explode_zip(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    e = e.withColumn("b", F.transform(F.slice("a", F.lit(1), (64 - F.col("vec_id") % 5).cast("int")), lambda x: x * 2))
    return S.explode_zip(e, ["vec_id"], ["a", "b"])


@query("SELECT vec_id, vec_id % 9 <> 0 AS present FROM embeddings")
def all_finite(spark, sf):
    arr = F.when(F.col("vec_id") % 9 == 0, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>"))
    return table(spark, sf, "embeddings").select("vec_id", S.all_finite(arr).alias("present"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k')::INTEGER ELSE -1 END AS k FROM events")
def map_get_default(spark, sf):
    m = F.when(F.col("event_type") == "click", F.from_json("props", "map<string,int>")).otherwise(F.from_json(F.lit('{"z": 1}'), "map<string,int>"))
    return table(spark, sf, "events").select("event_id", S.map_get_default(m, "k", -1).alias("k"))
