"""Queries for time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as T
from .fixtures import clicks, samples, table, triggers, typed_samples, vectors
from .registry import query

U = ["user_id"]


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@query(
    "SELECT user_id, round(dt, 3) AS dt, round(greatest(b - dt, dt - a) / dt, 6) AS rel_error, CASE WHEN greatest(b - dt, dt - a) / dt >= 4 THEN 'error' WHEN greatest(b - dt, dt - a) / dt >= 3 THEN 'warning' ELSE 'ok' END AS level "
    "FROM (SELECT user_id, avg(d) AS dt, min(d) AS a, max(d) AS b FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS d FROM samples) GROUP BY 1) WHERE dt IS NOT NULL",
    use="samples",
)
def sampling_step(spark, sf):
    return _r(_r(T.sampling_step(samples(spark, sf), U, 4.0, 3.0), 3, "dt"), 6, "rel_error")


_SCAN = "SELECT p_partkey, p_size AS n_frames, p_retailprice / 100 AS pixel_us, p_partkey % 5 + 3 AS nx, p_partkey % 3 + 1 AS ny FROM part"


def _scan(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("n_frames"), (F.col("p_retailprice") / 100).alias("pixel_us"), (k % 5 + 3).alias("nx"),
        (k % 3 + 1).alias("ny"), F.lit(1).alias("left"), F.lit(1).alias("right"),
    )


@query(f"SELECT p_partkey, frame, round(frame * pixel_us * 1e-6::DOUBLE * nx * ny, 10) AS t FROM (SELECT *, unnest(range(n_frames)) AS frame FROM ({_SCAN}))")
def frame_times(spark, sf):
    return _r(T.frame_times(_scan(spark, sf), ["p_partkey"]), 10, "t")


@query(
    f"SELECT p_partkey, x, y, round(y * nx * pixel_us * 1e-6::DOUBLE, 12) AS \"offset\" FROM (SELECT *, unnest(range(nx - 2)) AS x FROM (SELECT *, unnest(range(ny)) AS y FROM ({_SCAN})))"
)
def pixel_offsets(spark, sf):
    return _r(T.pixel_offsets(_scan(spark, sf), ["p_partkey"]), 12, "offset")


@query(
    "WITH s AS (SELECT *, lag(y) OVER w AS p, (SELECT min(b.i) FROM samples b WHERE b.user_id = a.user_id AND b.i >= a.i AND b.y < 30) AS off FROM samples a WINDOW w AS (PARTITION BY user_id ORDER BY i)), "
    "c AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS pi FROM s WHERE y >= 30 AND p < 30), k AS (SELECT * FROM c WHERE pi IS NULL OR i - pi >= 3), "
    "d AS (SELECT user_id, floor(quantile_cont(coalesce(off - i - 1, 0)::DOUBLE, 0.5))::BIGINT AS dur FROM k GROUP BY 1), "
    "f AS (SELECT s.user_id, greatest(s.off - d.dur, 0) AS i FROM s JOIN d USING (user_id) WHERE s.i = 0 AND s.y >= 30 AND s.off IS NOT NULL), "
    "u AS (SELECT user_id, i, t, y FROM k UNION ALL SELECT f.user_id, f.i, x.t, x.y FROM f JOIN samples x ON x.user_id = f.user_id AND x.i = f.i) "
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k, i, round(t + 0.5, 6) AS t, y AS v FROM u",
    use="samples",
)
def detect_triggers(spark, sf):
    return _r(T.detect_triggers(samples(spark, sf), U, 30.0, 3, 0.5), 6, "t")


_STARTS = (
    "p AS (SELECT g.user_id, k AS rep, g.t AS t0, (SELECT arg_min(s.i, (abs(s.t - g.t - 7200), s.i)) FROM samples s WHERE s.user_id = g.user_id) AS i0 FROM triggers g), "
    "q AS (SELECT *, i0 - lag(i0) OVER (PARTITION BY user_id ORDER BY rep) AS gap, max(rep) OVER (PARTITION BY user_id) AS last, (SELECT count(*) FROM samples s WHERE s.user_id = p.user_id) AS n FROM p), "
    "m AS (SELECT user_id, floor(quantile_cont(gap::DOUBLE, 0.5))::BIGINT AS len FROM q GROUP BY 1), "
    "r AS (SELECT q.*, coalesce(len, n - i0) AS n_frames, rep = last AND n - i0 < coalesce(len, n - i0) AS short FROM q JOIN m USING (user_id)), "
    "starts AS (SELECT user_id, rep, t0, i0, n_frames, max(short::INTEGER) OVER (PARTITION BY user_id) AS dropped_last, short FROM r) "
)


@query(f"WITH {_STARTS} SELECT user_id, rep, round(t0, 6) AS t0, i0, n_frames, dropped_last FROM starts WHERE NOT short", use="samples triggers")
def repetition_starts(spark, sf):
    return _r(T.repetition_starts(samples(spark, sf), triggers(spark, sf), U, 1, delay=7200.0), 6, "t0")


@query(
    f"WITH {_STARTS}, w AS (SELECT user_id, rep, i0, unnest(range(n_frames)) AS j FROM starts WHERE NOT short) "
    "SELECT w.user_id, rep, j, round(s.t, 6) AS t, y FROM w JOIN samples s ON s.user_id = w.user_id AND s.i = w.i0 + j",
    use="samples triggers",
)
def snippet_join(spark, sf):
    s = samples(spark, sf)
    st = T.repetition_starts(s, triggers(spark, sf), U, 1, delay=7200.0)
    return _r(T.snippet_join(st, s, U), 6, "t")


@query(
    f"WITH {_STARTS}, b AS (SELECT user_id, rep, i0, n_frames, (SELECT arg_min(s.i, (abs(s.t - st.t0 + 90000), s.i)) FROM samples s WHERE s.user_id = st.user_id) AS b0, "
    "(SELECT arg_min(s.i, (abs(s.t - st.t0 - 90000), s.i)) FROM samples s WHERE s.user_id = st.user_id) AS b1 FROM starts st WHERE NOT short), "
    "bm AS (SELECT b.user_id, rep, avg(y) AS base FROM b JOIN samples s ON s.user_id = b.user_id AND s.i >= b0 AND s.i < b1 GROUP BY 1, 2), "
    "w AS (SELECT user_id, rep, i0, unnest(range(n_frames)) AS j FROM starts WHERE NOT short) "
    "SELECT w.user_id, w.rep, j, round(s.t, 6) AS t, round(y - base, 6) + 0.0 AS y FROM w JOIN samples s ON s.user_id = w.user_id AND s.i = w.i0 + j JOIN bm ON bm.user_id = w.user_id AND bm.rep = w.rep",
    use="samples triggers",
)
def snippets(spark, sf):
    out = T.snippets(samples(spark, sf), triggers(spark, sf), U, 1, delay=7200.0, base=(-90000.0, 90000.0))
    return _r(out, 6, "t", "y")


_TRIALS = [("W", 2, 2), ("B", 4, 2), ("W", 1, 1)]


def _pieces_sql(delay: float) -> str:
    """Pieces ``c`` of every trial name: first sample ``i0`` and length ``n_frames``, the last one cut."""
    return (
        "WITH p AS (SELECT * FROM (VALUES (0, 'W', 2), (2, 'B', 2), (4, 'B', 2), (6, 'W', 1)) v(o, name, split)), "
        f"hit AS (SELECT g.user_id, k, (SELECT arg_min(s.i, (abs(s.t - (g.t + {delay})), s.i)) FROM samples s WHERE s.user_id = g.user_id) AS si FROM clicks g), "
        "d AS (SELECT a.user_id, a.k, name, a.si AS i0, coalesce(e.si, (SELECT max(i) FROM samples s WHERE s.user_id = a.user_id)) - a.si AS n FROM hit a JOIN p ON a.k % 7 = o LEFT JOIN hit e ON e.user_id = a.user_id AND e.k = a.k + split), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY k) - 1 AS rep FROM d WHERE n > 0), "
        "l AS (SELECT *, max(rep) OVER (PARTITION BY user_id, name) AS lr FROM r), "
        "c AS (SELECT l.*, CASE WHEN rep = lr THEN least(n, coalesce((SELECT max(n) FROM l b WHERE b.user_id = l.user_id AND b.name = l.name AND b.rep < b.lr), n)) ELSE n END AS n_frames FROM l)"
    )


@query(
    f"{_pieces_sql(0.0)}, w AS (SELECT user_id, name, rep, i0, unnest(range(n_frames)) AS j FROM c) "
    "SELECT w.user_id, name, rep, j, round(s.t, 6) AS t, y FROM w JOIN samples s ON s.user_id = w.user_id AND s.i = w.i0 + j",
    use="samples clicks",
)
def group_snippets(spark, sf):
    return _r(T.group_snippets(samples(spark, sf), clicks(spark, sf), U, _TRIALS), 6, "t")


@query(
    f"{_pieces_sql(40000.0)}, w AS (SELECT user_id, name, rep, i0, n_frames, unnest(range(max(n_frames) OVER (PARTITION BY user_id, name))) AS j FROM c) "
    "SELECT w.user_id, name, rep, j, round(s.t, 6) AS t, y FROM w LEFT JOIN samples s ON s.user_id = w.user_id AND s.i = w.i0 + j AND j < n_frames",
    use="samples clicks",
)
def group_snippets_padded(spark, sf):
    """Pieces that start a while after their triggers, all of a name as long as the longest."""
    return _r(T.group_snippets(samples(spark, sf), clicks(spark, sf), U, _TRIALS, delay=40000.0, stack="pad"), 6, "t")


@query(
    f"{_pieces_sql(0.0)}, w AS (SELECT user_id, name, rep, i0, unnest(range(min(n_frames) OVER (PARTITION BY user_id, name))) AS j FROM c) "
    "SELECT w.user_id, name, rep, j, round(s.t, 6) AS t, y FROM w JOIN samples s ON s.user_id = w.user_id AND s.i = w.i0 + j",
    use="samples clicks",
)
def group_snippets_truncated(spark, sf):
    """All pieces of a name as long as the shortest; lengths may differ by any amount here."""
    return _r(T.group_snippets(samples(spark, sf), clicks(spark, sf), U, _TRIALS, stack="truncate", rtol=1e9), 6, "t")


@query(
    f"{_pieces_sql(0.0)}, n AS (SELECT user_id, ceil((max(k) + 1) / 7.0::DOUBLE)::BIGINT AS n_cycles FROM clicks GROUP BY 1), f AS (SELECT user_id, count(*) AS n_pieces FROM c GROUP BY 1) "
    "SELECT user_id, n_cycles, coalesce(n_pieces, 0) AS n_pieces, (coalesce(n_pieces, 0) < n_cycles * 4)::INTEGER AS dropped_last FROM n LEFT JOIN f USING (user_id)",
    use="samples clicks",
)
def group_completeness(spark, sf):
    return T.group_completeness(samples(spark, sf), clicks(spark, sf), U, _TRIALS)


@query(
    "WITH s AS (SELECT *, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM samples), m AS (SELECT user_id, min(y) FILTER (WHERE i >= 3 AND i < n - 3) AS lo, max(y) FILTER (WHERE i >= 3 AND i < n - 3) AS hi FROM s GROUP BY 1), "
    "e AS (SELECT s.*, y < lo OR y > hi AS bad FROM s JOIN m USING (user_id)), "
    "d AS (SELECT user_id, coalesce(min(i) FILTER (WHERE i < 3 AND NOT bad), 3) AS dl, coalesce(min(n - 1 - i) FILTER (WHERE i >= n - 3 AND NOT bad), 3) AS dr FROM e GROUP BY 1) "
    "SELECT s.user_id, s.i, CASE WHEN s.i < dl THEN (SELECT y FROM samples x WHERE x.user_id = s.user_id AND x.i = dl) WHEN s.i >= n - dr THEN (SELECT y FROM samples x WHERE x.user_id = s.user_id AND x.i = s.n - 1 - dr) ELSE s.y END AS y FROM s JOIN d USING (user_id)",
    use="samples",
)
def clamp_edges(spark, sf):
    return T.clamp_edges(samples(spark, sf), U).select("user_id", "i", "y")


def _matrix_sql(h):
    return "[" + ", ".join("[" + ", ".join(f"{c!r}::DOUBLE" for c in row) + "]" for row in h) + "]"


@query(
    f"WITH h AS (SELECT {_matrix_sql(T.poly_projection(9, 3).tolist())} AS h), s AS (SELECT *, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM samples), "
    "a AS (SELECT *, least(greatest(i - 4, 0), n - 9) AS st FROM s), "
    "f AS (SELECT a.user_id, a.i, a.y, sum(x.y * h[a.i - a.st + 1][x.i - a.st + 1]) AS sm FROM a JOIN samples x ON x.user_id = a.user_id AND x.i BETWEEN a.st AND a.st + 8, h GROUP BY 1, 2, 3) "
    "SELECT user_id, i, round(y - sm, 6) + 0.0 AS y, round(sm, 6) + 0.0 AS smooth FROM f",
    use="samples",
)
def detrend_poly(spark, sf):
    return _r(T.detrend_poly(samples(spark, sf), U, 10, 3), 6, "y", "smooth").select("user_id", "i", "y", "smooth")


_T0 = "t0 AS (SELECT user_id, min(t) AS t0 FROM triggers WHERE k >= 1 GROUP BY 1)"
_BASE = f"{_T0}, pre AS (SELECT s.* FROM samples s JOIN t0 USING (user_id) WHERE s.t < t0.t0), lst AS (SELECT user_id, max(t) AS l FROM pre GROUP BY 1), base AS (SELECT pre.* FROM pre JOIN lst USING (user_id) WHERE t < l AND t >= l - 400000), whole AS (SELECT pre.* FROM pre JOIN lst USING (user_id) WHERE t < l)"


def _t0(spark, sf):
    return triggers(spark, sf).filter("k >= 1").groupBy("user_id").agg(F.min("t").alias("t0"))


@query(f"WITH {_BASE} SELECT user_id, i, y FROM base", use="samples triggers")
def baseline(spark, sf):
    return T.baseline(samples(spark, sf), _t0(spark, sf), U, 400000.0).select("user_id", "i", "y")


@query(f"WITH {_BASE} SELECT s.user_id, s.i, round(s.y - m, 6) + 0.0 AS y FROM samples s LEFT JOIN (SELECT user_id, median(y) AS m FROM base GROUP BY 1) USING (user_id)", use="samples triggers")
def subtract_baseline(spark, sf):
    return _r(T.subtract_baseline(samples(spark, sf), _t0(spark, sf), U, 400000.0), 6, "y").select("user_id", "i", "y")


@query("SELECT user_id, i, round(greatest(y, c) - c, 6) + 0.0 AS y FROM samples JOIN (SELECT user_id, quantile_cont(y, 0.025) AS c FROM samples GROUP BY 1) USING (user_id)", use="samples")
def clip_low_percentile(spark, sf):
    return _r(T.clip_low_percentile(samples(spark, sf), U), 6, "y").select("user_id", "i", "y")


@query(
    f"WITH {_BASE} SELECT user_id, i, round(y / a, 6) AS y1, round(y / b, 6) AS y2 FROM samples LEFT JOIN (SELECT user_id, stddev_pop(y) AS a FROM whole GROUP BY 1) USING (user_id) JOIN (SELECT user_id, stddev_pop(y) AS b FROM samples GROUP BY 1) USING (user_id)",
    use="samples triggers",
)
def standardize(spark, sf):
    s = samples(spark, sf)
    one = T.standardize(s, U, 1, _t0(spark, sf)).select("user_id", "i", F.round("y", 6).alias("y1"))
    return one.join(T.standardize(s, U, 2).select("user_id", "i", F.round("y", 6).alias("y2")), ["user_id", "i"])


def _clamp_sql(src: str, p: str) -> str:
    """Table ``{p}cl``: ``src`` with its edge samples clamped."""
    return (
        f"{p}sn AS (SELECT *, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM {src}), {p}mm AS (SELECT user_id, min(y) FILTER (WHERE i >= 3 AND i < n - 3) AS lo, max(y) FILTER (WHERE i >= 3 AND i < n - 3) AS hi FROM {p}sn GROUP BY 1), "
        f"{p}ed AS (SELECT s.*, y < lo OR y > hi AS bad FROM {p}sn s JOIN {p}mm USING (user_id)), "
        f"{p}dd AS (SELECT user_id, coalesce(min(i) FILTER (WHERE i < 3 AND NOT bad), 3) AS dl, coalesce(min(n - 1 - i) FILTER (WHERE i >= n - 3 AND NOT bad), 3) AS dr FROM {p}ed GROUP BY 1), "
        f"{p}cl AS (SELECT s.user_id, s.i, s.t, CASE WHEN s.i < dl THEN (SELECT y FROM {src} x WHERE x.user_id = s.user_id AND x.i = dl) WHEN s.i >= n - dr THEN (SELECT y FROM {src} x WHERE x.user_id = s.user_id AND x.i = s.n - 1 - dr) ELSE s.y END AS y FROM {p}sn s JOIN {p}dd USING (user_id))"
    )


def _lerp_sql(name: str, grid: str, src: str) -> str:
    """Table ``name``: ``src`` interpolated at the times of ``grid``, ends held."""
    return (
        f"{name}_g AS (SELECT g.user_id, g.i, g.t, b.t AS bt, b.y AS b_y, a.t AS a_t, a.y AS ay FROM {grid} g ASOF LEFT JOIN {src} b ON b.user_id = g.user_id AND b.t <= g.t ASOF LEFT JOIN {src} a ON a.user_id = g.user_id AND a.t > g.t), "
        f"{name} AS (SELECT user_id, i, t, CASE WHEN a_t IS NULL THEN b_y WHEN bt IS NULL THEN ay ELSE b_y + (ay - b_y) * ((t - bt) / (a_t - bt)) END AS y FROM {name}_g)"
    )


def _basis_sql(order: int, most: int) -> str:
    """Orthonormal polynomials for every odd window, one list of numbers per position."""
    rows = [(w, T.poly_basis(w, order).tolist()) for w in range(order + 1 + order % 2, most + 1, 2)]
    return "bs AS (SELECT * FROM (VALUES " + ", ".join(f"({w}, {_matrix_sql(q)})" for w, q in rows) + ") v(w, q))"


_PARAMS = [
    {"preprocess_id": 1, "repair": 0.1, "cutoff": 4e-6, "window_s": 500000.0, "subtract_baseline": True, "non_negative": True, "standardize": 2, "fs_resample": 3e-5},
    {"preprocess_id": 2, "down": 4},
    {"preprocess_id": 3, "sigma": 2.0, "window": 9, "standardize": 1},
]
# Set 1: even steps, edges, low-pass and detrending at the rate of each recording, baseline, clipping, spread, new rate.
_FULL = (
    "st AS (SELECT user_id, avg(d) AS dt, greatest(max(d) - avg(d), avg(d) - min(d)) / avg(d) AS rel FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS d FROM samples) GROUP BY 1), "
    "un AS (SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM samples JOIN st USING (user_id) WHERE rel > 0.1::DOUBLE GROUP BY 1), "
    "gr AS (SELECT user_id, i, a + i * ((b - a) / (n - 1)) AS t FROM (SELECT *, unnest(range(floor((b - a) / ((b - a) / (n - 1)) + 1e-9::DOUBLE)::BIGINT + 1)) AS i FROM un)), "
    + _lerp_sql("ev1", "gr", "samples")
    + ", rp AS (SELECT user_id, i, t, y FROM samples WHERE user_id NOT IN (SELECT user_id FROM un) UNION ALL SELECT user_id, i, t, y FROM ev1), "
    + _clamp_sql("rp", "r")
    + ", rt AS (SELECT user_id, count(*) AS n, (count(*) - 1) / (max(t) - min(t)) AS fs FROM rcl GROUP BY 1), "
    "sg AS (SELECT *, sqrt(ln(2::DOUBLE)) / (2 * pi() * 4e-6::DOUBLE) * fs AS s, floor(500000::DOUBLE * fs)::BIGINT AS w0 FROM rt), "
    "kw AS (SELECT user_id, k, exp(-0.5::DOUBLE * (k / s) * (k / s)) AS g FROM (SELECT *, unnest(range(-floor(4 * s + 0.5::DOUBLE)::BIGINT, floor(4 * s + 0.5::DOUBLE)::BIGINT + 1)) AS k FROM sg)), "
    "kn AS (SELECT user_id, k, g / sum(g) OVER (PARTITION BY user_id) AS g FROM kw), "
    "lp AS (SELECT c.user_id, c.i, c.t, sum(x.y * kn.g) AS y FROM rcl c JOIN sg USING (user_id) JOIN kn ON kn.user_id = c.user_id JOIN rcl x ON x.user_id = c.user_id AND x.i = greatest(0, least(sg.n - 1, c.i + kn.k)) GROUP BY 1, 2, 3), "
    f"{_basis_sql(3, 61)}, "
    "wn AS (SELECT user_id, n, w0 - (1 - w0 % 2) AS w FROM sg), ps AS (SELECT lp.*, w, least(greatest(i - w // 2, 0), n - w) AS a FROM lp JOIN wn USING (user_id)), "
    "tr AS (SELECT p.user_id, p.i, p.t, p.y, coalesce(sum(x.y * list_dot_product(q[p.i - p.a + 1], q[x.i - p.a + 1])), 0) AS m FROM ps p LEFT JOIN bs ON bs.w = p.w LEFT JOIN lp x ON x.user_id = p.user_id AND x.i BETWEEN p.a AND p.a + p.w - 1 GROUP BY 1, 2, 3, 4), "
    "de AS (SELECT user_id, i, t, y - m AS y FROM tr), "
    "l1 AS (SELECT user_id, max(t) AS l FROM de JOIN t0 USING (user_id) WHERE t < t0 GROUP BY 1), md AS (SELECT user_id, median(y) AS m FROM de JOIN l1 USING (user_id) WHERE t < l GROUP BY 1), "
    "sb AS (SELECT user_id, i, t, y - m AS y FROM de LEFT JOIN md USING (user_id)), cp AS (SELECT user_id, quantile_cont(y, 0.025) AS c FROM sb GROUP BY 1), nn AS (SELECT user_id, i, t, greatest(y, c) - c AS y FROM sb JOIN cp USING (user_id)), "
    "sd AS (SELECT user_id, stddev_pop(y) AS sd FROM nn GROUP BY 1), z AS (SELECT user_id, i, t, y / sd AS y FROM nn JOIN sd USING (user_id)), "
    "e2 AS (SELECT user_id, min(t) AS a, max(t) AS b FROM z GROUP BY 1), g2 AS (SELECT user_id, i, a + i * (1 / 3e-5::DOUBLE) AS t FROM (SELECT *, unnest(range(floor((b - a) / (1 / 3e-5::DOUBLE) + 1e-9::DOUBLE)::BIGINT + 1)) AS i FROM e2)), "
    + _lerp_sql("z1", "g2", "z")
)
# Set 3: smoothing and detrending in samples, spread of the baseline.
_SMALL = (
    "g3 AS (SELECT k, exp(-0.5::DOUBLE * k * k / 4) AS g FROM range(-8, 9) r(k)), k3 AS (SELECT k, g / (SELECT sum(g) FROM g3) AS g FROM g3), n3 AS (SELECT user_id, count(*) AS n FROM cl GROUP BY 1), "
    "s3 AS (SELECT c.user_id, c.i, c.t, n, sum(x.y * g) AS y FROM cl c JOIN n3 USING (user_id), k3 JOIN cl x ON x.user_id = c.user_id AND x.i = greatest(0, least(n - 1, c.i + k)) GROUP BY 1, 2, 3, 4), "
    "p3 AS (SELECT *, least(greatest(i - 4, 0), n - 9) AS a FROM s3), "
    "d3 AS (SELECT p.user_id, p.i, p.t, p.y - sum(x.y * list_dot_product(q[p.i - p.a + 1], q[x.i - p.a + 1])) AS y FROM p3 p JOIN bs ON bs.w = 9 JOIN s3 x ON x.user_id = p.user_id AND x.i BETWEEN p.a AND p.a + 8 GROUP BY p.user_id, p.i, p.t, p.y), "
    "l3 AS (SELECT user_id, max(t) AS l FROM d3 JOIN t0 USING (user_id) WHERE t < t0 GROUP BY 1), v3 AS (SELECT user_id, stddev_pop(y) AS sd FROM d3 JOIN l3 USING (user_id) WHERE t < l GROUP BY 1), "
    "z3 AS (SELECT user_id, i, t, y / sd AS y FROM d3 LEFT JOIN v3 USING (user_id))"
)


@query(
    f"WITH {_T0}, {_FULL}, {_clamp_sql('samples', '')}, {_SMALL}, "
    "dn AS (SELECT user_id, i // 4 AS b, avg(y) AS y, arg_min(t, i) AS t, count(*) AS n FROM cl GROUP BY 1, 2) "
    "SELECT 1 AS preprocess_id, user_id, i, round(t, 1) AS t, round(y, 5) + 0.0 AS y FROM z1 UNION ALL SELECT 2, user_id, b, round(t, 3), round(y, 5) + 0.0 FROM dn WHERE n = 4 UNION ALL SELECT 3, user_id, i, round(t, 3), round(y, 5) + 0.0 FROM z3",
    use="samples triggers",
)
def preprocess(spark, sf):
    """All steps, at rates that differ between the recordings, and the steps counted in samples."""
    d = T.preprocess(samples(spark, sf), _t0(spark, sf), U, _PARAMS)
    # Computed times may fall between two rounded values; with one decimal they do not.
    return _r(d.withColumn("t", F.when(F.col("preprocess_id") == 1, F.round("t", 1)).otherwise(F.round("t", 3))), 5, "y")


@query(
    "WITH n AS (SELECT user_id, max(i) AS m FROM samples GROUP BY 1), k AS (SELECT unnest(range(-8, 9)) AS k), w AS (SELECT k, exp(-0.5::DOUBLE * k * k / 4) / (SELECT sum(exp(-0.5::DOUBLE * k * k / 4)) FROM k) AS w FROM k) "
    "SELECT s.user_id, s.i, round(sum(x.y * w), 6) AS y FROM samples s JOIN n USING (user_id), w JOIN samples x ON x.user_id = s.user_id AND x.i = greatest(0, least(m, s.i + k)) GROUP BY 1, 2",
    use="samples",
)
def smooth_fir(spark, sf):
    return _r(T.smooth_fir(samples(spark, sf), U, sigma=2.0), 6, "y").select("user_id", "i", "y")


_LERP = (
    "lerp AS (SELECT g.user_id, g.i, g.t, b.t AS bt, b.y AS b_y, a.t AS a_t, a.y AS ay FROM grid g ASOF LEFT JOIN samples b ON b.user_id = g.user_id AND b.t <= g.t ASOF LEFT JOIN samples a ON a.user_id = g.user_id AND a.t > g.t)"
)


@query(
    "WITH e AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM samples GROUP BY 1), grid AS (SELECT user_id, t0 + i * 20000.0::DOUBLE AS t, i FROM (SELECT *, unnest(range(floor((t1 - t0) / 20000 + 1e-9::DOUBLE)::BIGINT + 1)) AS i FROM e)), "
    f"{_LERP} SELECT user_id, i, round(t, 6) AS t, round(CASE WHEN a_t IS NULL THEN b_y ELSE b_y + (ay - b_y) * (t - bt) / (a_t - bt) END, 6) AS y FROM lerp",
    use="samples",
)
def resample_linear(spark, sf):
    return _r(T.resample_linear(samples(spark, sf), U, 20000.0), 6, "t", "y")


_DT = "dt AS (SELECT user_id, (max(t) - min(t)) / (count(*) - 1) AS dt FROM samples GROUP BY 1)"


@query(
    f"WITH {_DT}, n AS (SELECT *, lead(y) OVER w AS y2, lead(t) OVER w AS t2 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY i)), u AS (SELECT *, unnest([0, 1, 2]) AS j FROM n) "
    "SELECT user_id, i * 3 + j AS i, round(t + dt * j / 3, 3) AS t, round(CASE WHEN t2 IS NULL THEN y ELSE y + (y2 - y) * least(dt * j / 3 / (t2 - t), 1) END, 6) AS y FROM u JOIN dt USING (user_id)",
    use="samples",
)
def upsample_linear(spark, sf):
    return _r(_r(T.upsample_linear(samples(spark, sf), U, 3), 3, "t"), 6, "y")


@query(
    f"WITH {_DT} SELECT user_id, i * 2 + j AS i, round(t + dt * j / 2, 3) AS t, event_type FROM (SELECT *, unnest([0, 1]) AS j FROM typed_samples) JOIN dt USING (user_id)",
    use="samples",
)
def upsample_hold(spark, sf):
    s = typed_samples(spark, sf).select("user_id", "i", "t", "event_type")
    return _r(T.upsample_hold(s, U, 2), 3, "t")


@query("SELECT user_id, i // 5 AS i, round(arg_min(t, i), 6) AS t, round(avg(y), 6) AS y FROM samples GROUP BY user_id, i // 5 HAVING count(*) = 5", use="samples")
def downsample_blocks(spark, sf):
    return _r(T.downsample_blocks(samples(spark, sf), U, 5), 6, "t", "y")


@query(
    "WITH st AS (SELECT user_id, k AS rep, t AS t0, i AS i0 FROM triggers JOIN samples USING (user_id, t)), gaps AS (SELECT user_id, t0 - lag(t0) OVER (PARTITION BY user_id ORDER BY rep) AS g FROM st WHERE i0 + 8 <= (SELECT count(*) FROM samples x WHERE x.user_id = st.user_id)), "
    "dur AS (SELECT user_id, median(g) AS dur FROM gaps GROUP BY 1), sn AS (SELECT st.user_id, st.rep, s.t - st.t0 AS t, s.y FROM st JOIN samples s ON s.user_id = st.user_id AND s.i >= st.i0 AND s.i < st.i0 + 8 "
    "WHERE st.i0 + 8 <= (SELECT count(*) FROM samples x WHERE x.user_id = st.user_id)), reps AS (SELECT DISTINCT user_id, rep FROM sn), "
    "grid AS (SELECT user_id, rep, j, j / (1 / 20000.0::DOUBLE) AS t FROM (SELECT user_id, rep, unnest(range(ceil(dur / 20000)::BIGINT)) AS j FROM reps JOIN dur USING (user_id))), "
    "lerp AS (SELECT g.user_id, g.j, g.t, b.t AS bt, b.y AS y0, a.t AS a_t, a.y AS y1 FROM grid g ASOF LEFT JOIN sn b ON b.user_id = g.user_id AND b.rep = g.rep AND b.t <= g.t ASOF LEFT JOIN sn a ON a.user_id = g.user_id AND a.rep = g.rep AND a.t > g.t) "
    "SELECT user_id, j, round(any_value(t), 4) AS t, round(avg(CASE WHEN a_t IS NULL THEN y0 WHEN bt IS NULL THEN y1 ELSE y0 + (y1 - y0) * (t - bt) / (a_t - bt) END), 6) AS avg FROM lerp GROUP BY 1, 2",
    use="samples triggers",
)
def resampled_average(spark, sf):
    s = samples(spark, sf)
    st = T.repetition_starts(s, triggers(spark, sf), U, 1)
    avg = T.resampled_average(T.snippet_join(st, s, U), st, U, 1 / 20000.0)
    return _r(_r(avg, 4, "t"), 6, "avg")


@query("SELECT user_id, k * 3 + j AS frame, round(t + j / 3.0::DOUBLE, 6) AS t FROM (SELECT *, unnest([0, 1, 2]) AS j FROM triggers)", use="triggers")
def expand_frame_times(spark, sf):
    k = triggers(spark, sf)
    frames = k.groupBy("user_id").agg((F.count("*") * 3).alias("n_frames"))
    return _r(T.expand_frame_times(k.join(frames, "user_id"), U, 3, "n_frames"), 6, "t")


_DIFF = "df AS (SELECT user_id, i, t, coalesce(y - lag(y) OVER (PARTITION BY user_id ORDER BY i), 0) AS y FROM samples)"
# Peaks of a series ``{s}``: rows between lower runs, reported at the middle of a plateau.
_PEAKS = (
    "rn AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, (lag(y) OVER (PARTITION BY user_id ORDER BY i) IS DISTINCT FROM y)::INTEGER AS ch FROM {s})), "
    "rr AS (SELECT user_id, run, any_value(y) AS y, min(i) AS i0, max(i) AS i1 FROM rn GROUP BY 1, 2), "
    "pk AS (SELECT user_id, y, i0, i1, (i0 + i1) // 2 AS i FROM (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a FROM rr WINDOW w AS (PARTITION BY user_id ORDER BY run)) WHERE b < y AND a < y)"
)


@query(
    f"WITH {_DIFF}, {_PEAKS.format(s='df')}, mad AS (SELECT user_id, median(abs(y)) AS m FROM df GROUP BY 1) "
    "SELECT d.user_id, d.i, round(greatest(d.y, 0), 6) AS gradient, round(CASE WHEN pk.y >= m / 0.6745::DOUBLE THEN pk.y ELSE 0 END, 6) AS events FROM df d JOIN mad USING (user_id) LEFT JOIN pk ON pk.user_id = d.user_id AND pk.i = d.i",
    use="samples",
)
def event_signal(spark, sf):
    s = samples(spark, sf)
    g = T.event_signal(s, U, "gradient").select("user_id", "i", F.round("y", 6).alias("gradient"))
    return g.join(T.event_signal(s, U, "events").select("user_id", "i", F.round("y", 6).alias("events")), ["user_id", "i"])


_DISC = "ds AS (SELECT user_id, i, floor(y / 5) * 5 AS y FROM samples)"


@query(
    f"WITH {_DISC}, {_PEAKS.format(s='ds')}, lh AS (SELECT pk.user_id, pk.i, pk.y, i0, i1, coalesce((SELECT max(d.i) FROM ds d WHERE d.user_id = pk.user_id AND d.i < i0 AND d.y > pk.y), -1) AS a, "
    "coalesce((SELECT min(d.i) FROM ds d WHERE d.user_id = pk.user_id AND d.i > i1 AND d.y > pk.y), 1000000000) AS b FROM pk), "
    "pr AS (SELECT user_id, i, y, y - greatest((SELECT min(d.y) FROM ds d WHERE d.user_id = lh.user_id AND d.i > a AND d.i < i0), (SELECT min(d.y) FROM ds d WHERE d.user_id = lh.user_id AND d.i > i1 AND d.i < b)) AS prominence FROM lh) "
    "SELECT * FROM pr WHERE prominence >= 20 AND y >= 40",
    use="samples",
)
def find_peaks(spark, sf):
    s = samples(spark, sf).withColumn("y", (F.floor(F.col("y") / 5) * 5).cast("double"))
    return T.find_peaks(s, U, height=40.0, prominence=20.0)


@query(
    f"WITH {_PEAKS.format(s='samples')}, bg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(y) DESC, i DESC) AS r FROM pk WHERE y > 150), "
    "tm AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS q FROM bg WHERE r <= 2), "
    "tw AS (SELECT user_id, max(i) FILTER (WHERE q = 1) AS main_i, max(y) FILTER (WHERE q = 1) AS main_y, max(i) FILTER (WHERE q = 2) AS pre_i, max(y) FILTER (WHERE q = 2) AS pre_y FROM tm GROUP BY 1) "
    "SELECT user_id, main_i, main_y, coalesce(pre_i, (SELECT arg_min(s.i, (s.y, s.i)) FROM samples s WHERE s.user_id = tw.user_id AND s.i < main_i)) AS pre_i, "
    "coalesce(pre_y, (SELECT min(s.y) FROM samples s WHERE s.user_id = tw.user_id AND s.i < main_i)) AS pre_y FROM tw",
    use="samples",
)
def top2_peaks_by_time(spark, sf):
    s = samples(spark, sf)
    return T.top2_peaks_by_time(T.find_peaks(s, U, height=150.0001), s, U)


_FRAMES = "fr AS (SELECT user_id, k AS frame, t FROM clicks)"


def _frames(spark, sf):
    return clicks(spark, sf).select("user_id", F.col("k").alias("frame"), "t")


@query(
    f"WITH {_FRAMES}, sp AS (SELECT user_id, min(t) AS a, max(t) + max(d) AS b FROM (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM fr) GROUP BY 1) "
    "SELECT s.user_id, s.i, s.y, fr.frame FROM (SELECT s.* FROM samples s JOIN sp USING (user_id) WHERE t >= a AND t < b) s ASOF LEFT JOIN fr ON fr.user_id = s.user_id AND fr.t <= s.t",
    use="samples clicks",
)
def stim_to_trace(spark, sf):
    return T.stim_to_trace(_frames(spark, sf), samples(spark, sf), U).drop("t")


_T2S = (
    f"{_FRAMES}, fe AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY frame) AS nt, t + (max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id)) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0) AS le FROM fr), "
    "ts AS (SELECT fe.user_id, frame, fe.t, coalesce(sum(s.y), 0) AS y FROM fe LEFT JOIN samples s ON s.user_id = fe.user_id AND s.t >= fe.t AND s.t < coalesce(nt, le) GROUP BY 1, 2, 3)"
)


@query(f"WITH {_T2S} SELECT user_id, frame, round(t, 6) AS t, round(y, 6) AS y FROM ts", use="samples clicks")
def trace_to_stim(spark, sf):
    return _r(T.trace_to_stim(_frames(spark, sf), samples(spark, sf), U), 6, "t", "y")


@query(f"WITH {_T2S} SELECT user_id, frame AS i, frame, round(y / nullif(stddev_pop(y) OVER (PARTITION BY user_id), 0), 6) AS y FROM ts", use="samples clicks")
def align_for_regression(spark, sf):
    return _r(T.align_for_regression(_frames(spark, sf), samples(spark, sf), U, ref="stim"), 6, "y").select("user_id", "i", "frame", "y")


@query(
    "WITH g AS (SELECT user_id, i, t, coalesce(y - lag(y) OVER w, 0) AS y FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY i)), "
    "ms AS (SELECT user_id, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS dt FROM g GROUP BY 1), nx AS (SELECT *, lead(y) OVER w AS y2, lead(t) OVER w AS t2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY i)), "
    "up AS (SELECT user_id, i * 2 + j AS i, t + coalesce(dt, 0) * j / 2 AS t, greatest(CASE WHEN t2 IS NULL THEN y ELSE y + (y2 - y) * least(coalesce(dt, 0) * j / 2 / nullif(t2 - t, 0), 1) END, 0) AS y FROM nx JOIN ms USING (user_id), range(2) q(j)), "
    f"{_FRAMES}, fd AS (SELECT user_id, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS dt FROM fr GROUP BY 1), f3 AS (SELECT user_id, frame * 3 + j AS frame, t + coalesce(dt, 0) * j / 3 AS t FROM fr JOIN fd USING (user_id), range(3) q(j)), "
    "sp AS (SELECT user_id, min(t) AS a, max(t) + max(d) AS b FROM (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM f3) GROUP BY 1), "
    "s AS (SELECT up.* FROM up JOIN sp USING (user_id) WHERE t >= a AND t < b) "
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, round(y / nullif(stddev_pop(y) OVER (PARTITION BY user_id), 0), 6) AS y FROM s",
    use="samples clicks",
)
def align_gradient(spark, sf):
    """Positive steps at twice the rate of the trace, on trace time, within the span of three times as many frames."""
    return _r(T.align_for_regression(_frames(spark, sf), samples(spark, sf), U, kind="gradient", up=2, up_frames=3), 6, "y").select("user_id", "i", "y")


@query("SELECT user_id, i, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.9::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM samples)", use="samples")
def ordered_split(spark, sf):
    return T.ordered_split(samples(spark, sf), U).select("user_id", "i", "split")


@query(
    "WITH s AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM samples), f AS (SELECT *, unnest([0, 1, 2, 3]) AS fold FROM s), "
    "b AS (SELECT *, fold * (n // 4) + least(fold, n % 4) AS lo FROM f), h AS (SELECT *, lo + n // 4 - 1 + (fold < n % 4)::INTEGER AS hi FROM b) "
    "SELECT user_id, i, fold, CASE WHEN i BETWEEN lo AND hi THEN 'dev' ELSE 'train' END AS role FROM h WHERE i <= hi OR i > hi + 2",
    use="samples",
)
def blocked_kfold(spark, sf):
    return T.blocked_kfold(samples(spark, sf), U, 4, 2).select("user_id", "i", "fold", "role")


@query(
    "SELECT a.user_id, a.i, lag, coalesce(b.y, 0) AS x FROM (SELECT user_id, i, unnest(range(4))::INTEGER AS lag FROM samples) a LEFT JOIN samples b ON b.user_id = a.user_id AND b.i = a.i + lag - 4 + 1 + 1",
    use="samples",
)
def lag_matrix(spark, sf):
    return T.lag_matrix(samples(spark, sf), U, 4, shift=-1)


@query(
    f"WITH {_DT}, n AS (SELECT user_id, dt, ceil(200000 / dt)::BIGINT AS p, ceil(50000 / dt)::BIGINT AS f FROM dt) "
    "SELECT user_id, -f AS shift, p AS burn_in, lag::INTEGER AS lag, round((lag + 1 - p) * dt, 3) + 0.0 AS t FROM (SELECT *, unnest(range(p + f)) AS lag FROM n)",
    use="samples",
)
def lag_axis(spark, sf):
    d = T.mean_step(samples(spark, sf), U)
    return _r(T.lag_axis(d, F.lit(200000.0), F.lit(50000.0), F.col("dt")), 3, "t").drop("dt")


@query("SELECT c_custkey, c_mktsegment || '_' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tag FROM customer")
def rank_tags(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return T.rank_tags(c, "c_mktsegment", ["c_acctbal", "c_custkey"], "tag").select("c_custkey", "tag")


_SIG = (
    "SELECT user_id, {s} AS sign, min(px) AS x0, max(i) AS x1 FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY i) AS run FROM "
    "(SELECT *, (f AND NOT coalesce(lag(f) OVER w, false))::INTEGER AS st, CASE WHEN f AND NOT coalesce(lag(f) OVER w, false) THEN coalesce(lag(i) OVER w, i) ELSE i END AS px "
    "FROM (SELECT user_id, i, {c} AS f FROM samples) WINDOW w AS (PARTITION BY user_id ORDER BY i))) WHERE f GROUP BY user_id, run"
)


@query(_SIG.format(s=1, c="y - 50 - 10 > 0") + " UNION ALL " + _SIG.format(s=-1, c="y - 50 + 10 < 0"), use="samples")
def significant_intervals(spark, sf):
    c = samples(spark, sf).select("user_id", F.col("i").alias("x"), (F.col("y") - 50).alias("est"), F.lit(10.0).alias("ci"))
    return T.significant_intervals(c, U, "x", "est", "ci")


@query("SELECT user_id, i, y FROM samples WHERE user_id % 5 <> 0 OR i < 20 + user_id % 7", use="samples")
def cut_at_index(spark, sf):
    s = samples(spark, sf)
    fixes = s.filter("user_id % 5 = 0").select("user_id").distinct().select("user_id", (20 + F.col("user_id") % 7).alias("bad_i"))
    return T.cut_at_index(s, fixes, U).select("user_id", "i", "y")


@query(
    "WITH c AS (SELECT user_id, k // 2 AS rep, (SELECT min(s.i) FROM samples s WHERE s.user_id = g.user_id AND s.t >= g.t) AS i FROM triggers g WHERE k % 2 = 0), "
    "e AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE -2 END AS edit FROM samples WHERE user_id % 3 < 2), "
    "w AS (SELECT e.user_id, CASE WHEN edit > 0 THEN hi.i + 1 ELSE lo.i END AS a, CASE WHEN edit < 0 THEN hi.i END AS b FROM e LEFT JOIN c hi ON hi.user_id = e.user_id AND hi.rep = abs(edit) LEFT JOIN c lo ON lo.user_id = e.user_id AND lo.rep = abs(edit) - 1) "
    "SELECT s.user_id, s.i, CASE WHEN s.i >= a AND (b IS NULL OR s.i < b) THEN NULL ELSE s.y END AS y FROM samples s LEFT JOIN w USING (user_id)",
    use="samples triggers",
)
def blank_repetitions(spark, sf):
    s = samples(spark, sf)
    e = s.filter("user_id % 3 < 2").select("user_id").distinct().withColumn("edit", F.when(F.col("user_id") % 3 == 0, 2).otherwise(-2))
    return T.blank_repetitions(s, triggers(spark, sf), e, U, 2).select("user_id", "i", "y")
