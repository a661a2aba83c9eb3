"""Joins beyond equality: settings by date, spatial matches, label and image comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.asof import asof
from ..plans.near import nearest_point
from ..plans.stats import pearson
from ..session import once, written


def asof_setting(keys: DataFrame, settings: DataFrame, date: str, setup: str, columns: dict[str, str]) -> DataFrame:
    """Last non-null setting at or before the end of the date, from the column of the row's setup.

    ``columns`` maps setup values to columns of the sparse ``settings`` table; ms become s.
    """
    long = settings.select(
        F.col(date).cast("date").alias("_d"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("_s"), F.col(c).cast("double").alias("_v")) for k, c in columns.items()])).alias("_x"),
    ).select("_d", F.col("_x._s").alias(setup), F.col("_x._v").alias("v")).filter("v is not null")
    long = long.groupBy(setup, "_d").agg(F.max("v").alias("v"))
    left = keys.withColumn("_d", F.col(date).cast("date"))
    # Many rows ask for the same date: look each (setup, date) up once.
    ask = left.select(setup, "_d").distinct()
    got = asof(ask, long, [setup], "_d", _hit="before").select(setup, "_d", (F.col("_hit.v") / 1000.0).alias("setting"))
    return left.join(got, [setup, "_d"], "left").drop("_d")


def snap_to_tree(points: DataFrame, tree: DataFrame, soma: DataFrame, pid: list[str], axes: list[str], max_dist: float, z_factor: float = 1.0) -> DataFrame:
    """Nearest tree point, or the soma if that is nearer; success within ``max_dist``."""
    scale = {axes[-1]: z_factor} if len(axes) > 2 else {}
    a = nearest_point(points, tree, pid, axes, "id", scale)
    b = nearest_point(points, soma, pid, axes, "id", scale).select(*pid, F.col("dist").alias("dist_soma"))
    d = a.join(b, pid)
    ok = F.least("dist", "dist_soma") <= max_dist
    by_soma = ok & (F.col("dist_soma") <= F.col("dist"))
    snap = [F.when(~by_soma, F.col(f"near_{x}")).alias(f"near_{x}") for x in axes]
    return d.select(*pid, "id", "dist", "dist_soma", ok.cast("int").alias("success"), by_soma.cast("int").alias("soma_by_dist"), *snap)


def locate_on_path(points: DataFrame, path_points: DataFrame, axes: list[str]) -> DataFrame:
    """First path and vertex at the voxel of each point."""
    first = path_points.groupBy(*axes).agg(F.min(F.struct("path_id", "j")).alias("_m"))
    return points.join(first, axes).select(*points.columns, "_m.path_id", "_m.j")


# Pairs that one part of a bucket compares, and tasks that parts are dealt out to.
BUCKET_PAIRS, MOST_TASKS = 4_000_000, 2000


def box_candidates(segments: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Segments (``x0 y0 x1 y1``) and cells (``cx cy``, half size ``h``) whose boxes overlap.

    Both boxes are listed in the buckets of a grid; a pair is kept only in the bucket of the corner
    where the overlap starts, so that it appears once. A bucket of many pairs is cut into parts: each of its
    segments is in one part, its cells are in all of them. Parts are dealt out by pairs, not by bytes, as a short
    table of boxes makes many pairs.
    """

    def buckets(df: DataFrame, lo_x, hi_x, lo_y, hi_y) -> DataFrame:
        d = df.withColumns({"_lx": lo_x, "_hx": hi_x, "_ly": lo_y, "_hy": hi_y})
        d = d.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_lx") / size), F.floor(F.col("_hx") / size))))
        return d.withColumn("_by", F.explode(F.sequence(F.floor(F.col("_ly") / size), F.floor(F.col("_hy") / size))))

    s = buckets(segments, F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1"))
    c = buckets(cells, F.col("cx") - F.col("h"), F.col("cx") + F.col("h"), F.col("cy") - F.col("h"), F.col("cy") + F.col("h"))
    c = c.withColumnsRenamed({f"_{p}{q}": f"_c{p}{q}" for p in "lh" for q in "xy"})
    s, c, at = once(s), once(c), ["_bx", "_by"]
    pairs = s.groupBy(*at).agg(F.count("*").alias("_s")).join(c.groupBy(*at).agg(F.count("*").alias("_c")), at)
    pairs = written(pairs.withColumn("_parts", F.ceil(F.col("_s") * F.col("_c") / BUCKET_PAIRS)))
    n = min(int((pairs.agg(F.sum(F.col("_s") * F.col("_c"))).first()[0] or 0) // BUCKET_PAIRS) + 1, MOST_TASKS)
    s = s.join(pairs.select(*at, "_parts"), at).withColumn("_part", F.pmod(F.xxhash64(*segments.columns), F.col("_parts"))).drop("_parts")
    c = c.join(pairs.select(*at, "_parts"), at).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    at = [*at, "_part"]
    j = s.repartition(n, *at).join(c.repartition(n, *at).hint("shuffle_hash"), at).drop("_part")
    over = (F.col("_lx") <= F.col("_chx")) & (F.col("_hx") >= F.col("_clx")) & (F.col("_ly") <= F.col("_chy")) & (F.col("_hy") >= F.col("_cly"))
    start = (F.col("_bx") == F.floor(F.greatest("_lx", "_clx") / size)) & (F.col("_by") == F.floor(F.greatest("_ly", "_cly") / size))
    inside = (F.col("_lx") > F.col("_clx")) & (F.col("_hx") < F.col("_chx")) & (F.col("_ly") > F.col("_cly")) & (F.col("_hy") < F.col("_chy"))
    j = j.filter(over & start).withColumn("relation", F.when(inside, "inside").otherwise("may_cross"))
    return j.drop("_bx", "_by", *[f"_{p}{q}" for p in "lh" for q in "xy"], *[f"_c{p}{q}" for p in "lh" for q in "xy"])


# Half planes of a hull that one row holds.
PLANES = 1000


def points_in_convex(points: DataFrame, planes: DataFrame, keys: list[str], axes: list[str], tol: float = 0.0, most: int = PLANES) -> DataFrame:
    """True if the point meets every half plane ``n . p <= d`` of its key's hull; false without a hull.

    The planes of a hull travel as arrays of at most ``most``. Hulls of more planes are dealt to several arrays, each met by every point
    of the key, and a point is inside if it is inside all of them; rows that are equal get equal answers.
    """
    normals = [f"n_{a}" for a in axes]
    many = planes.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_parts"))
    part = F.pmod(F.xxhash64(*normals, "d"), F.col("_parts"))
    dealt = once(planes.join(many, keys).groupBy(*keys, part.alias("_part")).agg(F.collect_list(F.struct(*normals, "d")).alias("_h")))

    def inside(h: Column) -> Column:
        return sum((h[n] * F.col(a) for n, a in zip(normals, axes)), F.lit(0.0)) <= h["d"] + tol

    if dealt.filter("_part > 0").isEmpty():
        return points.join(dealt.drop("_part"), keys, "left").withColumn("inside", F.coalesce(F.forall("_h", inside), F.lit(False))).drop("_h")
    at = [*keys, *axes]
    met = points.select(*at).distinct().join(dealt, keys).groupBy(*at).agg(F.every(F.forall("_h", inside)).alias("_in"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in at]
    out = points.join(met.withColumnsRenamed({c: f"_of_{c}" for c in at}), same, "left")
    return out.select(*points.columns, F.coalesce("_in", F.lit(False)).alias("inside"))


def label_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels shared by each pair of labels of two masks ``(keys, x, y, roi_id)``."""
    bb = b.select(*keys, "x", "y", F.col("roi_id").alias("roi_b"))
    j = a.select(*keys, "x", "y", F.col("roi_id").alias("roi_a")).join(bb, [*keys, "x", "y"])
    return j.groupBy(*keys, "roi_a", "roi_b").agg(F.count("*").alias("n"))


def label_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union of every overlapping pair of labels."""
    na = a.groupBy(*keys, F.col("roi_id").alias("roi_a")).agg(F.count("*").alias("_na"))
    nb = b.groupBy(*keys, F.col("roi_id").alias("roi_b")).agg(F.count("*").alias("_nb"))
    d = label_overlap(a, b, keys).join(na, [*keys, "roi_a"]).join(nb, [*keys, "roi_b"])
    return d.select(*keys, "roi_a", "roi_b", (F.col("n") / (F.col("_na") + F.col("_nb") - F.col("n"))).alias("iou"))


def _shifts(m: int) -> Column:
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-m, m + 1) for dy in range(-m, m + 1)])


def compare_masks(a: DataFrame, b: DataFrame, keys: list[str], nx: int, ny: int, max_shift: int) -> DataFrame:
    """Are two masks the same, shifted (by which ``dx, dy``), or different?

    A shift counts if all pixels both images share after it agree; the first in order is taken.
    """
    inside = F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)
    sh = a.select(*keys, "x", "y", "roi_id", F.explode(_shifts(max_shift)).alias("_s"))
    sh = sh.select(*keys, "_s.dx", "_s.dy", (F.col("x") - F.col("_s.dx")).alias("x"), (F.col("y") - F.col("_s.dy")).alias("y"), F.col("roi_id").alias("ra")).filter(inside)
    # Labelled pixels of b that the shifted image covers.
    sb = b.select(*keys, "x", "y", F.col("roi_id").alias("rb"), F.explode(_shifts(max_shift)).alias("_s")).select(*keys, "x", "y", "rb", "_s.*")
    ox, oy = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    sb = sb.filter(ox.between(0, nx - 1) & oy.between(0, ny - 1))
    na = sh.join(b.select(*keys, "x", "y", F.col("roi_id").alias("rb")), [*keys, "x", "y"], "left")
    na = na.groupBy(*keys, "dx", "dy").agg(F.count("*").alias("_na"), F.count_if(F.col("ra") == F.col("rb")).alias("_eq"))
    nb = sb.groupBy(*keys, "dx", "dy").agg(F.count("*").alias("_nb"))
    every = a.select(*keys).unionByName(b.select(*keys)).distinct()
    every = every.select(*keys, F.explode(_shifts(max_shift)).alias("_s")).select(*keys, "_s.*")
    d = every.join(na, [*keys, "dx", "dy"], "left").join(nb, [*keys, "dx", "dy"], "left").fillna(0, ["_na", "_eq", "_nb"])
    d = d.withColumn("_ok", (F.col("_na") == F.col("_eq")) & (F.col("_nb") == F.col("_eq")))
    d = d.groupBy(*keys).agg(
        F.bool_or(F.col("_ok") & (F.col("dx") == 0) & (F.col("dy") == 0)).alias("_same"),
        F.min(F.when(F.col("_ok"), F.struct("dx", "dy"))).alias("_m"),
    )
    rel = F.when(F.col("_same"), "same").when(F.col("_m").isNotNull(), "shifted").otherwise("different")
    return d.select(
        *keys, rel.alias("relation"), F.when(F.col("_same"), 0).otherwise(F.col("_m.dx")).alias("dx"), F.when(F.col("_same"), 0).otherwise(F.col("_m.dy")).alias("dy")
    )


# Width of the tiles in which shifted images are compared.
TILE = 16


def shift_scores(img: DataFrame, ref: DataFrame, keys: list[str], ref_keys: list[str], max_shift: int, metric: str) -> DataFrame:
    """Score of every shift over the pixels both images share (``corr`` or ``mse`` = minus mean square).

    Images meet their reference tile by tile, a reference tile with a border as wide as the largest shift. So a pixel
    travels once, and its pairs of all shifts are summed up where they arise.
    """
    m, wide = max_shift, TILE + 2 * max_shift
    tx, ty = F.floor(F.col("x") / TILE), F.floor(F.col("y") / TILE)
    tiles = img.select(*keys, tx.alias("_tx"), ty.alias("_ty"), F.struct(F.pmod("x", F.lit(TILE)).cast("int").alias("x"), F.pmod("y", F.lit(TILE)).cast("int").alias("y"), "v").alias("_p"))
    tiles = tiles.groupBy(*keys, "_tx", "_ty").agg(F.collect_list("_p").alias("_p"))

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - m) / TILE), F.floor((F.col(c) + m) / TILE)))

    r = ref.select(*ref_keys, "x", "y", F.col("v").alias("_w"), reach("x").alias("_tx")).withColumn("_ty", reach("y"))
    at = (F.col("x") - F.col("_tx") * TILE + m) * wide + F.col("y") - F.col("_ty") * TILE + m
    r = r.select(*ref_keys, "_tx", "_ty", at.cast("int").alias("_at"), "_w").groupBy(*ref_keys, "_tx", "_ty", "_at").agg(F.collect_list(F.struct("_w")).alias("_w"))
    r = r.groupBy(*ref_keys, "_tx", "_ty").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_w"))).alias("_m"))
    # Dense, so that a pixel is found by its place.
    r = r.select(*ref_keys, "_tx", "_ty", F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), lambda k: F.try_element_at("_m", k)).alias("_r"))

    def pairs(p: Column) -> Column:
        def one(s: Column) -> Column:
            there = F.get("_r", (p["x"] + s["dx"] + m) * wide + p["y"] + s["dy"] + m)
            return F.transform(F.coalesce(there, F.array().cast(r.schema["_r"].dataType.elementType)), lambda w: F.struct(s["dx"].alias("dx"), s["dy"].alias("dy"), p["v"].alias("v"), w["_w"].alias("_w")))

        return F.flatten(F.transform(F.col("_shift"), one))

    j = tiles.join(r, [*ref_keys, "_tx", "_ty"]).withColumn("_shift", _shifts(m))
    j = j.select(*keys, F.inline(F.flatten(F.transform("_p", pairs))))
    score = pearson("v", "_w") if metric == "corr" else -F.avg((F.col("v") - F.col("_w")) * (F.col("v") - F.col("_w")))
    return j.groupBy(*keys, "dx", "dy").agg(score.alias("score"))


def best_shift(img: DataFrame, ref: DataFrame, keys: list[str], ref_keys: list[str], max_shift: int, metric: str = "mse") -> DataFrame:
    """Best shift of each image against its reference; the first in order on ties."""
    s = shift_scores(img, ref, keys, ref_keys, max_shift, metric).filter("score is not null")
    return s.groupBy(*keys).agg(F.max_by(F.struct("dx", "dy", "score"), F.struct("score", -F.col("dx"), -F.col("dy"))).alias("_m")).select(*keys, "_m.*")


def match_template(image: DataFrame, template: DataFrame, keys: list[str], shape: tuple[int, int], size: tuple[int, int], centre: tuple[float, float], factor: float = 1e-3) -> DataFrame:
    """Best offset of a small template in each image plane ``(keys, z)`` and over all planes.

    Score: minus 100 times the masked mean square, minus ``factor`` times the squared distance of the
    template's middle from the expected centre. ``template`` holds its finite pixels ``(u, v, w)``,
    at most ``size[0] * size[1]`` rows, and is sent to every task.
    """
    if template.count() > size[0] * size[1]:
        raise ValueError("template has more rows than its size")
    one = template.agg(F.collect_list(F.struct("u", "v", "w")).alias("_t"))
    j = image.select(*keys, "z", "x", "y", F.col("v").alias("img")).crossJoin(F.broadcast(one))
    fits = F.filter("_t", lambda p: (F.col("x") - p["u"]).between(0, shape[0] - size[0]) & (F.col("y") - p["v"]).between(0, shape[1] - size[1]))
    j = j.withColumn("_p", F.explode(fits)).select(*keys, "z", "x", "y", "img", "_p.*")
    j = j.groupBy(*keys, "z", (F.col("x") - F.col("u")).alias("ox"), (F.col("y") - F.col("v")).alias("oy")).agg(
        F.sum((F.col("img") - F.col("w")) * (F.col("img") - F.col("w"))).alias("_sq")
    )
    dist = F.pow(F.col("ox") - centre[0] + size[0] // 2, 2) + F.pow(F.col("oy") - centre[1] + size[1] // 2, 2)
    j = j.withColumn("score", -100.0 * F.col("_sq") / (size[0] * size[1]) - factor * dist)
    best = F.max_by(F.struct("z", "ox", "oy", "score"), F.struct("score", -F.col("z"), -F.col("oy"), -F.col("ox")))
    return j.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")


def crop(pixels: DataFrame, centres: DataFrame, keys: list[str], size: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Window of a size around each centre (``cx, cy``), cut at the borders, with re-based coordinates."""
    d = pixels.join(centres, keys)
    for a, c, w, n in (("x", "cx", size[0], shape[0]), ("y", "cy", size[1], shape[1])):
        lo = F.floor(F.greatest(F.col(c) - w / 2, F.lit(0.0))).cast("int")
        hi = F.ceil(F.least(F.col(c) + w / 2, F.lit(float(n)))).cast("int")
        d = d.filter((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(a, F.col(a) - lo)
    return d.drop("cx", "cy")


def strided_kernel(frames: DataFrame, keys: list[str], kernel: list[list[float]], shape: tuple[int, int], stride: int, relu: float | None = None, bias: float = 0.0) -> DataFrame:
    """Weighted sum over a moving square, only where it fits, every ``stride`` pixels.

    With ``relu`` values up to that threshold count as zero. The kernel is a literal of the query;
    each pixel meets only the at most ``ceil(n / stride) ** 2`` places that cover it.
    """
    n = len(kernel)
    ker = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in kernel])
    v = F.col("v") if relu is None else F.when(F.col("v") > relu, F.col("v")).otherwise(0.0)

    def places(a: str, size: int) -> Column:
        lo = F.greatest(F.ceil((F.col(a) - n + 1) / stride), F.lit(0))
        hi = F.least(F.floor(F.col(a) / stride), F.lit((size - n) // stride))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    d = frames.withColumn("_v", v).withColumn("u", F.explode(places("x", shape[0]))).withColumn("w", F.explode(places("y", shape[1])))
    k = F.get(F.get(ker, (F.col("x") - F.col("u") * stride).cast("int")), (F.col("y") - F.col("w") * stride).cast("int"))
    return d.groupBy(*keys, "u", "w").agg((F.sum(F.col("_v") * k) + bias).alias("v"))
