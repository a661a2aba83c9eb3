"""Pixel, label and volume operators on coordinate tables.

Images are ``(keys, x, y, v)``, stacks add ``z`` or ``frame``, masks are ``(keys, x, y, roi_id)`` with
labelled pixels only. A stencil is a list of coordinate shifts followed by an equi-join or a sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.near import nearest_point
from ..plans.quantile import quantiles, with_quantiles
from ..plans.scan import indexed, scan
from ..plans.stats import join_stats, nz, pearson
from ..session import durable, written
from .joins import compare_masks, label_iou
from .series import fir, gauss_kernel

FOUR = [(1, 0), (0, 1)]
EIGHT = [(1, 0), (0, 1), (1, 1), (1, -1)]


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in pairs])


def _pairs(df: DataFrame, on: list[str], steps: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Rows beside the row a step further on; kept columns of the partner get the suffix ``_2``."""
    a = df.withColumn("_s", F.explode(_offsets(steps))).withColumn("_x", F.col("x") + F.col("_s.dx")).withColumn("_y", F.col("y") + F.col("_s.dy"))
    b = df.select(*on, F.col("x").alias("_x"), F.col("y").alias("_y"), *[F.col(c).alias(f"{c}_2") for c in keep])
    return a.join(b, [*on, "_x", "_y"]).withColumnsRenamed({"_x": "x_2", "_y": "y_2"}).drop("_s")


def neighbour_corr(stack: DataFrame, keys: list[str]) -> DataFrame:
    """Mean correlation of each pixel's series with those of its up to eight neighbours."""
    px = [*keys, "x", "y"]
    z = join_stats(stack, px, _m=F.avg("v"), _s=F.stddev_pop("v"), _n=F.count("*"))
    z = z.select(*px, "frame", "_n", ((F.col("v") - F.col("_m")) / nz(F.col("_s"))).alias("z"))
    p = _pairs(z, [*keys, "frame"], EIGHT, ["z"])
    r = p.groupBy(*px, "x_2", "y_2").agg((F.sum(F.col("z") * F.col("z_2")) / F.first("_n")).alias("r"))
    both = r.select(*px, "r").unionByName(r.select(*keys, F.col("x_2").alias("x"), F.col("y_2").alias("y"), "r"))
    return both.groupBy(*px).agg(F.avg("r").alias("v"))


def zero_border(img: DataFrame, shape: tuple[int, int], cut_x: tuple[int, int], cut_y: tuple[int, int], value: float = 0.0) -> DataFrame:
    inside = F.col("x").between(cut_x[0], shape[0] - cut_x[1] - 1) & F.col("y").between(cut_y[0], shape[1] - cut_y[1] - 1)
    return img.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(value)))


def line_threshold(img: DataFrame, keys: list[str], shape: tuple[int, int], cut_x: tuple[int, int], cut_y: tuple[int, int], q: float = 70, minimum: float = 0.1) -> DataFrame:
    """Percentile of the inner pixels of each scan line ``y``, floored; border lines get 1."""
    lines = img.select(*keys, "y").distinct()
    inner = img.filter(F.col("x").between(cut_x[0], shape[0] - cut_x[1] - 1) & F.col("y").between(cut_y[0], shape[1] - cut_y[1] - 1))
    p = quantiles(inner, [*keys, "y"], "v", shape[0], _q=q / 100)
    return lines.join(p, [*keys, "y"], "left").select(*keys, "y", F.greatest(F.coalesce("_q", F.lit(1.0)), F.lit(minimum)).alias("threshold"))


def connected_components(mask: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Relabel: connected pixels of equal value get one label, numbered from 1 per key in scan order."""
    m = durable(mask.select(*keys, "x", "y", "roi_id"))
    p = _pairs(m, [*keys, "roi_id"], EIGHT if connectivity == 8 else FOUR, [])
    node = F.struct(*keys, "y", "x")
    roots = components(
        m.select(node.alias("v")), p.select(node.alias("a"), F.struct(*keys, F.col("y_2").alias("y"), F.col("x_2").alias("x")).alias("b"))
    )
    lab = roots.select("root").distinct().select("root", *[F.col(f"root.{c}").alias(c) for c in (*keys, "y", "x")])
    lab = indexed(lab, keys, ["y", "x"], "_k").select("root", (F.col("_k") + 1).cast("int").alias("roi_id"))
    d = roots.join(lab, "root")
    return d.select(*[F.col(f"v.{c}").alias(c) for c in (*keys, "x", "y")], "roi_id")


def grow_regions(img: DataFrame, keys: list[str], threshold: Column | float, n_min: int = 3, n_max: int | None = None, extent: tuple[int, int] | None = None, connectivity: int = 4) -> DataFrame:
    """Connected pixels above the threshold as labels, within size and extent limits, numbered anew.

    Stands in for growing seed by seed: a region does not depend on the order of its seeds.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    lab = connected_components(img.filter(F.col("v") >= t).withColumn("roi_id", F.lit(1)), keys, connectivity)
    s = lab.groupBy(*keys, "roi_id").agg(
        F.count("*").alias("_n"), (F.max("x") - F.min("x") + 1).alias("_ex"), (F.max("y") - F.min("y") + 1).alias("_ey")
    )
    ok = F.col("_n") >= n_min
    if n_max is not None:
        ok &= F.col("_n") <= n_max
    if extent is not None:
        ok &= (F.col("_ex") <= extent[0]) & (F.col("_ey") <= extent[1])
    return consecutive_labels(lab.join(s.filter(ok).select(*keys, "roi_id"), [*keys, "roi_id"], "left_semi"), keys, 1)


def similar_region(seeds: DataFrame, stack: DataFrame, keys: list[str], radius: float, threshold: float) -> DataFrame:
    """Connected pixels around each seed ``(keys, sx, sy)`` whose series correlates with the seed's."""
    near = stack.join(seeds, keys).filter(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= radius)
    seed = near.filter("x = sx and y = sy").select(*keys, "frame", F.col("v").alias("_s"))
    r = near.join(seed, [*keys, "frame"]).groupBy(*keys, "x", "y").agg(pearson("v", "_s").alias("_r"))
    m = r.filter(F.col("_r") >= threshold).select(*keys, "x", "y", F.lit(1).alias("roi_id"))
    lab = connected_components(m, keys, 4)
    hit = lab.join(seeds.select(*keys, F.col("sx").alias("x"), F.col("sy").alias("y")), [*keys, "x", "y"], "left_semi")
    return lab.join(hit.select(*keys, "roi_id"), [*keys, "roi_id"], "left_semi").select(*keys, "x", "y")


def circular_mask(discs: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """Pixels of a ``w x h`` image within ``r`` of the centre ``(cx, cy)``."""

    def axis(c: str, n: int) -> Column:
        lo, hi = F.greatest(F.ceil(F.col(c) - F.col("r")), F.lit(0)), F.least(F.floor(F.col(c) + F.col("r")), F.lit(n - 1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    d = discs.withColumn("x", F.explode(axis("cx", w))).withColumn("y", F.explode(axis("cy", h)))
    d = d.filter(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("r"))
    return d.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def remove_small(mask: DataFrame, keys: list[str], n: int) -> DataFrame:
    size = mask.groupBy(*keys, "roi_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n)
    return mask.join(size.select(*keys, "roi_id"), [*keys, "roi_id"], "left_semi")


def blank_artifact(mask: DataFrame, n: int) -> DataFrame:
    return mask.filter(F.col("x") >= n)


def clean_labels(mask: DataFrame, keys: list[str], n_artifact: int, n_min: int = 3, connectivity: int = 8) -> DataFrame:
    """Blank the artifact lines, split disconnected labels, drop small ones, number the rest."""
    lab = connected_components(blank_artifact(mask, n_artifact), keys, connectivity)
    return consecutive_labels(remove_small(lab, keys, n_min), keys, 1)


def drop_isolated(mask: DataFrame, keys: list[str], n_min: int = 3) -> DataFrame:
    """Drop pixels without a side neighbour of the same label, then labels with few pixels."""
    on = [*keys, "roi_id"]
    p = _pairs(mask, on, FOUR, [])
    near = p.select(*on, "x", "y").unionByName(p.select(*on, F.col("x_2").alias("x"), F.col("y_2").alias("y")))
    return remove_small(mask.join(near, [*on, "x", "y"], "left_semi"), keys, n_min)


def consecutive_labels(mask: DataFrame, keys: list[str], first: int = 0) -> DataFrame:
    """Labels renumbered without gaps, in their order."""
    ids = indexed(mask.select(*keys, "roi_id").distinct(), keys, ["roi_id"], "_k")
    d = mask.join(ids, [*keys, "roi_id"])
    return d.withColumn("roi_id", (F.col("_k") + first).cast("int")).drop("_k").select(*mask.columns)


def assign_to_centres(pixels: DataFrame, keys: list[str], cell_min: float, centre_min: float, size: int = 5, most: int | None = None) -> DataFrame:
    """Label cell pixels ``(cell, centre, ox, oy)`` by the centre nearest to their shifted position.

    Centres are cell pixels that are the maximum of their ``size x size`` window, at most one per
    half window and axis; with ``most`` only the best of an image (with ties) are used.
    """
    m = size // 2
    wx = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-m, m)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-m, m)
    d = pixels.withColumn("_mx", F.max("centre").over(wx)).withColumn("_top", F.max("_mx").over(wy))
    c = d.filter((F.col("centre") == F.col("_top")) & (F.col("centre") >= centre_min) & (F.col("cell") > cell_min) & (F.col("centre") > 0))
    if most is not None:
        c = c.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.col("centre").desc()))).filter(F.col("_r") <= most)
    arr = c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("x").alias("cx"), F.col("y").alias("cy")))).alias("_c"))
    j = pixels.filter(F.col("cell") > cell_min).join(arr, keys)

    def dist(p: Column) -> Column:
        ax, ay = p["cx"] - F.col("x") - F.col("ox"), p["cy"] - F.col("y") - F.col("oy")
        return F.struct(F.round(ax * ax + ay * ay, 9).alias("d"), p["cx"].alias("cx"), p["cy"].alias("cy"))

    best = F.array_min(F.transform("_c", dist))
    j = j.withColumn("_b", best).select(*keys, "x", "y", F.col("_b.cx").alias("cx"), F.col("_b.cy").alias("cy"))
    used = indexed(j.select(*keys, "cx", "cy").distinct(), keys, ["cx", "cy"], "_k")
    return j.join(used, [*keys, "cx", "cy"]).select(*keys, "x", "y", (F.col("_k") + 1).cast("int").alias("roi_id"))


def add_labels(new: DataFrame, old: DataFrame, keys: list[str], n_min: int = 3, connectivity: int = 8) -> DataFrame:
    """Old labels plus the parts of the new ones that neither overlap nor touch an old pixel."""
    around = old.select(*keys, "x", "y", F.explode(_offsets([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])).alias("_s"))
    around = around.select(*keys, (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"))
    free = new.join(around, [*keys, "x", "y"], "left_anti")
    lab = consecutive_labels(remove_small(connected_components(free, keys, connectivity), keys, n_min), keys, 1)
    top = old.groupBy(*keys).agg(F.max("roi_id").alias("_m"))
    lab = lab.join(top, keys, "left").withColumn("roi_id", (F.col("roi_id") + F.coalesce("_m", F.lit(0))).cast("int")).drop("_m")
    cols = [*keys, "x", "y", "roi_id"]
    return old.select(*cols).unionByName(lab.select(*cols))


def suggest_labels(pred: DataFrame, true: DataFrame, keys: list[str], iou: float = 0.1) -> DataFrame:
    """Predicted labels whose best overlap with a true label is below the limit."""
    best = label_iou(true, pred, keys).groupBy(*keys, F.col("roi_b").alias("roi_id")).agg(F.max("iou").alias("_best"))
    return pred.join(best.filter(F.col("_best") >= iou), [*keys, "roi_id"], "left_anti")


def mask_format(img: DataFrame, keys: list[str]) -> DataFrame:
    """Convert a full label image to positive labels and say which convention it had.

    Negative labels with background 0 or 1, or positive labels with background 0.
    """
    s = join_stats(img, keys, _lo=F.min("v"), _hi=F.max("v"))
    negative = F.col("_hi").isin(0, 1) & (F.col("_lo") <= 1)
    positive = (F.col("_lo") == 0) & (F.col("_hi") >= 0)
    kind = F.when(positive, "positive").when(negative, "negative").otherwise(F.raise_error(F.lit("unknown mask format")).cast("string"))
    label = F.when(positive, F.col("v")).when(F.col("v") == F.col("_hi"), 0).otherwise(-F.col("v"))
    return s.withColumn("format", kind).withColumn("roi_id", label).filter("roi_id != 0").select(*keys, "x", "y", "roi_id", "format")


def shift_mask(mask: DataFrame, shape: tuple[int, int], dx: Column | int, dy: Column | int, n_artifact: int = 0) -> DataFrame:
    """Shift labels inside the image; artifact lines are blank before and after the shift."""
    dx = dx if isinstance(dx, Column) else F.lit(dx)
    dy = dy if isinstance(dy, Column) else F.lit(dy)
    d = mask.filter(F.col("x") >= n_artifact).withColumn("_x", F.col("x") + dx).withColumn("_y", F.col("y") + dy)
    low = F.when(dx > 0, dx + n_artifact).otherwise(0)
    ok = (F.col("_x") >= low) & (F.col("_x") < shape[0]) & F.col("_y").between(0, shape[1] - 1)
    return d.filter(ok).withColumn("x", F.col("_x")).withColumn("y", F.col("_y")).drop("_x", "_y").select(*mask.columns)


def select_near(rois: DataFrame, keys: list[str], dist: str, area: str, limit: float, ok: Column) -> DataFrame:
    """Labels in order of distance until their total area has reached the limit."""
    d = scan(rois.filter(ok), keys, [dist, "roi_id"], _sum=("sum", F.col(area)))
    return d.filter(F.col("_sum") - F.col(area) < limit).drop("_sum")


def merge_rois(mask: DataFrame, chosen: DataFrame, keys: list[str], label: int = 1) -> DataFrame:
    """One label from the chosen ones; the others become background."""
    d = mask.join(chosen.select(*keys, "roi_id"), [*keys, "roi_id"], "left_semi")
    return d.withColumn("roi_id", F.lit(label)).select(*mask.columns)


def field_masks(masks: DataFrame, files: DataFrame, field: list[str], pres: str, nx: int, ny: int, max_shift: int, done: DataFrame | None = None) -> DataFrame:
    """Relation and shift of every presentation mask to the main mask of its field.

    ``files`` names the preferred presentation per field; ``done`` lists fields handled before.
    """
    if done is not None:
        masks = masks.join(done.select(*field), field, "left_anti")
    main = masks.join(files.select(*field, pres), [*field, pres], "left_semi").select(*field, "x", "y", "roi_id")
    every = masks.select(*field, pres).distinct()
    ref = every.join(main, field)
    return compare_masks(masks.select(*field, pres, "x", "y", "roi_id"), ref, [*field, pres], nx, ny, max_shift)


def resize_nearest(img: DataFrame, shape: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """Resample on a new grid by the nearest pixel; each source pixel lists the targets it serves."""

    def targets(c: str, n: int, m: int) -> Column:
        lo = F.ceil(F.col(c) * (m / n) - 0.5)
        hi = F.ceil((F.col(c) + 1) * (m / n) - 0.5) - 1
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    d = img.withColumn("_x", F.explode(targets("x", shape[0], out[0]))).withColumn("_y", F.explode(targets("y", shape[1], out[1])))
    return d.withColumn("x", F.col("_x").cast("int")).withColumn("y", F.col("_y").cast("int")).select(*img.columns)


def bilinear(img: DataFrame, keys: list[str], shape: tuple[int, int], out: tuple[int, int], start: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Values at ``start + o * step`` (in source pixels) by bilinear weights, edges held.

    Every source pixel adds its weighted value to the targets less than one pixel away.
    """
    d, w = img, F.lit(1.0)
    for a, n, m, c0, st in zip("xy", shape, out, start, step):
        lo = F.when(F.col(a) == 0, 0).otherwise(F.greatest(F.ceil((F.col(a) - 1 - c0) / st), F.lit(0)))
        hi = F.when(F.col(a) == n - 1, m - 1).otherwise(F.least(F.floor((F.col(a) + 1 - c0) / st), F.lit(m - 1)))
        seq = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
        d = d.withColumn(f"o{a}", F.explode(seq))
        at = F.least(F.greatest(F.col(f"o{a}") * st + c0, F.lit(0.0)), F.lit(n - 1.0))
        w = w * F.greatest(1 - F.abs(at - F.col(a)), F.lit(0.0))
    d = d.withColumn("_w", w).filter("_w > 0")
    return d.groupBy(*keys, F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def rescale(img: DataFrame, keys: list[str], shape: tuple[int, int], scale: float, order: int = 0) -> DataFrame:
    """Scaled image of size ``ceil(shape * scale)``, nearest (0) or bilinear (1); missing stays missing."""
    out = tuple(math.ceil(n * scale) for n in shape)
    near = resize_nearest(img.select(*keys, "x", "y", "v"), shape, out)
    if order == 0:
        return near
    step = tuple(n / m for n, m in zip(shape, out))
    lin = bilinear(img.fillna(0.0, ["v"]), keys, shape, out, tuple((s - 1) / 2 for s in step), step)
    return lin.join(near.filter("v is not null").select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")


def int_upscale(img: DataFrame, n: int) -> DataFrame:
    d = img
    for a in "xy":
        d = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(a, F.col(a) * n + F.col("_k"))
    return d.select(*img.columns)


def int_downscale(img: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Block means."""
    return img.groupBy(*keys, F.floor(F.col("x") / n).alias("x"), F.floor(F.col("y") / n).alias("y")).agg(F.avg("v").alias("v"))


def keep_lost_labels(before: DataFrame, after: DataFrame, keys: list[str], shape_b: tuple[int, int], shape_a: tuple[int, int]) -> DataFrame:
    """Labels lost by resizing come back as one pixel nearest to where their centre falls.

    A free pixel is preferred; an image without one gives a pixel of a label that has more. Each round every lost
    label asks for its nearest pixel, however far, and the smallest label asking for a pixel gets it; a label gives up one
    pixel a round, so it cannot vanish itself. If no pixel is left to give, that is an error. Written tables are small as files, not as
    rows, so their joins are shuffles: a round sends none of them through the driver.
    """
    cols = [*keys, "x", "y", "roi_id"]
    out = written(after.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "roi_id"))
    place = [F.greatest(F.least(F.avg(a) * (m / n), F.lit(float(m - 1))), F.lit(0.0)).alias(a) for a, n, m in zip("xy", shape_b, shape_a)]
    want = written(before.join(out.hint("merge"), [*keys, "roi_id"], "left_anti").groupBy(*keys, "roi_id").agg(*place))
    grid = want.select(*keys).distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(shape_a[0] - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(shape_a[1] - 1))))
    number = F.col("x") * shape_a[1] + F.col("y")
    while not want.isEmpty():
        free = written(grid.join(out.hint("merge"), [*keys, "x", "y"], "left_anti").withColumn("_n", number))
        given = join_stats(out.join(free.hint("merge"), keys, "left_anti"), [*keys, "roi_id"], _k=F.count("*")).filter("_k > 1")
        spare = free.withColumn("_held", F.lit(None).cast(out.schema["roi_id"].dataType)).unionByName(given.select(*keys, "x", "y", number.alias("_n"), F.col("roi_id").alias("_held")))
        ask = nearest_point(want, spare, [*keys, "roi_id"], ["x", "y"], "_n", keys=keys)
        won = ask.groupBy(*keys, "_n").agg(F.min("roi_id").alias("roi_id")).join(spare.hint("merge"), [*keys, "_n"])
        one = won.filter("_held is not null").groupBy(*keys, "_held").agg(F.min(F.struct("_n", "x", "y", "roi_id")).alias("_b"))
        won = won.filter("_held is null").select(*cols).unionByName(one.select(*keys, "_b.x", "_b.y", "_b.roi_id").select(*cols))
        won = written(won)
        if won.isEmpty():
            raise RuntimeError("no free pixel for a lost label")
        out = written(out.join(won.hint("merge"), [*keys, "x", "y"], "left_anti").select(*cols).unionByName(won))
        want = written(want.join(won.select(*keys, "roi_id").hint("merge"), [*keys, "roi_id"], "left_anti"))
    return out.select(*cols)


def blur2d(img: DataFrame, keys: list[str], sigma: float, truncate: float = 4.0, reflect: bool = False) -> DataFrame:
    """Gaussian blur line by line along both axes; whole images, edges held or mirrored."""
    k = gauss_kernel(sigma, truncate)
    d = fir(img, [*keys, "y"], k, "v", "v", "x", reflect)
    return fir(d, [*keys, "x"], k, "v", "v", "y", reflect).select(*img.columns)


def blur3d(stack: DataFrame, keys: list[str], sigma: float, power: float | None = None) -> DataFrame:
    """Blur along three axes (mirrored edges), scale to a maximum of one, raise to a power."""
    k, d = gauss_kernel(sigma), stack
    for a, others in (("x", ["y", "z"]), ("y", ["x", "z"]), ("z", ["x", "y"])):
        d = fir(d, [*keys, *others], k, "v", "v", a, True)
    d = join_stats(d, keys, _m=F.max("v")).withColumn("v", F.col("v") / nz(F.col("_m")))
    return d.withColumn("v", F.pow("v", F.lit(power)) if power is not None else F.col("v")).select(*stack.columns)


def dense_layers(stack: DataFrame, keys: list[str]) -> DataFrame:
    """Layers whose summed value is above the median layer."""
    s = stack.groupBy(*keys, "z").agg(F.sum("v").alias("_s"))
    return with_quantiles(s, keys, "_s", _m=0.5).filter(F.col("_s") > F.col("_m")).select(*keys, "z")


def weighted_z_max(stack: DataFrame, layers: DataFrame, keys: list[str], decay: float = 5.0, power: float = 2.0) -> DataFrame:
    """Per chosen layer ``z0``: maximum over z of the value times a weight falling with the distance."""
    at = layers.groupBy(*keys).agg(F.collect_set("z").alias("_z"))
    d = stack.join(at, keys).withColumn("z0", F.explode("_z"))
    w = F.exp(-F.pow(F.abs(F.col("z") - F.col("z0")) / decay, F.lit(power)))
    return d.groupBy(*keys, "z0", "x", "y").agg(F.max(F.col("v") * w).alias("v"))


def blend_stacks(stacks: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Colours of several stacks at a voxel, weighted by their values ``w``; black where all are zero."""
    tot = nz(F.sum("w"))
    return stacks.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("w") * F.col(c)) / tot, F.lit(0.0)).alias(c) for c in channels])


def project_z(stack: DataFrame, keys: list[str], nz_: int, channels: list[str], gamma: float = 2.0, off: float = 1.0) -> DataFrame:
    """Maximum over z with weights rising along z, cut to 0..1."""
    ws = [(k / max(nz_ - 1, 1) + off) ** gamma for k in range(nz_)]
    w = F.pow(F.col("z") / F.lit(float(max(nz_ - 1, 1))) + off, F.lit(gamma)) / (sum(ws) / nz_)
    return stack.groupBy(*keys, "x", "y").agg(*[F.least(F.greatest(F.max(F.col(c) * w), F.lit(0.0)), F.lit(1.0)).alias(c) for c in channels])


def template_threshold(img: DataFrame, keys: list[str]) -> DataFrame:
    """1 where the value is over the median plus a quarter of the spread, else 0; missing stays missing."""
    d = with_quantiles(join_stats(img, keys, _s=F.stddev_pop("v")), keys, "v", _m=0.5)
    on = (F.coalesce("v", F.lit(0.0)) > F.col("_m") + 0.25 * F.col("_s")).cast("double")
    return d.withColumn("v", F.when(F.col("v").isNotNull(), on)).select(*img.columns)


def template_scale(img: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the 20th percentile, divide by the 90th of the result (or its maximum), cut to 0..1."""
    d = with_quantiles(img, keys, "v", _lo=0.2).withColumn("v", F.col("v") - F.col("_lo"))
    d = join_stats(with_quantiles(d, keys, "v", _hi=0.9), keys, _mx=F.max("v"))
    s = F.when(F.col("_hi") > 0.1, F.col("_hi")).otherwise(nz(F.col("_mx")))
    return d.withColumn("v", F.least(F.greatest(F.col("v") / s, F.lit(0.0)), F.lit(1.0))).select(*img.columns)


def template_from_stack(stack: DataFrame, keys: list[str], n_artifact: int) -> DataFrame:
    """Mean over frames, z-scored below the artifact lines, missing inside them."""
    m = stack.groupBy(*keys, "x", "y").agg(F.avg("v").alias("v"))
    inner = F.when(F.col("x") >= n_artifact, F.col("v"))
    d = join_stats(m, keys, _m=F.avg(inner), _s=F.stddev_pop(inner))
    return d.select(*keys, "x", "y", ((inner - F.col("_m")) / nz(F.col("_s"))).alias("v"))


def voxelize(points: DataFrame, keys: list[str], scale: dict[str, float], shape: dict[str, int]) -> DataFrame:
    """Occupied voxels of points in micrometres, cut at the upper borders."""
    cols = [F.least(F.rint(F.col(a) / s), F.lit(float(shape[a] - 1))).cast("int").alias(a) for a, s in scale.items()]
    return points.select(*keys, *cols).distinct()


def soma_ellipsoid(somas: DataFrame, keys: list[str], scale: tuple[float, float, float], radius: tuple[float, float, float], shape: tuple[int, int]) -> DataFrame:
    """Voxels of an ellipsoid around each soma, layer by layer."""
    r = [int(round(a / s)) for a, s in zip(radius, scale)]
    d = somas.select(*keys, *[F.rint(F.col(a) / s).cast("int").alias(f"_c{a}") for a, s in zip("xyz", scale)])
    for a, n in zip("xyz", (r[0], r[1], r[2] - 1)):
        d = d.withColumn(f"_d{a}", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    f = F.pow(F.col("_dz") / r[2] * r[0], 2)
    inside = F.pow(F.col("_dx"), 2) / (r[0] ** 2 - f) + F.pow(F.col("_dy"), 2) / (r[1] ** 2 - f) < 1
    d = d.filter(inside).select(*keys, *[(F.col(f"_c{a}") + F.col(f"_d{a}")).alias(a) for a in "xyz"])
    return d.filter(F.col("x").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1))


def level_regions(img: DataFrame, keys: list[str], levels: list[float], pixel_um: float) -> DataFrame:
    """Per level of the maximum: regions above it by size, area, diameter and share of all.

    Areas are pixel counts; they stand in for contour polygons. The largest region has place 1.
    """
    d = join_stats(img, keys, _m=F.max(F.abs("v"))).withColumn("level", F.explode(F.array(*[F.lit(l) for l in levels])))
    d = d.filter(F.col("v") >= F.col("level") * F.col("_m")).withColumn("roi_id", F.lit(1))
    lk = [*keys, "level"]
    n = connected_components(d, lk, 4).groupBy(*lk, "roi_id").agg(F.count("*").alias("n"))
    n = join_stats(n, lk, _t=F.sum("n"), n_regions=F.count("*")).withColumn("_o", -F.col("n"))
    n = indexed(n, lk, ["_o", "roi_id"], "_p")
    area = F.col("n") * pixel_um**2
    return n.select(
        *lk, (F.col("_p") + 1).alias("place"), "n", area.alias("area_um2"), (2 * F.sqrt(area / math.pi)).alias("dia_um"),
        (F.col("n") / F.col("_t")).alias("share"), (F.col("n_regions") == 1).alias("single"),
    )


def region_moments(region: DataFrame, keys: list[str]) -> DataFrame:
    """Area and centroid of each region's pixels."""
    return region.groupBy(*keys).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def region_irregularity(region: DataFrame, keys: list[str]) -> DataFrame:
    """1 minus area over convex hull area, the hull taken around whole pixels; with the centroid.

    Pixels share corners; the hull drops the copies, so they are not aggregated before the shuffle.
    """
    from .trees import hull_area

    corners = region.withColumn("_s", F.explode(_offsets([(0, 0), (1, 0), (0, 1), (1, 1)])))
    corners = corners.select(*keys, (F.col("x") + F.col("_s.dx")).cast("double").alias("x"), (F.col("y") + F.col("_s.dy")).cast("double").alias("y"))
    d = region_moments(region, keys).join(hull_area(corners, keys).select(*keys, "hull_area"), keys)
    return d.withColumn("irregularity", 1 - F.col("area") / F.col("hull_area"))


def center_surround_masks(region: DataFrame, keys: list[str], shape: tuple[int, int], inner: int, outer: int) -> DataFrame:
    """Every pixel of the image as center, gap (within ``inner``), surround (within ``outer``) or outside.

    Each region pixel reaches the pixels of its outer disc; the nearest one decides.
    """
    disc = [(a, b) for a in range(-outer, outer + 1) for b in range(-outer, outer + 1) if a * a + b * b < outer * outer]
    d = region.select(*keys, "x", "y", F.explode(_offsets(disc)).alias("_s"))
    sq = F.col("_s.dx") * F.col("_s.dx") + F.col("_s.dy") * F.col("_s.dy")
    d = d.select(*keys, (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"), sq.alias("_d"))
    d = d.filter(F.col("x").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1)).groupBy(*keys, "x", "y").agg(F.min("_d").alias("_d"))
    grid = region.select(*keys).distinct()
    for a, n in zip("xy", shape):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part = F.when(F.col("_d") == 0, "center").when(F.col("_d") < inner * inner, "gap").when(F.col("_d").isNotNull(), "surround").otherwise("outside")
    return grid.join(d, [*keys, "x", "y"], "left").select(*keys, "x", "y", part.alias("part"))


def center_surround_index(img: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over the center, the surround, and all outside the inner disc, each over the absolute sum."""
    d = img.join(parts, [*keys, "x", "y"])
    tot = nz(F.sum(F.abs("v")))

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("v")).otherwise(0.0)) / tot

    p = F.col("part")
    return d.groupBy(*keys).agg(
        share(p == "center").alias("center_index"), share(p == "surround").alias("surround_index"), share(p.isin("surround", "outside")).alias("full_surround_index")
    )


def gray_frames(video: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean of two channels over 255, z-scored over the whole video."""
    d = video.withColumn("v", (F.col(a) + F.col(b)) / 2 / 255)
    d = join_stats(d, keys, _m=F.avg("v"), _s=F.stddev_pop("v"))
    return d.withColumn("v", (F.col("v") - F.col("_m")) / nz(F.col("_s"))).drop("_m", "_s", a, b)


def resample_frames(video: DataFrame, keys: list[str], shape: tuple[int, int], centre: tuple[float, float], size: tuple[float, float], step: float) -> DataFrame:
    """Crop around a centre and interpolate to a new pixel size, all lengths in source pixels.

    Bilinear; only the part of the crop inside the frames is returned.
    """
    out, start = [], []
    for c, w, n in zip(centre, size, shape):
        lo, hi = max(c - w / 2, 0.0), min(c + w / 2, n - 1.0)
        out.append(int(math.floor((hi - lo) / step + 1e-9)) + 1)
        start.append(lo)
    return bilinear(video, keys, shape, tuple(out), tuple(start), (step, step))
