"""Scalar, string, date, array and map functions, and per-key normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantile import with_quantiles
from ..plans.stats import join_stats, pearson


def normalize(df: DataFrame, keys: list[str], value: str, kind: str, name: str) -> DataFrame:
    """Scale a value per key: zero_one, amp_one, std_one, zscore or none."""
    v = F.col(value)
    if kind == "none":
        return df.withColumn(name, v)
    aggs, out = {
        "zero_one": ({"_a": F.min(v), "_b": F.max(v)}, (v - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))),
        "amp_one": ({"_a": F.max(F.abs(v))}, v / F.nullif(F.col("_a"), F.lit(0.0))),
        "std_one": ({"_a": F.stddev_pop(v)}, v / F.nullif(F.col("_a"), F.lit(0.0))),
        "zscore": ({"_a": F.avg(v), "_b": F.stddev_pop(v)}, (v - F.col("_a")) / F.nullif(F.col("_b"), F.lit(0.0))),
    }[kind]
    return join_stats(df, keys, **aggs).withColumn(name, out).drop(*aggs)


def normalize_soft(df: DataFrame, keys: list[str], value: str, name: str, dq: float = 5.0, clip: bool = True) -> DataFrame:
    """Scale between two percentiles, optionally clipped to 0..1."""
    d = with_quantiles(df, keys, value, _lo=dq / 100, _hi=1 - dq / 100)
    out = (F.col(value) - F.col("_lo")) / F.nullif(F.abs(F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return d.withColumn(name, F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clip else out).drop("_lo", "_hi")


def normalize_stack(df: DataFrame, keys: list[str], value: str, name: str, q_low: float = 5.0, q_high: float = 0.05) -> DataFrame:
    """Subtract a low percentile, floor at 0, divide by a high percentile of the result, cap at 1."""
    low = with_quantiles(df, keys, value, _lo=q_low / 100).withColumn("_f", F.greatest(F.col(value) - F.col("_lo"), F.lit(0.0)))
    high = with_quantiles(low, keys, "_f", _hi=1 - q_high / 100)
    out = F.least(F.col("_f") / F.nullif(F.col("_hi"), F.lit(0.0)), F.lit(1.0))
    return high.withColumn(name, out).drop("_lo", "_f", "_hi")


def normalize_stimulus(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A 0/1 stimulus becomes -1/+1, any other a z-score."""
    v = F.col(value)
    aggs = {
        "_bin": F.bool_and(v.isin(0.0, 1.0)) & (F.min(v) == 0) & (F.max(v) == 1),
        "_m": F.avg(v),
        "_s": F.stddev_pop(v),
    }
    out = F.when(F.col("_bin"), 2 * v - 1).otherwise((v - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return join_stats(df, keys, **aggs).withColumn(name, out).drop(*aggs)


def rotate(x: Column, y: Column, degrees: Column | float, cx=0.0, cy=0.0, dx=0.0, dy=0.0) -> tuple[Column, Column]:
    """Rotate points around a centre, then shift them."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    px, py = x - cx, y - cy
    return F.cos(a) * px - F.sin(a) * py + cx + dx, F.sin(a) * px + F.cos(a) * py + cy + dy


def anatomical_position(x: Column, y: Column, rotation: Column, eye: Column) -> tuple[Column, Column]:
    """Ventral-dorsal and temporal-nasal position; null for an unknown eye or rotation -1."""
    rx, ry = rotate(x, y, -rotation)
    known = rotation != -1
    vd = F.when(known, -rx)
    tn = F.when(known & (eye == "right"), ry).when(known & (eye == "left"), -ry)
    return vd, tn


def relative_position(df: DataFrame, origin: DataFrame, keys: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns minus their origin, ``new=(column, origin column)``."""
    return df.join(origin, keys).withColumns({n: F.col(c) - F.col(o) for n, (c, o) in cols.items()})


def first_available(df: DataFrame, keys: list[str], sources: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Values of the first source holding the key, with its name; keys without any are dropped."""
    out = df
    for n, s in sources.items():
        out = out.join(s.select(*keys, F.struct(*cols, F.lit(n).alias("source_name")).alias(f"_s_{n}")), keys, "left")
    out = out.withColumn("_hit", F.coalesce(*[F.col(f"_s_{n}") for n in sources])).filter("_hit is not null")
    return out.select(*df.columns, "_hit.*")


# Field of view in micrometres by setup.
SETUP_WIDTH_UM = {1: 112.0, 2: 71.5, 3: 71.5}


def pixel_size(setup: Column, npix: Column, zoom: Column) -> Column:
    """Micrometres per pixel; values outside the allowed ranges are an error."""
    scale = F.try_element_at(F.create_map(*[F.lit(x) for kv in SETUP_WIDTH_UM.items() for x in kv]), setup)
    ok = scale.isNotNull() & zoom.between(0.15, 4) & (npix >= 1) & (npix < 5000)
    return F.when(ok, scale / npix / zoom).otherwise(F.raise_error(F.lit("setup, pixel count or zoom out of range")).cast("double"))


def scan_type(nx: Column, ny: Column, nz: Column) -> Column:
    known = F.when((nx > 1) & (ny > 1) & (nz <= 1), "xy").when((nx > 1) & (ny <= 1) & (nz > 1), "xz")
    return known.when((nx > 1) & (ny > 1) & (nz > 1), "xyz")


def scan_rate(nx: Column, ny: Column, pixel_us: Column) -> dict[str, Column]:
    """Line duration and scan period in seconds and their frequency; null if a part is missing."""
    line = nx * pixel_us * F.lit(1e-6)
    return {"line_duration": line, "scan_period": line * ny, "scan_frequency": 1.0 / F.nullif(line * ny, F.lit(0.0))}


def trigger_units(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Times that look like frame counts (first over 250, last over 1000) are converted to seconds."""
    d = join_stats(df, keys, _a=F.min(t), _b=F.max(t))
    return d.withColumn(t, F.when((F.col("_a") > 250) & (F.col("_b") > 1000), F.col(t) / 500.0).otherwise(F.col(t))).drop("_a", "_b")


def equiv_diameter(area: Column) -> Column:
    return 2.0 * F.sqrt(area / F.pi())


def offset_from_centre(x: Column, y: Column, nx: Column | float, ny: Column | float, pixel_um, dx=0.0, dy=0.0) -> dict[str, Column]:
    """Offset of a pixel position from the image centre, pixel centres at half."""
    ox = (x + 0.5 - F.lit(nx) / 2.0) * pixel_um + dx
    oy = (y + 0.5 - F.lit(ny) / 2.0) * pixel_um + dy
    return {"dx_um": ox, "dy_um": oy, "d_um": F.sqrt(ox * ox + oy * oy)}


def stack_to_um(df: DataFrame, scale: DataFrame, keys: list[str], axes: dict[str, str]) -> DataFrame:
    """Voxel positions times the step of their stack, ``axis=step column``."""
    return df.join(scale, keys).withColumns({f"{a}_um": F.col(a) * F.col(s) for a, s in axes.items()})


def name_part(name: Column, sep: str, n: int) -> Column:
    """The n-th part (from 0; negative from the end) of a split name, null if missing."""
    return F.try_element_at(F.split(name, sep), F.lit(n + 1 if n >= 0 else n))


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def date_parts(id_: Column) -> dict[str, Column]:
    """``yyyymmdd`` prefix as a date, the rest after a separator as a number."""
    d = F.concat_ws("-", F.substring(id_, 1, 4), F.substring(id_, 5, 2), F.substring(id_, 7, 2))
    return {"day": F.to_date(d), "number": F.substring(id_, 10, 12).try_cast("int")}


def copy_parent_metrics(df: DataFrame, metrics: DataFrame, key: str, suffix: str) -> DataFrame:
    """Metrics of the row whose key lacks the suffix."""
    m = metrics.withColumnRenamed(key, "_parent")
    return df.withColumn("_parent", strip_suffix(F.col(key), suffix)).join(m, "_parent", "left").drop("_parent")


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sigmoid5(x: Column, k=1.0, q=1.0, b=1.0, v=1.0, d=0.0) -> Column:
    """Generalised logistic; the exponent is 1 / exp(v)."""
    return k / F.pow(1.0 + q * F.exp(-b * (x - d)), F.lit(1.0 / math.exp(v)))


def skew_transform(x: Column) -> Column:
    return 1.0 / F.nullif(1.0 - x, F.lit(0.0))


def skew_inverse(z: Column) -> Column:
    return 1.0 - 1.0 / F.nullif(z, F.lit(0.0))


def mixed_loss(y: str, p: str, alpha: float = 0.5) -> Column:
    """Weighted sum of half the mean squared error and of one minus the correlation."""
    diff = F.abs(F.avg(F.pow(F.col(y) - F.col(p), 2))) / 2.0
    return alpha * diff + (1 - alpha) * (1.0 - pearson(y, p))


def radial_profile(d: Column, std: float, cut: float | None = None, scale: float = 1.0) -> Column:
    """Gaussian of the distance, zero beyond the cut."""
    g = F.lit(scale) * F.exp(-0.5 * F.pow(d / std, 2)) if std > 0 else F.lit(0.0)
    return g if cut is None else F.when(d > cut, 0.0).otherwise(g)


def normalized_weights(df: DataFrame, keys: list[str], weight: Column, name: str, total: float = 1.0) -> DataFrame:
    """Weights scaled to a sum; all-zero weights stay zero. ``weight`` may be any Column expression."""
    d = join_stats(df.withColumn("_w", weight), keys, _s=F.sum("_w"))
    return d.withColumn(name, F.when(F.col("_s") > 0, total * F.col("_w") / F.col("_s")).otherwise(F.col("_w"))).drop("_w", "_s")


def cosine_profile(d: Column, width_c: float, power_c: float, width_s: float, power_s: float) -> Column:
    """Positive cosine centre and negative cosine surround at a distance."""
    c = F.when(F.abs(d) <= width_c, F.pow(0.5 * F.cos(d * math.pi / width_c) + 0.5, F.lit(power_c))).otherwise(0.0)
    if width_s <= 0:
        return c
    ring = (F.abs(d) > width_c) & (d <= width_c + 2 * width_s) & (d >= -width_c - 2 * width_s)
    base = 0.5 * F.cos((d - width_c) * math.pi / width_s + math.pi) + 0.5
    return c - F.when(ring, F.pow(base, F.lit(power_s))).otherwise(0.0)


def center_surround_profile(df: DataFrame, keys: list[str], d: str, name: str, width_c, power_c, width_s, power_s, weight_c=1.0, weight_s=1.0) -> DataFrame:
    """Cosine profile with the centre and the surround each scaled to a total weight."""
    z = F.col("_z")
    m = df.withColumn("_z", cosine_profile(F.col(d), width_c, power_c, width_s, power_s))
    m = join_stats(m, keys, _p=F.sum(F.greatest(z, F.lit(0.0))), _n=F.sum(F.greatest(-z, F.lit(0.0))))
    out = F.when(z > 0, z * weight_c / F.col("_p")).when(z < 0, z * weight_s / F.col("_n")).otherwise(0.0)
    return m.withColumn(name, out).drop("_z", "_p", "_n")


def _steps(lo: Column, hi: Column, first: Column, step: float) -> Column:
    a, b = F.ceil((lo - first) / step), F.floor((hi - first) / step)
    return F.when(a <= b, F.transform(F.sequence(a, b), lambda k: k.cast("double") * step + first)).otherwise(F.array().cast("array<double>"))


def square_grid(boxes: DataFrame, keys: list[str], cdist: float, border: float = 0.0) -> DataFrame:
    """Centres of a square grid around the middle of each box (``x0 x1 y0 y1``).

    The number of columns serves both axes, as in the rule this follows.
    """
    n = F.floor((F.abs(F.col("x1") - F.col("x0")) - 2 * border) / cdist)
    axis = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: (k - (n - 1) / 2.0) * cdist)
    g = boxes.filter(n > 0).withColumn("cx", F.explode(axis))
    return g.withColumn("cy", F.explode(axis)).select(*keys, "cx", "cy")


def hex_grid(boxes: DataFrame, keys: list[str], area: float, border: float | None = None) -> DataFrame:
    """Hexagon centres inside each box; the middle of a cell lies on the origin column and row."""
    ri = math.sqrt(area / (2 * math.sqrt(3)))
    ru = ri * 2 / math.sqrt(3)
    b = ru if border is None else border
    y0, y1 = F.col("y0") + b, F.col("y1") - b
    g = boxes.withColumn("_k0", F.ceil(y0 / ri)).withColumn("_k1", F.floor(y1 / ri)).filter("_k0 <= _k1")
    g = g.withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    first = F.when((F.col("_k") - F.col("_k0")) % 2 == 0, 0.0).otherwise(1.5 * ru)
    g = g.withColumn("cx", F.explode(_steps(F.col("x0") + b, F.col("x1") - b, first, 3 * ru)))
    return g.select(*keys, "cx", (F.col("_k") * ri).alias("cy"))


def hex_corners(grid: DataFrame, area: float) -> DataFrame:
    """Six corners per hexagon centre, numbered from the upper left on."""
    ri = math.sqrt(area / (2 * math.sqrt(3)))
    ru = ri * 2 / math.sqrt(3)
    around = [(-ru / 2, ri), (ru / 2, ri), (ru, 0.0), (ru / 2, -ri), (-ru / 2, -ri), (-ru, 0.0)]
    pts = F.array(*[F.struct((F.col("cx") + dx).alias("hx"), (F.col("cy") + dy).alias("hy")) for dx, dy in around])
    return grid.select("*", F.posexplode(pts).alias("corner", "_p")).select(*grid.columns, "corner", "_p.*")


def array_pick(arr: Column, i: int) -> Column:
    """Element i (from 0) or null."""
    return F.get(arr, i)


def explode_zip(df: DataFrame, keep: list[str], cols: list[str], pos: str = "j") -> DataFrame:
    """Explode parallel arrays together, cut to the shortest."""
    n = F.least(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])
    z = F.arrays_zip(*[F.slice(F.col(c), F.lit(1), n).alias(c) for c in cols])
    return df.select(*keep, F.posexplode(z).alias(pos, "_z")).select(*keep, pos, *[F.col(f"_z.{c}").alias(c) for c in cols])


def all_finite(arr: Column) -> Column:
    """True if no element is null, NaN or infinite; an empty array is not present."""
    good = F.forall(arr, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(arr) > 0), F.lit(False))


def map_get_default(m: Column, key: Column | str, default) -> Column:
    return F.coalesce(F.try_element_at(m, key if isinstance(key, Column) else F.lit(key)), F.lit(default))


def ordered_fetch(df: DataFrame, cols: list[str], first: int) -> DataFrame:
    """The first rows in the order of ``cols`` with their position (a top-k report)."""
    top = df.orderBy(*cols).limit(first)
    w = Window.partitionBy(F.lit(0)).orderBy(*cols)
    return top.withColumn("position", F.row_number().over(w))


def sort_levels(df: DataFrame, *cols: str) -> DataFrame:
    """Sort by several columns; a leading minus sorts downwards."""
    return df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in cols])


def random_rows(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows chosen by a seeded hash of the key (MD5), the same on every run and in any engine (a sampling operator)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def stack_rows(df: DataFrame, keys: list[str], pos: str, value: str, mode: str, rtol: float = 0.05) -> DataFrame:
    """Equal-length vectors: cut to the shortest (error if lengths differ too much) or fill with null to the longest."""
    sizes = df.groupBy(*keys).agg((F.max(pos) + 1).alias("_n"))
    lim = sizes.agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.avg("_n").alias("_av"))
    if mode == "truncate":
        far = (F.col("_hi") - F.col("_lo")) / F.col("_av") > rtol
        ok = F.when(far, F.raise_error(F.lit("vector lengths differ too much")).cast("boolean")).otherwise(F.col(pos) < F.col("_lo"))
        return df.crossJoin(F.broadcast(lim)).filter(ok).select(*keys, pos, value)
    if mode != "pad":
        raise ValueError(mode)
    tail = sizes.crossJoin(F.broadcast(lim)).filter("_n < _hi")
    tail = tail.withColumn(pos, F.explode(F.sequence(F.col("_n"), F.col("_hi") - 1)))
    return df.select(*keys, pos, value).unionByName(
        tail.select(*keys, F.col(pos).cast(df.schema[pos].dataType), F.lit(None).cast("double").alias(value))
    )
