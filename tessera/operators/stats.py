"""Aggregations, selections, rank tests and scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rotate
from ..functions.special import chi2_sf, normal_sf, t_sf
from ..plans.quantile import quantiles, rank_table, with_quantiles
from ..plans.scan import indexed, largest, scan
from ..plans.stats import join_stats, nz, pearson
from ..session import once, written


def largest_first(df: DataFrame, by: list[str], col: str, ties: list[str], first: int) -> DataFrame:
    """The ``first`` largest rows per group, numbered; the first is the main one.

    A rank filter right after ``row_number`` lets Spark keep only that many rows per group on the
    map side (window group limit), so a hot group is not shuffled whole.
    """
    w = Window.partitionBy(*by).orderBy(F.col(col).desc(), *ties)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first)


def roi_traces(pixels: DataFrame, mask: DataFrame, keys: list[str], frame_times: DataFrame, offsets: DataFrame) -> DataFrame:
    """Mean over a label's pixels per frame, at the frame time plus the label's median pixel offset."""
    y = pixels.join(mask, [*keys, "x", "y"]).groupBy(*keys, "roi_id", "frame").agg(F.avg("v").alias("y"))
    med = quantiles(mask.join(offsets, [*keys, "x", "y"]), [*keys, "roi_id"], "offset", _off=0.5)
    d = y.join(frame_times, [*keys, "frame"]).join(med, [*keys, "roi_id"])
    return d.select(*keys, "roi_id", "frame", (F.col("t") + F.col("_off")).alias("t"), "y")


def roi_stats(mask: DataFrame, keys: list[str], n_artifact: int, step_x: float, step_y: float) -> DataFrame:
    """Pixel count, area, equivalent diameter, and whether a pixel lies in the artifact lines."""
    d = mask.groupBy(*keys, "roi_id").agg(F.count("*").alias("roi_size"), F.max((F.col("x") < n_artifact).cast("int")).alias("artifact_flag"))
    area = F.col("roi_size") * step_x * step_y
    return d.withColumn("roi_size_um2", area).withColumn("roi_dia_um", 2 * F.sqrt(area / math.pi))


def roi_ids(mask: DataFrame, keys: list[str], n_artifact: int = 0) -> DataFrame:
    """Labels found below the artifact lines, numbered by their id."""
    ids = mask.filter(F.col("x") >= n_artifact).select(*keys, "roi_id").distinct()
    return indexed(ids, keys, ["roi_id"], "place", bound=None)


def roi_centroid(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.groupBy(*keys, "roi_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def roi_offset(mask: DataFrame, keys: list[str], shape: tuple[int, int], pixel_um: float, angle: float) -> DataFrame:
    """Centroid relative to the image centre in micrometres, rotated, with its distance."""
    c = roi_centroid(mask, keys)
    dx, dy = rotate((F.col("cx") - shape[0] / 2) * pixel_um, (F.col("cy") - shape[1] / 2) * pixel_um, angle)
    d = c.select(*keys, "roi_id", dx.alias("dx_um"), dy.alias("dy_um"))
    return d.withColumn("d_um", F.sqrt(F.col("dx_um") * F.col("dx_um") + F.col("dy_um") * F.col("dy_um")))


def stack_median(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Median over frames per pixel and channel."""
    return quantiles(pixels, [*keys, "x", "y"], "v", v=0.5)


def aligned_times(snips: DataFrame, keys: list[str], tol: float = 1e-4) -> DataFrame:
    """Mean time since the start of a repetition per position, and whether the spread is within ``tol``."""
    d = join_stats(snips, [*keys, "rep"], _t0=F.min("t")).withColumn("_r", F.col("t") - F.col("_t0"))
    return d.groupBy(*keys, "j").agg(F.avg("_r").alias("t"), (F.stddev_pop("_r") <= tol).alias("consistent"))


def average_snippets(snips: DataFrame, keys: list[str]) -> DataFrame:
    """Mean response per position over repetitions, and scaled to an absolute maximum of one."""
    snips = once(snips)
    a = aligned_times(snips, keys).select(*keys, "j", "t")
    m = snips.groupBy(*keys, "j").agg(F.avg("y").alias("avg"))
    d = join_stats(m.join(a, [*keys, "j"]), keys, _a=F.max(F.abs("avg")))
    return d.withColumn("avg_norm", F.col("avg") / nz(F.col("_a"))).drop("_a")


def relative_triggers(snip_triggers: DataFrame, keys: list[str]) -> DataFrame:
    """Mean trigger times since the first trigger of their repetition."""
    d = join_stats(snip_triggers, [*keys, "rep"], _t0=F.min(F.when(F.col("k") == 0, F.col("t"))))
    return d.groupBy(*keys, "k").agg(F.avg(F.col("t") - F.col("_t0")).alias("t"))


def repeat_quality(snips: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of the mean response over the mean variance of the repetitions; floor one over repetitions."""
    snips = once(snips)
    mean = snips.groupBy(*keys, "j").agg(F.avg("y").alias("_m")).groupBy(*keys).agg(F.var_pop("_m").alias("_a"))
    reps = snips.groupBy(*keys, "rep").agg(F.var_pop("y").alias("_v")).groupBy(*keys).agg(F.avg("_v").alias("_b"), F.count("*").alias("_n"))
    return mean.join(reps, keys).select(*keys, (F.col("_a") / nz(F.col("_b"))).alias("qidx"), (1.0 / F.col("_n")).alias("min_qidx"))


def quality_summary(qi: DataFrame, by: list[str], col: str = "qidx") -> DataFrame:
    return qi.groupBy(*by).agg(F.avg(col).alias("mean"), F.min(col).alias("lowest"), F.max(col).alias("highest"))


def event_fraction(samples: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Share of samples above zero."""
    return samples.groupBy(*keys).agg(F.avg((F.col(value) > 0).cast("double")).alias("fraction"))


def group_offset(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Subtract the group median from each column (``<col>_rel``)."""
    out = df
    for c in cols:
        out = with_quantiles(out, by, c, _m=0.5).withColumn(f"{c}_rel", F.col(c) - F.col("_m")).drop("_m")
    return out


def median_member(df: DataFrame, by: list[str], col: str, ties: list[str]) -> DataFrame:
    """The row of each group closest to its median."""
    d = with_quantiles(df, by, col, _m=0.5)
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(F.abs(F.col(col) - F.col("_m")), *ties))
    return d.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def best_per_group(df: DataFrame, by: list[str], col: str, ties: list[str], largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) value per group, smallest tie columns first."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct((-F.col(col) if largest else F.col(col)).alias("_v"), *ties)
    return df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_b")).select(*by, "_b.*")


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts per row and listed column value, zero where there is none."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)


def share_within_group(df: DataFrame, group: list[str], category: str) -> DataFrame:
    n = df.groupBy(*group, category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def share_below(df: DataFrame, by: str, col: str, threshold: float) -> DataFrame:
    """Share of rows under the threshold per group, and overall (group null)."""
    return df.rollup(by).agg(F.avg((F.col(col) < threshold).cast("double")).alias("share"))


def pivot_mean(df: DataFrame, row: list[str], col: str, values: list, value: str) -> DataFrame:
    return df.groupBy(*row).pivot(col, values).agg(F.avg(value))


def group_means(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def binned_error(df: DataFrame, x: str, err: str, edges: list[float]) -> DataFrame:
    """Mean per bin; bins are closed at both ends, so a value on an inner edge counts in two."""
    bins = F.array(*[F.struct(F.lit(n).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])
    d = df.withColumn("_b", F.explode(F.filter(bins, lambda b: (F.col(x) >= b["lo"]) & (F.col(x) <= b["hi"]))))
    return d.groupBy("_b.bin").agg(F.avg(err).alias("error"), F.count("*").alias("n"))


def bin_index(x: Column, bins: int, lo: Column | float, hi: Column | float) -> Column:
    """Equal-width bin from 0, the last one closed; null outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    k = F.floor((x - lo) / ((hi - lo) / bins))
    return F.when((x >= lo) & (x <= hi), F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float, by: str) -> DataFrame:
    """Counts per class and bin beside the counts of all data scaled to the size of the class."""
    d = df.select(F.col(by), bin_index(F.col(col), bins, lo, hi).alias("bin"))
    per = d.groupBy(by, "bin").agg(F.count("*").alias("n"))
    size = per.groupBy(by).agg(F.sum("n").alias("_size"))
    alld = per.groupBy("bin").agg(F.sum("n").alias("_all"))
    total = per.agg(F.sum("n").alias("_total"))
    grid = size.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    g = grid.join(per, [by, "bin"], "left").join(alld, "bin", "left").crossJoin(F.broadcast(total)).fillna(0, ["n", "_all"])
    return g.select(by, "bin", "n", (F.col("_all") * F.col("_size") / F.col("_total")).alias("n_all_scaled"))


def padded_range(df: DataFrame, by: list[str], col: str, q: float = 0.01) -> DataFrame:
    lo, hi = F.min(col), F.max(col)
    return df.groupBy(*by).agg((lo - q * (hi - lo)).alias("lo"), (hi + q * (hi - lo)).alias("hi"))


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson r, its square and the regression line, rows with a null left out."""
    d = df.dropna(subset=[x, y])
    r = pearson(x, y)
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), r.alias("r"), (r * r).alias("r2"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def _rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Per group: size and rank sum; one row: number of rows and the tie term."""
    t = rank_table(df, value, group)
    g = t.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    # The share of a group in its ties adds up to ties^3 - ties once per value.
    x = F.col("ties").cast("double")
    one = t.agg(F.sum("n").cast("double").alias("n_all"), F.sum((x * x - 1) * F.col("n")).alias("tie_term"))
    return g, one


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction and its chi-square probability, over the whole table."""
    g, one = _rank_sums(df, value, group)
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_s"), F.count("*").alias("k")).crossJoin(F.broadcast(one))
    n = F.col("n_all")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("tie_term") / (n * n * n - n))
    d = s.select(h.alias("h"), (F.col("k") - 1).alias("df"))
    return d.withColumn("p", chi2_sf(F.col("h"), F.col("df")))


def dunn_posthoc(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rank z-tests of every two groups (one row per group goes in), Benjamini-Hochberg adjusted.

    The result has a row per pair; ranks and running minima over them are ordered scans.
    """
    g, one = _rank_sums(df, value, group)
    g = g.select(group, "n", (F.col("r") / F.col("n")).alias("m"))
    b = g.select(F.col(group).alias("group_b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    pairs = g.join(b, F.col(group) < F.col("group_b")).crossJoin(F.broadcast(one))
    n = F.col("n_all")
    var = (n * (n + 1) / 12 - F.col("tie_term") / (12 * (n - 1))) * (1 / F.col("n") + 1 / F.col("nb"))
    z = F.abs(F.col("m") - F.col("mb")) / F.sqrt(var)
    d = pairs.select(F.col(group).alias("group_a"), "group_b", z.alias("z"))
    d = d.withColumn("p", 2 * normal_sf(F.col("z")))
    d = indexed(d.withColumn("_o", F.coalesce("p", F.lit(-1.0))), [], ["_o", "group_a", "group_b"], "_k")
    d = join_stats(d, [], _m=F.count("*")).withColumn("_back", F.col("_m") - F.col("_k"))
    # The smallest adjusted value of this and all larger ones, as a running maximum from the end.
    d = scan(d, [], ["_back"], _least=("max", -F.col("p") * F.col("_m") / (F.col("_k") + 1)))
    return d.select("group_a", "group_b", "z", "p", F.least(-F.col("_least"), F.lit(1.0)).alias("p_adj"))


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sided rank test of two groups: U of the first, normal approximation with ties and continuity."""
    g, one = _rank_sums(df.filter(F.col(group).isin(a, b)), value, group)
    s = g.agg(
        F.max(F.when(F.col(group) == a, F.col("n"))).alias("n1"), F.max(F.when(F.col(group) == b, F.col("n"))).alias("n2"),
        F.max(F.when(F.col(group) == a, F.col("r"))).alias("r1"),
    ).crossJoin(F.broadcast(one))
    n, n1, n2 = F.col("n_all"), F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("tie_term") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    d = s.select(u.alias("u"), z.alias("z"))
    return d.withColumn("p", F.least(2 * normal_sf(F.col("z")), F.lit(1.0)))


def permutation_p(scores: DataFrame, true: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """One-sample t of the permuted scores against the true one.

    A correlation asks if the permuted ones are smaller, an mse if they are larger, others for both.
    """
    s = scores.groupBy(*keys).agg(F.avg("score").alias("_m"), F.stddev_samp("score").alias("_sd"), F.count("*").alias("_n"))
    d = s.join(true, keys).withColumn("t", (F.col("_m") - F.col("true_score")) / (F.col("_sd") / F.sqrt("_n")))
    arg = {"corrcoef": -F.col("t"), "mse": F.col("t")}.get(metric, F.abs("t"))
    p = t_sf(arg, (F.col("_n") - 1).cast("double")) * (1 if metric in ("corrcoef", "mse") else 2)
    return d.withColumn("p", p).select(*keys, "t", "p")


def pairwise_corr(df: DataFrame, vec: str, tile: int = 512, rows: int = 8192) -> DataFrame:
    """Correlation of every two traces held as positions of an array column, one row per time point: ``a, b, r``.

    Positions are cut into tiles and time points into chunks; a task multiplies two tiles of a chunk, and products are
    added by group sums, so neither a matrix of the whole width nor a whole trace is in one place. Values are
    counted from those of the first row, which keeps digits. A trace that does not vary has no correlation.
    """
    d = df.select(F.col(vec).cast("array<double>").alias("_x")).filter("_x is not null")
    first = d.first()
    zero = first["_x"] if first else []
    tiles = max(1, -(-len(zero) // tile))
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(tiles) for j in range(i, tiles)]))
    d = d.withColumn("_c", F.floor(F.monotonically_increasing_id() / rows)).withColumn("_p", pair)
    cut = [F.slice("_x", F.col(f"_p.{t}") * tile + 1, F.lit(tile)).alias(f"_{t}") for t in "ij"]
    d = d.select("_c", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), *cut)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = (np.stack(pdf[c].to_numpy()).astype(float) - np.array(zero[t * tile : t * tile + tile], dtype=float) for c, t in (("_i", i), ("_j", j)))
        at = i * tile + np.arange(x.shape[1])
        return pd.DataFrame({"a": at, "n": len(x), "s": x.sum(axis=0), "j": j, "v": list(x.T @ y)})

    g = d.groupBy("_c", "i", "j").applyInPandas(products, "a int, n long, s double, j int, v array<double>")
    g = written(g)
    own = g.filter(F.col("j") == F.floor(F.col("a") / tile)).select("a", "n", "s", F.get("v", F.col("a") % tile).alias("q"))
    own = once(own.groupBy("a").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    both = g.select("a", F.col("j"), F.posexplode("v").alias("k", "v")).select("a", (F.col("j") * tile + F.col("k")).alias("b"), "v").filter("b > a")
    both = both.groupBy("a", "b").agg(F.sum("v").alias("v")).join(own, "a").join(own.select(F.col("a").alias("b"), F.col("s").alias("_s"), F.col("q").alias("_q")), "b")
    n = F.col("n")
    spread = F.sqrt((F.col("q") - F.col("s") * F.col("s") / n) * (F.col("_q") - F.col("_s") * F.col("_s") / n))
    return both.select("a", "b", ((F.col("v") - F.col("s") * F.col("_s") / n) / nz(spread)).alias("r"))


def _z_vectors(vectors: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    d = join_stats(vectors, keys, _m=F.avg(value), _s=F.stddev_pop(value), _n=F.count("*"))
    return d.withColumn("_z", (F.col(value) - F.col("_m")) / nz(F.col("_s"))).select(*keys, pos, "_z", "_n")


def order_by_similarity(vectors: DataFrame, by: list[str], key: str, pos: str, value: str) -> DataFrame:
    """Order vectors by their correlation to the one with the highest summed correlation.

    The sum over all partners equals the product with the summed z-scores, so no pairs are formed.
    Groups of up to two vectors keep the order of their keys.
    """
    z = _z_vectors(vectors, [*by, key], pos, value)
    total = z.groupBy(*by, pos).agg(F.sum("_z").alias("_tot"))
    score = z.join(total, [*by, pos]).groupBy(*by, key).agg((F.sum(F.col("_z") * F.col("_tot")) / F.first("_n")).alias("score"))
    # Rounded so that the choice between equal sums does not hang on the order of summation.
    top = score.groupBy(*by).agg(F.max_by(key, F.struct(F.round("score", 9), -F.col(key))).alias("_ref"), F.count("*").alias("_k"))
    ref = z.join(top.select(*by, F.col("_ref").alias(key)), [*by, key]).select(*by, pos, F.col("_z").alias("_zr"))
    corr = z.join(ref, [*by, pos]).groupBy(*by, key).agg((F.sum(F.col("_z") * F.col("_zr")) / F.first("_n")).alias("corr"))
    corr = corr.join(top, by).withColumn("_o", F.when(F.col("_k") > 2, F.round("corr", 9)).otherwise(F.lit(0.0)))
    return indexed(corr, by, ["_o", key], "place").select(*by, key, "corr", F.col("_ref").alias("ref"), "place")


def dataset_norm(points: DataFrame, keys: list[str], zscore: list[str], minmax: list[str]) -> DataFrame:
    """Rows scaled by statistics of the whole data set: z-scores and 0..1 ranges."""
    aggs = {}
    for c in zscore:
        aggs |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_pop(c)}
    for c in minmax:
        aggs |= {f"_a_{c}": F.min(c), f"_b_{c}": F.max(c)}
    d = join_stats(points, keys, **aggs)
    out = {f"{c}_norm": (F.col(c) - F.col(f"_m_{c}")) / nz(F.col(f"_s_{c}")) for c in zscore}
    out |= {f"{c}_norm": (F.col(c) - F.col(f"_a_{c}")) / nz(F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in minmax}
    return d.withColumns(out).drop(*aggs)


def score_predictions(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Correlation, mean squared and absolute error, and error of the 0.5 threshold per split."""
    e = F.col(y) - F.col(p)
    binary = F.abs(F.col(y).cast("int") - (F.col(p) > 0.5).cast("int"))
    return df.groupBy(*by).agg(pearson(y, p).alias("cc"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(binary).alias("binary_error"))


def explained_fraction(df: DataFrame, by: list[str], a: str, fit: str) -> DataFrame:
    return df.groupBy(*by).agg((1 - F.var_pop(F.col(a) - F.col(fit)) / nz(F.var_pop(a))).alias("explained"))


def retinal_position_fallback(fields: DataFrame, scans: DataFrame, keys: list[str], off: float = 200.0, outlier: float = 20_000.0) -> DataFrame:
    """Field position, or the median scan position without outliers where the field's is far off."""
    good = scans.filter((F.abs("sx") <= outlier) & (F.abs("sy") <= outlier))
    med = quantiles(scans, keys, "sx", _mx=0.5).join(quantiles(scans, keys, "sy", _my=0.5), keys)
    big = largest(scans, keys)
    clean = quantiles(good, keys, "sx", big, _gx=0.5).join(quantiles(good, keys, "sy", big, _gy=0.5), keys)
    d = fields.join(med, keys, "left").join(clean, keys, "left")
    far = F.coalesce((F.abs(F.col("_mx") - F.col("x")) > off) | (F.abs(F.col("_my") - F.col("y")) > off), F.lit(False))
    return d.select(
        *keys, F.when(far, F.coalesce("_gx", "_mx")).otherwise(F.col("x")).alias("x"),
        F.when(far, F.coalesce("_gy", "_my")).otherwise(F.col("y")).alias("y"), far.alias("replaced"),
    )
