"""Response features of trigger-averaged or repeated recordings.

Averages come as ``(keys, j, y)`` with ``j`` a sample index at ``fs`` samples per second, repetitions
as ``(keys, rep, j, t, y)``. Window limits in seconds are cut to whole samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.quantile import quantiles
from ..plans.scan import indexed, largest
from ..plans.stats import join_stats, nz
from ..session import once
from .series import nearest_index, resample_linear, snippet_join, window_ends
from .stats import repeat_quality


def _in(lo: int, hi: int) -> Column:
    return (F.col("j") >= lo) & (F.col("j") < hi)


def _mean(cond: Column) -> Column:
    return F.avg(F.when(cond, F.col("y")))


def window_mean(avg: DataFrame, events: DataFrame, keys: list[str], a: float, b: float, tol: float | None = None) -> DataFrame:
    """Mean between the samples nearest to two offsets of each event (the second one excluded)."""
    s = once(avg.select(*keys, F.col("j").alias("i"), "t", "y"))
    events = once(events.select(*keys, F.col("k").alias("rep"), F.col("t").alias("_t0")))
    e = window_ends(events, s, keys, tol, largest(events, keys), _lo=a, _hi=b)
    w = e.select(*keys, "rep", F.col("_lo").alias("i0"), (F.col("_hi") - F.col("_lo")).alias("n_frames"))
    return snippet_join(w, s, keys).groupBy(*keys, F.col("rep").alias("k")).agg(F.avg("y").alias("r"))


def spot_indices(responses: DataFrame, keys: list[str]) -> DataFrame:
    """First, second and largest other response ``(k, r)``, and their differences to the first."""
    k, r = F.col("k"), F.col("r")
    d = responses.groupBy(*keys).agg(
        F.max(F.when(k == 0, r)).alias("small"), F.max(F.when(k == 1, r)).alias("large"), F.max(F.when(k > 1, r)).alias("_other")
    )
    return d.select(
        *keys, "small", "large", (F.col("large") - F.col("small")).alias("surround_index"), (F.col("_other") - F.col("small")).alias("offset_index")
    )


def spot_responses(snips: DataFrame, keys: list[str], n_base: int, n_spot: int, n_spots: int) -> DataFrame:
    """Per repetition and spot: mean after the baseline part minus the median of that part."""
    d = snips.filter(F.col("j") < n_spot * n_spots)
    d = d.withColumn("spot", F.floor(F.col("j") / n_spot)).withColumn("_p", F.col("j") % n_spot)
    by = [*keys, "rep", "spot"]
    base = quantiles(d.filter(F.col("_p") < n_base), by, "y", n_base, _b=0.5)
    r = d.filter(F.col("_p") >= n_base).groupBy(*by).agg(F.avg("y").alias("_m"))
    return r.join(base, by).select(*by, (F.col("_m") - F.col("_b")).alias("r"))


def _surround(reps: DataFrame, local: Column, glob: Column, keys: list[str], bound: int) -> DataFrame:
    l = quantiles(reps.filter(local), keys, "r", bound, l_mu=0.5)
    g = quantiles(reps.filter(glob), keys, "r", bound, g_mu=0.5)
    return l.join(g, keys).withColumn("surround_index", F.col("g_mu") - F.greatest(F.col("l_mu"), F.lit(0.0)))


def spot_surround(snips: DataFrame, keys: list[str], n_base: int, n_spot: int, n_spots: int = 6) -> DataFrame:
    """Median response to the second spot minus the non-negative one to the first."""
    r = spot_responses(snips, keys, n_base, n_spot, n_spots)
    return _surround(r, F.col("spot") == 0, F.col("spot") == 1, keys, largest(snips, keys))


def step_surround(local: DataFrame, glob: DataFrame, keys: list[str], n_base: int, n_spot: int, rtol: float = 1e-5) -> DataFrame:
    """The same index from the step of two stimuli; their sampling must match (checked per key)."""

    def step(s: DataFrame, name: str) -> DataFrame:
        one = s.groupBy(*keys, "rep").agg(((F.max("t") - F.min("t")) / nz((F.max("j") - F.min("j")).cast("double"))).alias("_d"))
        return one.groupBy(*keys).agg(F.avg("_d").alias(name))

    r = spot_responses(local, keys, n_base, n_spot, 1).withColumn("spot", F.lit(0))
    r = r.unionByName(spot_responses(glob, keys, n_base, n_spot, 1).withColumn("spot", F.lit(1)))
    out = _surround(r, F.col("spot") == 0, F.col("spot") == 1, keys, largest(local, keys) + largest(glob, keys))
    chk = step(local, "_a").join(step(glob, "_b"), keys)
    bad = F.raise_error(F.lit("sampling of the two traces differs")).cast("double")
    close = F.abs(F.col("_a") - F.col("_b")) <= rtol * F.abs("_b") + 1e-8
    return out.join(chk, keys).withColumn("surround_index", F.when(close, F.col("surround_index")).otherwise(bad)).drop("_a", "_b")


def polarity_index(avg: DataFrame, keys: list[str], fs: float, alpha: float = 2, t_on: float = 2, t_off: float = 5) -> DataFrame:
    """(on - off) / (on + off) of the non-negative mean responses; 0.5 if there is none."""
    on = F.greatest(_mean(_in(math.floor(t_on * fs), math.floor((t_on + alpha) * fs))), F.lit(0.0))
    off = F.greatest(_mean(_in(math.floor(t_off * fs), math.floor((t_off + alpha) * fs))), F.lit(0.0))
    d = avg.groupBy(*keys).agg(on.alias("_on"), off.alias("_off"))
    total = F.col("_on") + F.col("_off")
    return d.select(*keys, F.when(total < 1e-9, 0.5).otherwise((F.col("_on") - F.col("_off")) / total).alias("polarity_index"))


def peak_ratio(avg: DataFrame, keys: list[str], fs: float, alpha: float, half: float, t_on: float = 2, t_max: float = 6, name: str = "peak_ratio") -> DataFrame:
    """Response some time after the peak over the peak, both above the mean before the step, at most 1.

    -1 without a positive peak. With 0.4 s this is the transience, with 2 s the plateau index.
    """
    if half >= alpha:
        raise ValueError("the window must be shorter than the delay")
    a, b = int(t_on * fs), int(t_max * fs)
    best = F.max_by(F.struct(F.col("j").alias("p"), "y"), F.when(_in(a, b), F.struct("y", -F.col("j"))))
    one = avg.groupBy(*keys).agg(_mean(_in(0, a)).alias("_base"), best.alias("_pk"))
    d = avg.join(one, keys)
    mid = F.col("_pk.p") + int(alpha * fs)
    post = F.avg(F.when(F.abs(F.col("j") - mid) <= int(half * fs), F.col("y") - F.col("_base")))
    d = d.groupBy(*keys).agg(post.alias("_post"), F.first(F.col("_pk.y") - F.col("_base")).alias("_peak"))
    ratio = F.least(F.greatest(F.col("_post"), F.lit(0.0)) / F.col("_peak"), F.lit(1.0))
    return d.select(*keys, F.when(F.col("_peak") <= 1e-9, -1.0).otherwise(ratio).alias(name))


def tonic_index(avg: DataFrame, keys: list[str], fs: float, t_start: float = 10, t_end: float = 29, dt_base: float = 1) -> DataFrame:
    """Share of the area below the baseline median in a window."""
    a, b, c = int(fs * (t_start - dt_base)), int(fs * t_start), int(fs * t_end)
    base = quantiles(avg.filter(_in(a, b)), keys, "y", b - a, _b=0.5)
    d = avg.filter(_in(b, c)).join(base, keys).withColumn("_r", F.col("y") - F.col("_b"))
    neg = F.sum(F.greatest(-F.col("_r"), F.lit(0.0)))
    return d.groupBy(*keys).agg((neg / nz(F.sum(F.abs("_r")))).alias("tonic_index"))


def band_ratio(avg: DataFrame, keys: list[str], fs: float, t_start: float = 10, t_end: float = 17) -> DataFrame:
    """Largest response in the last third of a window over that in the first; -1 if that is not positive."""
    a, b = int(fs * t_start), int(fs * t_end)
    third = (b - a) // 3
    low, high = F.max(F.when(_in(a, a + third), F.col("y"))), F.max(F.when(_in(b - third, b), F.col("y")))
    d = avg.groupBy(*keys).agg(low.alias("low"), high.alias("high"))
    return d.withColumn("lh_index", F.when(F.col("low") < 1e-9, -1.0).otherwise(F.col("high") / F.col("low")))


def band_power_index(snips: DataFrame, keys: list[str], fs: float, seconds: float = 6, low=(0.5, 1.0), high=(2.0, 16.0), constant: float = 1e4) -> DataFrame:
    """Log ratio of the mean spectral power in two bands over the first seconds of the repetitions.

    A repetition holds ``seconds`` times ``fs`` samples at most and is transformed whole.
    """
    n = int(seconds * fs)
    at = [[k for k in range(n // 2 + 1) if lo <= k * fs / n <= hi] for lo, hi in (low, high)]
    fields = [f for f in snips.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("_l", DoubleType()), StructField("_h", DoubleType())])

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(n)
        np.add.at(y, pdf["j"].to_numpy(dtype=np.int64), np.nan_to_num(pdf["y"].to_numpy(dtype=float)))
        p = np.abs(np.fft.rfft(y)) ** 2
        out = pdf[keys].head(1).copy()
        for c, ks in zip(("_l", "_h"), at):
            out[c] = p[ks].mean() if ks else None
        return out

    per = snips.filter(F.col("j") < n).select(*keys, "rep", "j", "y").groupBy(*keys, "rep").applyInPandas(power, schema)
    # Every repetition has all frequencies, so the mean over both steps is the plain mean per band.
    d = per.groupBy(*keys).agg(F.avg("_l").alias("_l"), F.avg("_h").alias("_h"))
    return d.select(*keys, F.log10(constant * F.col("_h") / nz(F.col("_l"))).alias("band_power_index"))


def chirp_features(avg: DataFrame, snips: DataFrame, keys: list[str], fs: float, snip_fs: float, t_on=2.0, t_off=5.0, t_max=6.0, t_start=10.0, t_end=29.0, t_pause=17.0) -> DataFrame:
    """All indices of a step-and-flicker response, from its resampled average and its repetitions."""
    snips = once(snips)
    one = join_stats(avg.select(*keys, "j", "y"), keys, _a=F.max(F.abs("y"))).withColumn("y", F.col("y") / nz(F.col("_a"))).drop("_a")
    one = once(one)
    base = quantiles(one.filter(_in(0, int(fs * t_on))), keys, "y", int(fs * t_on), _b=0.5)
    norm = once(one.join(base, keys).withColumn("y", F.col("y") - F.col("_b")).drop("_b"))
    parts = [
        polarity_index(norm, keys, fs, t_on=t_on, t_off=t_off),
        peak_ratio(norm, keys, fs, 0.4, 0.15, t_on, t_max, "transience_index"),
        peak_ratio(norm, keys, fs, 2.0, 0.15, t_on, t_max, "plateau_index"),
        tonic_index(norm, keys, fs, t_start, t_end),
        band_ratio(norm, keys, fs, t_start, t_pause),
        band_power_index(snips, keys, snip_fs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys)
    return out


def on_off_index(snips: DataFrame, starts: DataFrame, keys: list[str], n_step: int, up: float = 2, down: float = 5, skip: int = 4) -> DataFrame:
    """Contrast of the responses to a step up and a step down, over frames and repetitions."""
    by = [*keys, "rep"]
    s = once(join_stats(snips, by, _min=F.min("y")).withColumn("y", F.col("y") - F.col("_min")).drop("_min"))
    at = starts.select(*by, F.col("t0").alias("_t0"))
    src = s.select(*by, F.col("j").alias("i"), "t")
    for n, off in (("_u", up), ("_d", down)):
        at = nearest_index(at.withColumn("t", F.col("_t0") + off), src, by, bound=1).withColumnRenamed("si", n).drop("t")
    d = once(s.join(at.select(*by, "_u", "_d"), by))
    big = largest(snips, by)
    bu = quantiles(d.filter(F.col("j") < F.col("_u")), by, "y", big, _bu=0.5)
    bd = quantiles(d.filter((F.col("j") < F.col("_d")) & (F.col("j") >= F.col("_d") - n_step)), by, "y", big, _bd=0.5)
    d = d.join(bu, by).join(bd, by)

    def part(c: str, base: str) -> Column:
        inside = (F.col("j") >= F.col(c) + skip) & (F.col("j") < F.col(c) + n_step)
        return F.avg(F.when(inside, F.greatest(F.col("y") - F.col(base), F.lit(0.0))))

    d = d.groupBy(*keys).agg(part("_u", "_bu").alias("_on"), part("_d", "_bd").alias("_off"))
    total = F.col("_on") + F.col("_off")
    return d.select(*keys, F.when(total < 1e-10, 0.0).otherwise((F.col("_on") - F.col("_off")) / total).alias("on_off_index"))


def rep_transience(snips: DataFrame, starts: DataFrame, keys: list[str], dt: float, window: float = 6, delay: float = 0.4) -> DataFrame:
    """One minus the value some time after the peak over the peak, mean over repetitions."""
    by = [*keys, "rep"]
    snips = once(snips)
    r = resample_linear(snips.select(*by, F.col("j").alias("i"), "t", "y"), by, dt)
    r = join_stats(r, by, _min=F.min("y")).withColumn("y", F.col("y") - F.col("_min"))
    r = once(r)
    w = r.join(starts.select(*by, "t0"), by).filter((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + window))
    pk = w.groupBy(*by).agg(F.max_by(F.struct("i", "y"), F.struct("y", -F.col("i"))).alias("_p"))
    pk = pk.select(*by, F.col("_p.y").alias("_y"), (F.col("_p.i") + int(round(delay / dt))).alias("i"))
    d = pk.join(r.select(*by, "i", "y"), [*by, "i"])
    return d.groupBy(*keys).agg(F.avg(1 - F.col("y") / nz(F.col("_y"))).alias("transience_index"))


def preferred_colour(tuning: DataFrame, keys: list[str], pair: tuple[str, str]) -> DataFrame:
    """Colour of a pair whose tuning curve has the higher peak (``pref_colour``): the first only if it is strictly higher.

    ``tuning`` is the result of :func:`size_tuning` with ``curves``. A key without one of the colours prefers the other, one without both none.
    """
    a, b = pair
    top = [F.max(F.when(F.col("colour") == c, F.col("pref_tuning"))) for c in pair]
    d = tuning.groupBy(*keys).agg(top[0].alias("_a"), top[1].alias("_b"))
    first = (F.col("_a") > F.col("_b")) | (F.col("_a").isNotNull() & F.col("_b").isNull())
    return d.select(*keys, F.when(first, a).when(F.col("_b").isNotNull(), b).alias("pref_colour"))


def size_tuning(snips: DataFrame, keys: list[str], n_base: int, peak: tuple[int, int], quality_sizes: list[int], curves: bool = False) -> DataFrame:
    """Tuning by size for each colour from repeated spots ``(colour, size, rep, j, y)``.

    Repetitions without all samples up to the peak window drop out. Peaks are taken above the
    baseline median and scaled by the largest peak of the repetition (at least 1). Preferred size,
    surround index of the largest size, number of repetitions and repeat quality per colour; with ``curves``
    also the tuning at the preferred size (``pref_tuning``) and the whole curve, ascending sizes with their tuning.
    """
    a, b = peak
    snips = once(snips)
    by = [*keys, "colour", "size", "rep"]
    ok = snips.filter(F.col("j") < b).groupBy(*by).agg(F.count("y").alias("_n")).filter(F.col("_n") == b)
    s = once(snips.join(ok.select(*by), by, "left_semi"))
    base = quantiles(s.filter(F.col("j") < n_base), by, "y", n_base, _b=0.5)
    s = once(s.join(base, by).withColumn("y", F.col("y") - F.col("_b")))
    p = s.filter(_in(a, b)).groupBy(*by).agg(F.avg("y").alias("peak"))
    p = join_stats(p, [*keys, "rep"], _top=F.greatest(F.max("peak"), F.lit(1.0))).withColumn("peak", F.col("peak") / F.col("_top"))
    curve = p.groupBy(*keys, "colour", "size").agg(F.avg("peak").alias("tuning"), F.count("*").alias("n"))
    d = curve.groupBy(*keys, "colour").agg(
        F.max_by(F.struct("size", "tuning"), F.struct("tuning", -F.col("size"))).alias("_p"), F.max_by("tuning", "size").alias("_l"), F.max("n").alias("n_reps"),
        F.sort_array(F.collect_list(F.struct("size", "tuning"))).alias("curve"),
    )
    si = F.greatest(F.col("_l") / nz(F.col("_p.tuning")), F.lit(0.0)) - 1
    d = d.select(*keys, "colour", F.col("_p.size").alias("pref_size"), si.alias("surround_index"), "n_reps", *([F.col("_p.tuning").alias("pref_tuning"), "curve"] if curves else []))
    q = s.filter(F.col("size").isin(quality_sizes)).withColumn("rep", F.struct("size", "rep"))
    q = repeat_quality(q, [*keys, "colour"]).select(*keys, "colour", "qidx")
    return d.join(q, [*keys, "colour"], "left")


def tuning_curve_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the repetitions of each key in order (the ``rep`` that :func:`size_tuning` expects)."""
    return indexed(df, keys, order, "rep")
