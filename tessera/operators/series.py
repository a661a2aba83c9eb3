"""Time-series operators on long sample tables ``(keys, i, t, y)``, ``i`` a dense 0-based index.

Short frames run on index chunks with copied borders, unbounded look-ups on ordered scans, fixed
index offsets as equi-joins on ``(keys, i)``; none of them needs a whole recording in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..plans.asof import asof, closer
from ..plans.quantile import quantiles, with_quantiles
from ..plans.scan import halo, indexed, largest, own, scan, task_rows
from ..plans.stats import join_stats, nz
from ..session import durable, once, written

CHUNK = 65_536


def explode_range(df: DataFrame, n: Column, name: str) -> DataFrame:
    """One row per ``name`` in 0..n-1, in two steps so that no row ever holds a long array."""
    d = df.withColumn("_n", n.cast("long")).filter("_n > 0")
    d = d.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    lo, hi = F.col("_c") * CHUNK, F.least(F.col("_c") * CHUNK + CHUNK, F.col("_n")) - 1
    return d.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_n", "_c")


def with_neighbours(samples: DataFrame, keys: list[str], **cols: tuple[str, int]) -> DataFrame:
    """Values of rows a few positions away, ``new=(column, offset)``; negative offsets look back."""
    before = max([-o for _, o in cols.values()] + [0])
    after = max([o for _, o in cols.values()] + [0])
    cut, w = halo(samples, keys, before, after)
    return own(cut.withColumns({n: (F.lead(c, o) if o > 0 else F.lag(c, -o)).over(w) for n, (c, o) in cols.items()}))


def sampling_step(samples: DataFrame, keys: list[str], rtol_error: float = 2.0, rtol_warning: float = 1.0) -> DataFrame:
    """Mean step, worst relative deviation and its level (ok, warning, error) per key."""
    d = with_neighbours(samples.select(*keys, "i", "t"), keys, _p=("t", -1)).withColumn("_d", F.col("t") - F.col("_p"))
    s = d.groupBy(*keys).agg(F.avg("_d").alias("dt"), F.min("_d").alias("_a"), F.max("_d").alias("_b")).dropna(subset=["dt"])
    rel = F.greatest(F.col("_b") - F.col("dt"), F.col("dt") - F.col("_a")) / nz(F.col("dt"))
    level = F.when(rel >= rtol_error, "error").when(rel >= rtol_warning, "warning").otherwise("ok")
    return s.select(*keys, "dt", rel.alias("rel_error"), level.alias("level"))


def mean_step(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean step from the ends and the number of samples."""
    return samples.groupBy(*keys).agg(((F.max("t") - F.min("t")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("dt"))


def frame_times(params: DataFrame, keys: list[str]) -> DataFrame:
    """Start of every frame from scan settings (``n_frames pixel_us nx ny``)."""
    d = explode_range(params, F.col("n_frames"), "frame")
    return d.select(*keys, "frame", (F.col("frame") * F.col("pixel_us") * 1e-6 * F.col("nx") * F.col("ny")).alias("t"))


def pixel_offsets(params: DataFrame, keys: list[str], precision: str = "line") -> DataFrame:
    """Delay of each kept pixel within its frame (``left`` and ``right`` pixels of a line are cut)."""
    d = params.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    d = d.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    d = d.filter((F.col("_p") >= F.col("left")) & (F.col("_p") < F.col("nx") - F.col("right")))
    px = F.lit(0) if precision == "line" else F.col("_p")
    dt = (F.col("line") * F.col("nx") + px) * F.col("pixel_us") * 1e-6
    return d.select(*keys, (F.col("_p") - F.col("left")).alias("x"), F.col("line").alias("y"), dt.alias("offset"))


def detect_triggers(signal: DataFrame, keys: list[str], threshold: float, min_gap: int, delay: float = 0.0) -> DataFrame:
    """Upward crossings with debounce, and a first trigger that is already on at the start.

    A crossing closer than ``min_gap`` positions to the crossing before it, kept or not, is dropped.
    The length of a running first pulse is taken as the median pulse length (cut to a whole number).
    """
    on, big = F.col("y") >= threshold, largest(signal, keys)
    s = scan(signal.select(*keys, "i", "t", "y"), keys, ["i"], big, _p=("prev", F.col("y")), _off=("after", F.when(~on, F.col("i"))))
    cross = s.filter(on & (F.col("_p") < threshold))
    cross = scan(cross, keys, ["i"], big, _pi=("prev", F.col("i")))
    kept = durable(cross.filter(F.col("_pi").isNull() | (F.col("i") - F.col("_pi") >= min_gap)))
    dur = kept.select(*keys, F.coalesce(F.col("_off") - F.col("i") - 1, F.lit(0)).alias("_d"))
    dur = quantiles(dur, keys, "_d", big, _dur=0.5)
    first = s.filter((F.col("i") == 0) & on & F.col("_off").isNotNull()).join(dur, keys)
    first = first.select(*keys, F.greatest(F.col("_off") - F.floor("_dur"), F.lit(0)).alias("i"))
    first = first.join(signal.select(*keys, "i", "t", "y"), [*keys, "i"])
    out = kept.select(*keys, "i", "t", "y").unionByName(first.select(*keys, "i", "t", "y"))
    return indexed(out, keys, ["i"], "k", big).select(*keys, "k", "i", (F.col("t") + delay).alias("t"), F.col("y").alias("v"))


def nearest_index(points: DataFrame, samples: DataFrame, keys: list[str], tol: float | None = None, side: str = "nearest", bound: int | None = None) -> DataFrame:
    """Index of the sample nearest to each point in time (``si``); null beyond the tolerance."""
    s = samples.select(*keys, "t", "i")
    both = (largest(points, keys) if bound is None else bound) + largest(samples, keys)
    if side == "before":
        d = asof(points, s, keys, "t", both, _ns="before")
    elif side == "after":
        d = asof(points, s, keys, "t", both, _ns="after")
    else:
        d = asof(points, s, keys, "t", both, _nb="before", _na="after_open")
        d = d.withColumn("_ns", closer(F.col("_nb"), F.col("_na"), F.col("t"))).drop("_nb", "_na")
    near = F.lit(True) if tol is None else F.abs(F.col("_ns.t") - F.col("t")) <= tol
    return d.withColumn("si", F.when(near, F.col("_ns.i"))).drop("_ns")


def window_ends(events: DataFrame, samples: DataFrame, keys: list[str], tol: float | None, bound: int, **offsets: float) -> DataFrame:
    """Index of the sample nearest to each offset from the time ``_t0`` of every event, in columns ``name=offset``.

    The ends are written one by one: a search sorts all samples of its keys, and in one stage a task would hold the
    sorts of all searches.
    """
    for name, off in offsets.items():
        at = nearest_index(events.withColumn("t", F.col("_t0") + off), samples, keys, tol, bound=bound)
        events = written(at.withColumnRenamed("si", name).drop("t"))
    return events


def _within(at: DataFrame, tol: float | None) -> DataFrame:
    """A point without a sample within the tolerance is an error; without a tolerance, a key without samples has none."""
    if tol is None:
        return at.filter("si is not null")
    far = F.raise_error(F.lit(f"a trigger has no sample within {tol}")).cast("long")
    return at.withColumn("si", F.coalesce(F.col("si"), far))


def repetition_starts(samples: DataFrame, triggers: DataFrame, keys: list[str], n_per_rep: int, delay: float = 0.0, tol: float | None = None, pad: bool = False) -> DataFrame:
    """First sample and length of every repetition.

    The length is the median gap between starts cut to a whole number; a last repetition with fewer
    samples left is dropped and noted in ``dropped_last``. With ``pad`` the start is the sample before.
    A trigger out of tolerance is an error: without it the lengths of all others would change.
    """
    first = triggers.filter(F.col("k") % n_per_rep == 0)
    first = first.select(*keys, F.expr(f"k div {n_per_rep}").alias("rep"), F.col("t").alias("t0"), (F.col("t") + delay).alias("t"))
    big = largest(triggers, keys)
    at = _within(nearest_index(first, samples, keys, tol, "before" if pad else "nearest", big), tol)
    at = scan(at.select(*keys, "rep", "t0", F.col("si").alias("i0")), keys, ["rep"], big, _p=("prev", F.col("i0")))
    at = durable(at)  # one row per repetition, read several times below
    gap = quantiles(at.withColumn("_g", F.col("i0") - F.col("_p")), keys, "_g", big, _len=0.5)
    size = samples.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    last = at.groupBy(*keys).agg(F.max("rep").alias("_last"))
    d = at.join(size, keys).join(last, keys).join(gap, keys, "left")
    n = F.coalesce(F.floor("_len") + (1 if pad else 0), F.col("_n") - F.col("i0"))
    d = d.withColumn("n_frames", n.cast("long"))
    short = (F.col("rep") == F.col("_last")) & (F.col("_n") - F.col("i0") < F.col("n_frames"))
    d = d.withColumn("_short", short)
    d = d.join(d.groupBy(*keys).agg(F.max(F.col("_short").cast("int")).alias("dropped_last")), keys)
    return d.filter(~F.col("_short")).select(*keys, "rep", "t0", "i0", "n_frames", "dropped_last")


def snippet_join(starts: DataFrame, samples: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Samples at offsets 0..n_frames-1 after each start; a sample may serve several starts.

    Starts written to a file are small, the rows they ask for are not, so these are never broadcast.
    """
    extra = extra or []
    want = explode_range(starts.select(*keys, "rep", *extra, "i0", "n_frames"), F.col("n_frames"), "j")
    want = want.select(*keys, "rep", *extra, "j", (F.col("i0") + F.col("j")).alias("i"))
    return want.join(samples.select(*keys, "i", "t", "y").hint("merge"), [*keys, "i"]).select(*keys, "rep", *extra, "j", "t", "y")


def snippets(samples: DataFrame, triggers: DataFrame, keys: list[str], n_per_rep: int, delay: float = 0.0, tol: float | None = None, base: tuple[float, float] | None = None, pad: bool = False) -> DataFrame:
    """Cut the samples into repetitions; ``base`` subtracts the mean of a window around the trigger."""
    samples, triggers = once(samples), once(triggers)
    starts = repetition_starts(samples, triggers, keys, n_per_rep, delay, tol, pad)
    if base is None:
        return snippet_join(starts, samples, keys)
    starts = written(starts)
    snips = snippet_join(starts, samples, keys)
    ends = starts.select(*keys, "rep", F.col("t0").alias("_t0"))
    ends = window_ends(ends, samples, keys, tol, largest(triggers, keys), _a=base[0], _b=base[1])
    win = ends.select(*keys, "rep", F.col("_a").alias("i0"), (F.col("_b") - F.col("_a")).alias("n_frames"))
    mean = snippet_join(win, samples, keys).groupBy(*keys, "rep").agg(F.avg("y").alias("_base"))
    return snips.join(mean.hint("merge"), [*keys, "rep"]).withColumn("y", F.col("y") - F.col("_base")).drop("_base")


def snippet_triggers(triggers: DataFrame, starts: DataFrame, keys: list[str], n_per_rep: int) -> DataFrame:
    """Triggers of the kept repetitions, numbered within each."""
    g = triggers.select(*keys, F.expr(f"k div {n_per_rep}").alias("rep"), (F.col("k") % n_per_rep).alias("k"), "t")
    return g.join(starts.select(*keys, "rep"), [*keys, "rep"], "left_semi")


def group_snippets(samples: DataFrame, triggers: DataFrame, keys: list[str], trials: list[tuple[str, int, int]], tol: float | None = None, delay: float = 0.0, stack: str | None = None, rtol: float = 0.1) -> DataFrame:
    """Cut by a trial list ``(name, triggers, triggers per piece)`` and number the pieces of a name.

    A piece runs from its first trigger to the first trigger of the next piece, both moved by ``delay``; the last
    one ends before the last sample. The last piece of a name is cut to the longest of the others. With ``stack`` the pieces of
    a name get one length: the shortest (``truncate``, an error if lengths differ by more than ``rtol`` of their
    mean) or the longest (``pad``, values and times beyond a piece's end are null).
    """
    d = _pieces(samples, triggers, keys, trials, tol, delay)
    if stack is None:
        return snippet_join(d, samples, keys, ["name"])
    if stack not in ("truncate", "pad"):
        raise ValueError(stack)
    d = join_stats(d, [*keys, "name"], _min=F.min("n_frames"), _max=F.max("n_frames"), _mean=F.avg("n_frames"))
    if stack == "truncate":
        far = (F.col("_max") - F.col("_min")) / F.col("_mean") > rtol
        size = F.when(far, F.raise_error(F.lit(f"lengths differ by more than {rtol}")).cast("long")).otherwise(F.col("_min"))
        return snippet_join(d.withColumn("n_frames", size), samples, keys, ["name"])
    want = explode_range(d.select(*keys, "rep", "name", "i0", F.col("n_frames").alias("_own"), "_max"), F.col("_max"), "j")
    want = want.withColumn("i", F.when(F.col("j") < F.col("_own"), F.col("i0") + F.col("j")))
    return want.join(samples.select(*keys, "i", "t", "y"), [*keys, "i"], "left").select(*keys, "rep", "name", "j", "t", "y")


def _trial_starts(trials: list[tuple[str, int, int]]) -> tuple[list[tuple[int, str, int]], int]:
    """First trigger, name and triggers of every piece of a cycle, and the triggers of a cycle."""
    pieces, off = [], 0
    for name, n, split in trials:
        pieces += [(off + s, name, split) for s in range(0, n, split)]
        off += n
    return pieces, off


def _pieces(samples: DataFrame, triggers: DataFrame, keys: list[str], trials: list[tuple[str, int, int]], tol: float | None, delay: float) -> DataFrame:
    """First sample and length of every piece: keys, k, name, rep, i0, n_frames."""
    pieces, off = _trial_starts(trials)
    lookup = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(nm).alias("name"), F.lit(sp).alias("split")) for o, nm, sp in pieces])
    hit = F.filter(lookup, lambda p: p["o"] == F.col("k") % off)
    big = largest(triggers, keys)
    at = triggers.select(*keys, "k", (F.col("t") + delay).alias("t") if delay else "t")
    at = durable(_within(nearest_index(at, samples, keys, tol, bound=big), tol))
    start = at.withColumn("_p", F.get(hit, 0)).filter("_p is not null")
    start = start.select(*keys, "k", F.col("si").alias("i0"), "_p.name", (F.col("k") + F.col("_p.split")).alias("_next"))
    end = at.select(*keys, F.col("k").alias("_next"), F.col("si").alias("_end"))
    size = samples.groupBy(*keys).agg(F.max("i").alias("_last_i"))
    d = start.join(end, [*keys, "_next"], "left").join(size, keys)
    d = d.withColumn("n_frames", F.coalesce("_end", "_last_i") - F.col("i0")).filter("n_frames > 0")
    d = indexed(d, [*keys, "name"], ["k"], "rep", big)
    last = d.groupBy(*keys, "name").agg(F.max("rep").alias("_lr"))
    d = d.join(last, [*keys, "name"])
    most = d.filter(F.col("rep") < F.col("_lr")).groupBy(*keys, "name").agg(F.max("n_frames").alias("_most"))
    d = d.join(most, [*keys, "name"], "left")
    cut = F.when(F.col("rep") == F.col("_lr"), F.least(F.col("n_frames"), F.coalesce("_most", "n_frames"))).otherwise(F.col("n_frames"))
    return d.select(*keys, "k", "name", "rep", "i0", cut.alias("n_frames"))


def group_completeness(samples: DataFrame, triggers: DataFrame, keys: list[str], trials: list[tuple[str, int, int]], tol: float | None = None, delay: float = 0.0) -> DataFrame:
    """Cycles of the trial list per key, pieces found in them, and whether the last cycle is cut short (``dropped_last``)."""
    pieces, off = _trial_starts(trials)
    found = _pieces(samples, triggers, keys, trials, tol, delay).groupBy(*keys).agg(F.count("*").alias("n_pieces"))
    cycles = triggers.groupBy(*keys).agg(F.ceil((F.max("k") + 1) / off).alias("n_cycles"))
    d = cycles.join(found, keys, "left").withColumn("n_pieces", F.coalesce("n_pieces", F.lit(0)))
    return d.withColumn("dropped_last", (F.col("n_pieces") < F.col("n_cycles") * len(pieces)).cast("int"))


def clamp_edges(samples: DataFrame, keys: list[str], nmin: tuple[int, int] = (0, 0), nmax: tuple[int, int] = (3, 3)) -> DataFrame:
    """Replace edge samples outside the range of the inner ones by the nearest good sample.

    Up to ``nmax`` samples per side if out of range, the first and last ``nmin`` always.
    """
    l, r = nmax
    d = join_stats(samples, keys, _n=F.max("i") + 1)
    i, y, n = F.col("i"), F.col("y"), F.col("_n")
    inner = (i >= l) & (i < n - r)
    aggs = [F.min(F.when(inner, y)).alias("_lo"), F.max(F.when(inner, y)).alias("_hi"), F.first("_n").alias("_m")]
    aggs += [F.max(F.when(i == p, y)).alias(f"_l{p}") for p in range(l + 1)]
    aggs += [F.max(F.when(i == n - 1 - p, y)).alias(f"_r{p}") for p in range(r + 1)]
    e = d.groupBy(*keys).agg(*aggs)

    def bad(c: str) -> Column:
        return (F.col(c) < F.col("_lo")) | (F.col(c) > F.col("_hi"))

    def drops(side: str, most: int) -> Column:
        out = F.lit(most)
        for p in reversed(range(most)):
            out = F.when(~bad(f"_{side}{p}"), p).otherwise(out)
        return out

    e = e.withColumn("_dl", drops("l", l)).withColumn("_dr", drops("r", r))
    pick_l = F.element_at(F.array(*[F.col(f"_l{p}") for p in range(l + 1)]), F.col("_dl") + 1)
    pick_r = F.element_at(F.array(*[F.col(f"_r{p}") for p in range(r + 1)]), F.col("_dr") + 1)
    e = e.select(*keys, "_dl", "_dr", pick_l.alias("_vl"), pick_r.alias("_vr"))
    d = d.join(e, keys)
    y2 = F.when(i < F.col("_dl"), F.col("_vl")).when(i >= n - F.col("_dr"), F.col("_vr")).otherwise(y)
    d = d.withColumn("y", y2)
    if nmin[0] > 0 or nmin[1] > 0:
        d = join_stats(d, keys, _fl=F.max(F.when(i == nmin[0], y)), _fr=F.max(F.when(i == n - nmin[1], y)))
        d = d.withColumn("y", F.when(i < nmin[0], F.col("_fl")).when((nmin[1] > 0) & (i >= n - nmin[1]), F.col("_fr")).otherwise(y))
    return d.select(*samples.columns)


def numbers(values) -> Column:
    """Constant array as one literal; thousands of single literals would slow planning down."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


# Longer kernels are applied chunk by chunk in numpy, shorter ones in a window frame.
FRAME_TAPS = 64


def fir(samples: DataFrame, keys: list[str], kernel: list[float], name: str = "y", value: str = "y", i: str = "i", reflect: bool = False) -> DataFrame:
    """Centred weighted sum over an odd number of samples; outside, the edge is held or mirrored.

    A sum over a missing sample is missing. Both ways of running it give the same sums.
    """
    m = len(kernel) // 2
    if len(kernel) > FRAME_TAPS:
        return _fir_chunks(samples, keys, kernel, name, value, i, reflect)
    cut, w = halo(samples, keys, m, m, i)
    ker = numbers(kernel)
    frame = w.rowsBetween(-m, m)
    cut = cut.withColumn("_a", F.collect_list(F.struct(F.col(value).alias("v"))).over(frame)).withColumn("_p", F.least(F.col(i), F.lit(m)).cast("int"))
    n = F.size("_a")

    def at(k: Column) -> Column:
        p = F.col("_p") + k - m
        if reflect:
            around = F.pmod(p, 2 * n)
            return F.when(around >= n, 2 * n - 1 - around).otherwise(around)
        return F.greatest(F.lit(0), F.least(n - 1, p))

    terms = F.transform(F.sequence(F.lit(0), F.lit(2 * m)), lambda k: F.get(ker, k) * F.get(F.col("_a"), at(k))["v"])
    return own(cut.withColumn(name, F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).drop("_a", "_p"))


def _fir_chunks(samples: DataFrame, keys: list[str], kernel: list[float], name: str, value: str, i: str, reflect: bool) -> DataFrame:
    """Chunks of a recording, with copied borders, convolved whole."""
    m, ker = len(kernel) // 2, np.array(kernel, dtype=float)[::-1]
    rest = [c for c in samples.columns if c != name]
    cut, _ = halo(samples, keys, m, m, i)
    fields = [f for f in cut.schema.fields if f.name in rest]
    schema = StructType([*fields, StructField(name, DoubleType()), StructField("_own", BooleanType())])

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(i)
        x = pdf[value].to_numpy(dtype=float)
        full = np.convolve(np.pad(x, m, mode="symmetric" if reflect else "edge"), ker, mode="valid")
        out = pdf[rest].copy()
        out[name] = pd.Series(full, index=pdf.index).astype(object).where(~np.isnan(full), None)
        out["_own"] = pdf["_own"]
        return out

    return cut.groupBy(*keys, "_chunk").applyInPandas(convolve, schema).filter("_own").drop("_own").select(*[c for c in samples.columns if c != name], name)


def gauss_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth_fir(samples: DataFrame, keys: list[str], sigma: float | None = None, cutoff: float | None = None, fs: float | None = None, name: str = "y") -> DataFrame:
    """Gaussian smoothing by a width in samples, or by a cut-off frequency (3 dB point)."""
    if sigma is None:
        sigma = math.sqrt(math.log(2.0)) / (2 * math.pi * cutoff) * fs
    return fir(samples, keys, gauss_kernel(sigma), name)


def poly_projection(window: int, order: int) -> np.ndarray:
    """Matrix mapping a window of samples to its polynomial fit at every position."""
    q = poly_basis(window, order)
    return q @ q.T


def poly_basis(window: int, order: int) -> np.ndarray:
    """Orthonormal polynomials over the positions of a window, one per column."""
    x = np.arange(window) - (window - 1) / 2
    return np.linalg.qr(np.vander(x / max(x[-1], 1.0), order + 1, increasing=True))[0]


def detrend_poly(samples: DataFrame, keys: list[str], window: int, order: int = 3) -> DataFrame:
    """Subtract a moving polynomial fit (``smooth``); whole windows are fitted at the two ends.

    ``window`` counts samples and is made odd. Recordings shorter than it hold their edge values. The
    fits of the first and last window are sums over orthonormal polynomials, ``order`` + 1 per key and
    end, so no matrix of the size of the window is part of the plan.
    """
    window -= 1 - window % 2
    m = window // 2
    q = poly_basis(window, order)
    mid = fir(once(samples), keys, list(q @ q[m]), "smooth")
    d = join_stats(mid, keys, _n=F.max("i") + 1)
    i, n = F.col("i"), F.col("_n")
    columns = [numbers(q[:, k]) for k in range(order + 1)]
    # A sample may lie in both end windows of a short recording.
    places = [(0, i, i < window), (1, i - n + window, i >= n - window)]
    ends = d.filter(n >= window)
    sums = [F.sum(F.when(near, F.col("y") * F.get(c, at.cast("int")))).alias(f"_s{side}{k}") for side, at, near in places for k, c in enumerate(columns)]
    d = d.join(ends.groupBy(*keys).agg(*sums), keys, "left")

    def fit(side: int, at: Column) -> Column:
        return sum((F.col(f"_s{side}{k}") * F.get(c, at.cast("int")) for k, c in enumerate(columns)), F.lit(0.0))

    edge = F.when(n >= window, F.when(i < m, fit(0, i)).when(i >= n - m, fit(1, i - n + window)))
    tip = (n >= window) & ((i < m) | (i >= n - m))
    d = d.withColumn("smooth", F.when(tip, edge).otherwise(F.col("smooth")))
    return d.withColumn("y", F.col("y") - F.col("smooth")).select(*samples.columns, "smooth")


def baseline(samples: DataFrame, t0: DataFrame, keys: list[str], max_dt: float | None = None) -> DataFrame:
    """Samples before the stimulus (``t0``) but the last, within ``max_dt`` of that last one."""
    d = samples.join(t0.select(*keys, F.col("t0").alias("_t0")), keys).filter(F.col("t") < F.col("_t0"))
    d = join_stats(d, keys, _last=F.max("t")).filter(F.col("t") < F.col("_last"))
    if max_dt is not None:
        d = d.filter(F.col("t") >= F.col("_last") - max_dt)
    return d.select(*samples.columns)


def subtract_baseline(samples: DataFrame, t0: DataFrame, keys: list[str], max_dt: float | None = None, bound: int | None = None) -> DataFrame:
    """Subtract the median of the baseline; the values of keys without one are null, their rows stay."""
    bound = largest(samples, keys) if bound is None else bound
    med = quantiles(baseline(samples, t0, keys, max_dt), keys, "y", bound, _med=0.5)
    return samples.join(med, keys, "left").withColumn("y", F.col("y") - F.col("_med")).select(*samples.columns)


def clip_low_percentile(samples: DataFrame, keys: list[str], q: float = 2.5, bound: int | None = None) -> DataFrame:
    """Clip below a percentile and shift it to zero."""
    d = with_quantiles(samples, keys, "y", bound, _clip=q / 100)
    return d.withColumn("y", F.greatest(F.col("y"), F.col("_clip")) - F.col("_clip")).select(*samples.columns)


def standardize(samples: DataFrame, keys: list[str], mode: int, t0: DataFrame | None = None) -> DataFrame:
    """Divide by the spread of the whole baseline (1) or of the trace (2); 0 leaves it.

    The values of keys without a baseline are null, their rows stay.
    """
    if mode == 0:
        return samples
    src = baseline(samples, t0, keys) if mode == 1 else samples
    sd = src.groupBy(*keys).agg(F.stddev_pop("y").alias("_sd"))
    return samples.join(sd, keys, "left").withColumn("y", F.col("y") / F.nullif(F.col("_sd"), F.lit(0.0))).select(*samples.columns)


def repair_steps(samples: DataFrame, keys: list[str], rtol: float = 0.1) -> DataFrame:
    """Recordings whose worst step is off the mean by more than ``rtol`` come on an even grid; the others stay."""
    samples = once(samples)
    bad = sampling_step(samples, keys).filter(F.col("rel_error") > rtol).select(*keys)
    even = resample_linear(samples.join(bad, keys, "left_semi"), keys)
    return samples.select(*keys, "i", "t", "y").join(bad, keys, "left_anti").unionByName(even)


# Samples of a recording, and of a window, up to which a window is fitted inside a task.
LONG = 131_072


def power_sum(a: int, b: int, k: int) -> int:
    """Sum of j^k for whole j from ``a`` to ``b``, exact and without a loop over j."""

    def upto(n: int) -> int:
        # Sum for 0..n by divided differences through k + 2 points.
        values = [sum(j**k for j in range(x + 1)) for x in range(k + 2)]
        total, choose = 0, 1
        for r in range(k + 2):
            total += choose * values[0]
            values = [q - p for p, q in zip(values, values[1:])]
            choose = choose * (n - r) // (r + 1)
        return total

    def below(n: int) -> int:
        return upto(n) if n >= 0 else (upto(-n - 1) - (k == 0)) * (1 if k % 2 else -1)

    return below(b) - below(a - 1) if b >= a else 0


def fit_terms(window: int, order: int) -> np.ndarray:
    """Inverse of the sums of products of powers of j / m over a window of 2 m + 1 samples.

    Its first row gives the weights, as a polynomial in j / m, of the fitted value in the middle.
    """
    m = (window - 1) // 2
    a = [[power_sum(-m, m, r + s) / max(m, 1) ** (r + s) for s in range(order + 1)] for r in range(order + 1)]
    return np.linalg.inv(np.array(a))


def folded_kernel(taps, half: int, n: int, mass) -> np.ndarray:
    """Weights of a kernel for a recording of ``n`` samples that holds its edge values.

    ``taps(j)`` are the weights of offsets j. Offsets of n - 1 and more always meet the edge, so their summed weight, ``mass(a, b)`` for offsets
    a to b, is put on the last one; no kernel is longer than the recording.
    """
    h = min(half, max(n - 1, 0))
    w = taps(np.arange(-h, h + 1, dtype=float))
    if h == 0:
        w[0] = mass(-half, half)
    elif h < half:
        w[0], w[-1] = mass(-half, -h), mass(h, half)
    return w


def smoothing_kernel(sigma: float, n: int) -> np.ndarray:
    """Gaussian kernel of four spreads to either side, folded to ``n`` samples."""
    half = int(4 * sigma + 0.5)
    if half < n:
        return np.array(gauss_kernel(sigma))

    def summed(a: int, b: int) -> float:
        # Beyond a million samples the sum and the integral differ by less than rounding.
        if b - a < 1_000_000:
            return float(np.exp(-0.5 * (np.arange(a, b + 1) / sigma) ** 2).sum())
        return sigma * math.sqrt(math.pi / 2) * (math.erf((b + 0.5) / sigma / math.sqrt(2)) - math.erf((a - 0.5) / sigma / math.sqrt(2)))

    total = summed(-half, half)
    return folded_kernel(lambda j: np.exp(-0.5 * (j / sigma) ** 2) / total, half, n, lambda a, b: summed(a, b) / total)


def trend_kernel(window: int, order: int, n: int) -> np.ndarray:
    """Weights of the moving polynomial fit in the middle of a window, folded to ``n`` samples."""
    m, a = window // 2, fit_terms(window, order)[0]
    return folded_kernel(lambda j: sum(c * (j / m) ** k for k, c in enumerate(a)), m, n, lambda lo, hi: float(sum(c * (power_sum(lo, hi, k) / m**k) for k, c in enumerate(a))))


def held_convolution(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Centred weighted sums of a series whose edge values are held; long kernels through the Fourier transform."""
    padded = np.pad(y, len(kernel) // 2, mode="edge")
    if len(kernel) < 1024 or np.isnan(y).any():
        return np.convolve(padded, kernel[::-1], mode="valid")
    size = 1 << (len(padded) + len(kernel)).bit_length()
    whole = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(kernel[::-1], size), size)
    return whole[len(kernel) - 1 : len(padded)]


def smooth_detrend(samples: DataFrame, keys: list[str], cutoff: float | None = None, window_s: float | None = None, order: int = 3, long: int = LONG, sigma_s: float | None = None) -> DataFrame:
    """Low-pass (3 dB point in Hz, or a Gaussian of ``sigma_s`` seconds), then minus a moving polynomial fit over ``window_s`` seconds.

    Both lengths are turned into samples by the rate of each recording, so recordings of different
    rates can share a table. One pass over index chunks; their size and their copied borders are those
    of the recording. The first and last window of a recording are fitted whole, a recording shorter than its window
    holds its edge values. Windows of more than ``long`` samples in a recording of more than that are
    fitted from running sums instead (:func:`_detrend_long`), so no task holds a window.
    """
    samples = once(samples)
    spread = sigma_s or (math.sqrt(math.log(2.0)) / (2 * math.pi * cutoff) if cutoff else 0.0)
    rate = F.coalesce((F.count("*") - 1) / nz(F.max("t") - F.min("t")), F.lit(0.0))
    rates = samples.groupBy(*keys).agg((F.max("i") + 1).alias("_n"), rate.alias("_fs"))
    window = F.floor(F.col("_fs") * float(window_s or 0.0)).cast("long")
    rates = rates.withColumn("_w", window - 1 + F.pmod(window, F.lit(2))).withColumn("_w", F.when(F.col("_w") > order, F.col("_w")).otherwise(0))
    rates = rates.withColumn("_long", (F.col("_w") > long) & (F.col("_n") > long))
    reach = F.least(F.floor(F.col("_fs") * (4 * spread) + 0.5), F.col("_n")) + F.when(F.col("_long"), 0).otherwise(F.least("_w", "_n"))
    rates = once(rates.withColumn("_reach", reach.cast("long")).withColumn("_size", F.greatest(F.lit(CHUNK), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("_reach", F.lit(1)))))).cast("long")))
    cut = samples.join(rates, keys)
    lo, hi = F.greatest(F.floor((F.col("i") - F.col("_reach")) / F.col("_size")), F.lit(0)), F.floor((F.col("i") + F.col("_reach")) / F.col("_size"))
    cut = cut.withColumn("_chunk", F.explode(F.sequence(lo, F.least(hi, F.floor((F.col("_n") - 1) / F.col("_size")))))).withColumn("_own", F.col("_chunk") == F.floor(F.col("i") / F.col("_size")))
    schema = StructType([*[f for f in samples.schema.fields if f.name != "y"], StructField("y", DoubleType()), StructField("_own", BooleanType())])

    rest = [c for c in samples.columns if c != "y"]

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y, i = pdf["y"].to_numpy(dtype=float), pdf["i"].to_numpy()
        n, fs, window = int(pdf["_n"].iloc[0]), float(pdf["_fs"].iloc[0]), 0 if pdf["_long"].iloc[0] else int(pdf["_w"].iloc[0])
        if spread * fs > 0:
            y = held_convolution(y, smoothing_kernel(spread * fs, n))
        if window:
            m = window // 2
            trend = held_convolution(y, trend_kernel(window, order, n))
            if n >= window:
                q = poly_basis(window, order)
                if i[0] == 0:
                    trend[:m] = (q @ (q.T @ y[:window]))[:m]
                if i[-1] == n - 1:
                    trend[len(y) - m :] = (q @ (q.T @ y[-window:]))[window - m :]
            y = y - trend
        out = pdf[rest].copy()
        out["y"] = pd.Series(y, index=pdf.index).astype(object).where(~np.isnan(y), None)
        out["_own"] = pdf["_own"]
        return out

    out = cut.groupBy(*keys, "_chunk").applyInPandas(filtered, schema).filter("_own").select(*samples.columns)
    wide = rates.filter("_long").select(*keys, "_n", "_w")
    if not window_s or wide.isEmpty():
        return out
    out = once(out)
    return out.join(wide, keys, "left_anti").unionByName(_detrend_long(out.join(wide, keys), keys, order).select(*samples.columns))


def _detrend_long(d: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Minus a moving polynomial fit over windows of ``_w`` = 2 m + 1 samples, from running sums.

    The fit in the middle of a window is a weighted sum of the moments of its samples. Recordings are cut into blocks of m + 1 samples with
    running sums of y u^r, u counted from the start of the block in units of m; a window is the end of one block, perhaps a whole
    one, and the start of another, so its moments come from two joins on shifted positions and lose no digits.
    The fits of the first and last window come from the moments of these. Values held beyond the edges have closed sums of powers.
    """
    if order > 5:
        raise ValueError("a polynomial of degree 5 at most")
    powers = range(order + 1)
    i, n, m = F.col("i"), F.col("_n"), ((F.col("_w") - 1) / 2).cast("long")

    @F.pandas_udf("array<double>")
    def terms(w: pd.Series) -> pd.Series:
        return pd.Series([fit_terms(int(x), order).ravel() for x in w])

    def moment(k: int, sums: Column, block: Column) -> Column:
        """Sum of ((u - i) / m)^k y over samples whose sums, counted from the start of their block, are given."""
        c = (block * (m + 1) - i) / m
        return sum((F.lit(float(math.comb(k, r))) * F.pow(c, F.lit(float(k - r))) * sums[r] for r in range(k + 1)), F.lit(0.0))

    def held(k: int, a: Column, b: Column) -> Column:
        """Sum of (j / m)^k for whole j from ``a`` to ``b``, an even power, zero if there are none."""
        def upto(x: Column) -> Column:
            x = x.cast("double")
            if k == 0:
                return x
            if k == 2:
                return x * (x + 1) * (2 * x + 1) / 6
            return x * (x + 1) * (2 * x + 1) * (3 * x * x + 3 * x - 1) / 30
        return F.when(b >= a, (upto(b) - upto(a - 1)) / F.pow(m.cast("double"), F.lit(float(k)))).otherwise(0.0)

    d = d.withColumn("_part", F.floor(i / (m + 1))).withColumn("_u", (i - F.col("_part") * (m + 1)) / m)
    own = {f"_v{r}": F.coalesce(F.col("y"), F.lit(0.0)) * F.pow("_u", F.lit(float(r))) for r in powers}
    d = d.withColumns(own)
    runs = once(scan(d, [*keys, "_part"], ["i"], **{f"_p{r}": ("sum", F.col(f"_v{r}")) for r in powers}))
    upto = F.array(*[F.col(f"_p{r}") for r in powers])
    before = F.array(*[F.col(f"_p{r}") - F.col(f"_v{r}") for r in powers])
    at = runs.select(*keys, "i", "_part", upto.alias("_s"), before.alias("_e"))
    whole = runs.groupBy(*keys, "_part").agg(F.array(*[F.sum(f"_v{r}") for r in powers]).alias("_t"))
    rest = once(at.join(whole, [*keys, "_part"]).select(*keys, "i", "_part", F.zip_with("_t", "_e", lambda t, e: t - e).alias("_q"), "_e"))
    x = runs.drop(*own, *[f"_p{r}" for r in powers], "_u", "_part").withColumns({"_hi": F.least(i + m, n - 1), "_lo": F.greatest(i - m, F.lit(0))})
    x = x.join(at.select(*keys, F.col("i").alias("_hi"), F.col("_part").alias("_bh"), F.col("_s").alias("_h")), [*keys, "_hi"])
    x = x.join(rest.select(*keys, F.col("i").alias("_lo"), F.col("_part").alias("_bl"), "_q", "_e"), [*keys, "_lo"])
    x = x.join(whole.select(*keys, (F.col("_part") - 1).alias("_bl"), F.col("_t").alias("_mid")), [*keys, "_bl"], "left")
    none = F.array(*[F.lit(0.0) for _ in powers])
    left = F.when(F.col("_bl") == F.col("_bh"), F.transform("_e", lambda v: -v)).otherwise(F.col("_q"))
    mid = F.when(F.col("_bh") - F.col("_bl") == 2, F.col("_mid")).otherwise(none)
    moments = F.array(*[moment(k, left, F.col("_bl")) + moment(k, F.coalesce(mid, none), F.col("_bl") + 1) + moment(k, F.col("_h"), F.col("_bh")) for k in powers])
    x = once(x.select(*d.drop(*own, "_u", "_part").columns, moments.alias("_m")))
    ends = x.groupBy(*keys).agg(F.max("_w").alias("_w"), F.min_by("y", "i").alias("_y0"), F.max_by("y", "i").alias("_y1"), F.max(F.when(i == m, F.col("_m"))).alias("_f"), F.max(F.when(i == n - 1 - m, F.col("_m"))).alias("_l"))
    ends = ends.withColumn("_t", terms("_w"))
    coefs = {c: F.array(*[sum((F.col("_t")[r * (order + 1) + k] * F.col(c)[k] for k in powers), F.lit(0.0)) for r in powers]) for c in ("_f", "_l")}
    # Written, so that the Python function runs for a row per recording, not per sample.
    ends = once(ends.withColumns(coefs).drop("_w"))
    x = x.join(ends, keys)
    middle = F.lit(0.0)
    for k in powers:
        if k % 2 == 0:
            beyond = F.col("_y0") * held(k, -m, -i - 1) + F.col("_y1") * held(k, n - i, m)
            middle = middle + F.col("_t")[k] * (F.col("_m")[k] + beyond)

    def fitted(coef: str, centre: Column) -> Column:
        return sum((F.col(coef)[k] * F.pow((i - centre) / m, F.lit(float(k))) for k in powers), F.lit(0.0))

    trend = F.when((n >= F.col("_w")) & (i < m), fitted("_f", m)).when((n >= F.col("_w")) & (i >= n - m), fitted("_l", n - 1 - m)).otherwise(middle)
    return x.withColumn("y", F.col("y") - trend)


def preprocess(samples: DataFrame, t0: DataFrame, keys: list[str], params: list[dict]) -> DataFrame:
    """The whole chain, once per parameter set, in a fixed order, tagged with ``preprocess_id``.

    Repair of uneven steps, edges, low-pass, detrending, baseline, non-negativity, spread, new rate.
    Parameters in seconds and Hz, which follow the rate of each recording: ``repair`` (worst step
    tolerated), ``cutoff``, ``window_s``, ``fs_resample`` (any rate). In samples, the same for all:
    ``sigma``, ``window``, ``down``. Besides: ``poly_order``, ``subtract_baseline``, ``max_dt``,
    ``non_negative``, ``standardize``. Each stage is written once, so the source is read a fixed
    number of times. The values of recordings without a baseline are null.
    """
    samples = once(samples)
    out, big = None, largest(samples, keys)
    clamped: dict = {}
    for p in params:
        tol = p.get("repair")
        if tol not in clamped:
            clamped[tol] = once(clamp_edges(repair_steps(samples, keys, tol) if tol is not None else samples, keys))
        d = clamped[tol]
        if p.get("cutoff") or p.get("window_s"):
            d = once(smooth_detrend(d, keys, p.get("cutoff"), p.get("window_s"), p.get("poly_order", 3)))
        if p.get("sigma"):
            d = smooth_fir(d, keys, p["sigma"])
        if p.get("window"):
            d = once(detrend_poly(d, keys, p["window"], p.get("poly_order", 3)).drop("smooth"))
        if p.get("subtract_baseline"):
            d = once(subtract_baseline(once(d), t0, keys, p.get("max_dt"), big))
        if p.get("non_negative"):
            d = clip_low_percentile(d, keys, bound=big)
        d = standardize(once(d), keys, p.get("standardize", 0), t0)
        if p.get("down", 1) > 1:
            d = downsample_blocks(d, keys, p["down"])
        if p.get("fs_resample"):
            d = resample_linear(once(d), keys, 1 / p["fs_resample"])
        d = d.select(F.lit(p["preprocess_id"]).alias("preprocess_id"), *keys, "i", "t", "y")
        out = d if out is None else out.unionByName(d)
    return out


def interpolate(grid: DataFrame, samples: DataFrame, keys: list[str], bound: int | None = None) -> DataFrame:
    """Linear interpolation of the samples at the grid times, ends held."""
    s = samples.select(*keys, "t", "y")
    d = asof(grid, s, keys, "t", bound, _b="before", _a="after_open")
    f = (F.col("t") - F.col("_b.t")) / nz(F.col("_a.t") - F.col("_b.t"))
    y = F.when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull(), F.col("_a.y"))
    return d.withColumn("y", y.otherwise(F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * f)).drop("_a", "_b")


def resample_linear(samples: DataFrame, keys: list[str], dt: float | None = None) -> DataFrame:
    """Uniform grid from the first to the last sample; the step defaults to the mean step per key."""
    ends = samples.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.count("*").alias("_n"))
    step = F.lit(dt) if dt is not None else (F.col("_t1") - F.col("_t0")) / F.nullif(F.col("_n") - 1, F.lit(0))
    ends = ends.withColumn("_dt", step)
    # A hair of tolerance keeps the last point when the span is a whole number of steps.
    n = F.coalesce(F.floor((F.col("_t1") - F.col("_t0")) / nz(F.col("_dt")) + 1e-9) + 1, F.lit(1))
    longest = ends.agg(F.max(n).alias("m")).first()["m"] or 0
    grid = explode_range(ends, n, "i").select(*keys, "i", (F.col("_t0") + F.coalesce(F.col("i") * F.col("_dt"), F.lit(0.0))).alias("t"))
    return interpolate(grid, samples, keys, longest + largest(samples, keys)).select(*keys, "i", "t", "y")


def upsample_linear(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n points per mean step, interpolated towards the next sample, the last one held."""
    d = with_neighbours(samples, keys, _y2=("y", 1), _t2=("t", 1)).join(mean_step(samples, keys), keys)
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    add = F.coalesce(F.col("dt"), F.lit(0.0)) * F.col("_j") / n
    f = F.least(add / nz(F.col("_t2") - F.col("t")), F.lit(1.0))
    y = F.when(F.col("_t2").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("_y2") - F.col("y")) * f)
    return d.select(*keys, (F.col("i") * n + F.col("_j")).alias("i"), (F.col("t") + add).alias("t"), y.alias("y"))


def upsample_hold(frames: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Repeat every frame n times at equal parts of the mean step."""
    d = frames.join(mean_step(frames, keys), keys).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rest = [c for c in frames.columns if c not in (*keys, "i", "t")]
    t = F.col("t") + F.coalesce(F.col("dt"), F.lit(0.0)) * F.col("_j") / n
    return d.select(*keys, (F.col("i") * n + F.col("_j")).alias("i"), t.alias("t"), *rest)


def downsample_blocks(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Means of whole blocks of n samples at the time of their first; the remainder is dropped."""
    b = samples.groupBy(*keys, F.expr(f"i div {n}").alias("_b")).agg(F.avg("y").alias("y"), F.min_by("t", "i").alias("t"), F.count("*").alias("_n"))
    return b.filter(F.col("_n") == n).select(*keys, F.col("_b").alias("i"), "t", "y")


def resampled_average(snips: DataFrame, starts: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Mean over repetitions after interpolating each to one grid of ``fs`` points per second."""
    big = largest(starts, keys)
    w = scan(starts.select(*keys, "rep", "t0"), keys, ["rep"], big, _p=("prev", F.col("t0")))
    dur = quantiles(w.withColumn("_g", F.col("t0") - F.col("_p")), keys, "_g", big, _dur=0.5)
    longest = dur.agg(F.max(F.ceil(F.col("_dur") * fs)).alias("m")).first()["m"] or 0
    g = starts.select(*keys, "rep").join(dur, keys)
    g = explode_range(g, F.ceil(F.col("_dur") * fs), "j").select(*keys, "rep", "j", (F.col("j") / fs).alias("t"))
    rel = snips.join(starts.select(*keys, "rep", "t0"), [*keys, "rep"]).withColumn("t", F.col("t") - F.col("t0"))
    r = interpolate(g, rel, [*keys, "rep"], longest + largest(snips, [*keys, "rep"]))
    return r.groupBy(*keys, "j").agg(F.first("t").alias("t"), F.avg("y").alias("avg"))


def expand_frame_times(triggers: DataFrame, keys: list[str], n: int, n_frames: int | str) -> DataFrame:
    """n frame times per trigger, parts of a second apart; more times than frames are an error.

    ``n_frames`` is a number, or a column of the triggers with the length of the stimulus shown.
    """
    most = F.col(n_frames) if isinstance(n_frames, str) else F.lit(n_frames)
    d = triggers.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    frame = F.col("k") * n + F.col("_j")
    ok = F.when(frame < most, frame).otherwise(F.raise_error(F.lit("more trigger times than stimulus frames")).cast("long"))
    return d.select(*keys, ok.alias("frame"), (F.col("t") + F.col("_j") / F.lit(float(n))).alias("t"))


def runs(series: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse equal neighbouring values: ``run, y, i0, i1`` with the values before and after."""
    s = with_neighbours(series.select(*keys, "i", "y"), keys, _p=("y", -1))
    s = scan(s, keys, ["i"], largest(series, keys), run=("sum", F.when(F.col("_p").eqNullSafe(F.col("y")), 0).otherwise(1)))
    r = s.groupBy(*keys, "run").agg(F.first("y").alias("y"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    r = r.withColumn("i", F.col("run") - 1)
    return with_neighbours(r, keys, before=("y", -1), after=("y", 1)).drop("i")


def find_peaks(series: DataFrame, keys: list[str], height: str | float | None = None, prominence: float | None = None) -> DataFrame:
    """Local maxima (middle of a plateau, never at the ends) with height and prominence limits.

    ``height`` may name a column of per-key limits. For prominence a stack of open maxima runs over blocks of
    maxima, a task each; only maxima that no other of their block exceeds go on to the blocks
    beside it (:func:`_bases`).
    """
    r = runs(series, keys)
    r = r if prominence is None else once(r)
    top = (F.col("before").isNull() | (F.col("before") < F.col("y"))) & (F.col("after").isNull() | (F.col("after") < F.col("y")))
    inner = F.col("before").isNotNull() & F.col("after").isNotNull()
    tops = r.filter(top).withColumn("_inner", inner)
    if prominence is None:
        out = tops.filter("_inner")
    else:
        big = largest(series, keys)
        tops = durable(indexed(tops, keys, ["run"], "p", big))
        low = scan(r.join(tops.select(*keys, "run", "p"), [*keys, "run"], "left"), keys, ["run"], big, _gap=("after", F.col("p")))
        last = once(tops.groupBy(*keys).agg((F.max("p") + 1).alias("_m")))
        low = low.filter("p is null").join(last, keys).withColumn("p", F.coalesce("_gap", "_m"))
        valley = once(low.groupBy(*keys, "p").agg(F.min("y").alias("v")))
        inf = F.lit(float("inf"))
        nxt = valley.withColumn("p", F.col("p") - 1)
        sides = [tops.join(v, [*keys, "p"], "left").select(*keys, F.lit(o).alias("side"), "p", "y", (F.col("p") + o).alias("q"), F.coalesce("v", inf).alias("m")) for v, o in ((valley, -1), (nxt, 1))]
        base = _bases(sides[0].unionByName(sides[1]), last, keys, rows=2 * tops.count())
        base = base.groupBy(*keys, "p").agg(F.max("m").alias("_base"))
        out = tops.filter("_inner").join(base, [*keys, "p"])
        out = out.withColumn("prominence", F.col("y") - F.col("_base")).filter(F.col("prominence") >= prominence)
    if height is not None:
        out = out.filter(F.col("y") >= (F.col(height) if isinstance(height, str) else F.lit(height)))
    return out.select(*keys, F.expr("(i0 + i1) div 2").alias("i"), "y", *(["prominence"] if prominence is not None else []))


def _bases(sides: DataFrame, last: DataFrame, keys: list[str], block: int = CHUNK, rows: int = 0) -> DataFrame:
    """Lowest value ``m`` between every maximum ``p`` and the next higher one (or the end) on each side.

    Within a block of consecutive maxima a stack of those not exceeded so far gives the answer in one pass. A maximum
    left open looks on from the border of its block, along the maxima that are open towards it
    in the blocks there; without such borders there are no rounds. Blocks of several keys share a call,
    so short series do not cost a call each; ``rows`` sets how many lots the keys are dealt into.
    """
    block = min(block, task_rows(sides))
    lots = rows // block + 1
    own = [f for f in sides.schema.fields if f.name in keys]
    schema = StructType([*own, *[StructField(n, t) for n, t in (("side", IntegerType()), ("p", LongType()), ("y", DoubleType()), ("q", LongType()), ("m", DoubleType()), ("open", BooleanType()), ("seen", BooleanType()))]])

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        step = -int(pdf["side"].iloc[0])
        code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), dtype=np.int64)
        order = np.lexsort((step * pdf["p"].to_numpy(), code))
        pdf, code = pdf.iloc[order], code[order]
        at, y, low = pdf["p"].to_numpy(), pdf["y"].to_numpy(float).tolist(), pdf["m"].to_numpy(float).tolist()
        to, seen = np.empty(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            higher, out = [], at[a] - step
            for k in range(a, b):
                while higher and y[higher[-1]] <= y[k]:
                    low[k] = min(low[k], low[higher.pop()])
                to[k] = at[higher[-1]] if higher else out
                higher.append(k)
            seen[higher] = True
        first = np.repeat(at[cuts[:-1]], np.diff(cuts))
        out = pdf[[*keys, "side", "p", "y"]].copy()
        out["q"], out["m"], out["open"], out["seen"] = to, low, to == first - step, seen
        return out[schema.names]

    d = sides.withColumn("side", F.col("side").cast("int")).withColumn("_blk", F.floor(F.col("p") / block))
    lot = F.pmod(F.xxhash64(*keys), F.lit(lots)) if keys else F.lit(0).cast("long")
    d = written(d.withColumn("_lot", lot).groupBy("_lot", "side", "_blk").applyInPandas(stack, schema))
    d = d.join(last, keys).withColumn("open", F.col("open") & (F.col("q") >= 0) & (F.col("q") < F.col("_m"))).drop("_m")
    going = d.filter("open")
    if going.isEmpty():
        return d
    # A maximum exceeded by a later one of its block is not met from beyond that block.
    met = _climb(durable(d.filter("open or seen").select(*keys, "side", "p", "y", "q", "m", "open")), [*keys, "side"])
    return d.filter("not open").select(*keys, "side", "p", "m").unionByName(met.filter("open").select(*keys, "side", "p", "m"))


def _climb(d: DataFrame, keys: list[str]) -> DataFrame:
    """Follow pointers ``q`` over maxima that are not higher, keeping the lowest value on the way."""
    while True:
        o = d.select(*keys, F.col("p").alias("q"), F.col("y").alias("_oy"), F.col("q").alias("_oq"), F.col("m").alias("_om"))
        d = d.join(o, [*keys, "q"], "left")
        go = F.col("_oy").isNotNull() & (F.col("_oy") <= F.col("y"))
        d = d.select(
            *keys, "p", "y", F.when(go, F.col("_oq")).otherwise(F.col("q")).alias("q"),
            F.when(go, F.least("m", "_om")).otherwise(F.col("m")).alias("m"), "open", go.alias("_go"),
        )
        d = durable(d)
        if d.filter("_go").isEmpty():
            return d.drop("_go")
        d = d.drop("_go")


def event_signal(samples: DataFrame, keys: list[str], kind: str = "trace") -> DataFrame:
    """The trace, its positive steps, or the peaks of its steps above the robust spread."""
    return samples if kind == "trace" else events_of_steps(steps(samples, keys), keys, kind)


def steps(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of every sample to the one before; zero for the first."""
    return with_neighbours(samples, keys, _p=("y", -1)).withColumn("y", F.coalesce(F.col("y") - F.col("_p"), F.lit(0.0))).drop("_p")


def events_of_steps(d: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Steps cut at zero (gradient), or their peaks above the robust spread (events)."""
    if kind == "gradient":
        return d.withColumn("y", F.greatest(F.col("y"), F.lit(0.0)))
    if kind != "events":
        raise ValueError(kind)
    samples, d = d, once(d)
    mad = quantiles(d.withColumn("_a", F.abs("y")), keys, "_a", largest(samples, keys), _mad=0.5)
    peaks = find_peaks(d, keys).withColumnRenamed("y", "_h").join(mad, keys).filter(F.col("_h") >= F.col("_mad") / 0.6745)
    out = d.join(peaks.select(*keys, "i", "_h"), [*keys, "i"], "left")
    return out.withColumn("y", F.coalesce("_h", F.lit(0.0))).select(*samples.columns)


def stim_to_trace(frames: DataFrame, samples: DataFrame, keys: list[str], resample: bool = False) -> DataFrame:
    """Hold each stimulus frame until the next; only samples inside the stimulus span are kept."""
    f = with_neighbours(frames.select(*keys, F.col("frame").alias("i"), "t"), keys, _p=("t", -1))
    span = f.groupBy(*keys).agg(F.min("t").alias("_a"), (F.max("t") + F.max(F.col("t") - F.col("_p"))).alias("_b"))
    s = samples.join(span, keys).filter((F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_b"))).select(*keys, "i", "t", "y")
    if resample:
        s = resample_linear(s, keys)
    big = largest(samples, keys) + largest(frames, keys)
    d = asof(s, frames.select(*keys, "t", "frame"), keys, "t", None if resample else big, _f="before")
    return d.select(*keys, "i", "t", "y", F.col("_f.frame").alias("frame"))


def trace_to_stim(frames: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the samples from each frame to the next; the last frame lasts one mean step."""
    f = frames.select(*keys, F.col("frame").alias("i"), "t")
    end = f.join(mean_step(f, keys), keys).groupBy(*keys).agg((F.max("t") + F.first("dt")).alias("_end"))
    s = samples.join(end, keys).filter(F.col("t") < F.col("_end")).select(*keys, "t", "y")
    big = largest(samples, keys) + largest(frames, keys)
    d = asof(s, frames.select(*keys, "t", "frame"), keys, "t", big, _f="before").filter("_f is not null")
    sums = d.groupBy(*keys, F.col("_f.frame").alias("frame")).agg(F.sum("y").alias("y"))
    return frames.select(*keys, "frame", "t").join(sums, [*keys, "frame"], "left").fillna(0.0, ["y"])


def align_for_regression(
    frames: DataFrame, samples: DataFrame, keys: list[str], kind: str = "trace", sigma: float | None = None, up: int = 1, ref: str = "trace",
    repair: float | None = None, cutoff: float | None = None, pre_blur_s: float = 0.0, post_blur_s: float = 0.0, up_frames: int = 1,
) -> DataFrame:
    """Repair, low-pass, smooth, take steps, upsample, find events, align with the stimulus, smooth, unit spread: ``i, frame, y``.

    ``repair`` is the worst uneven step tolerated, ``cutoff`` in Hz, ``pre_blur_s`` and ``post_blur_s`` are spreads in seconds
    before and after the alignment, at the rate that the series has there; ``sigma`` is a spread in samples. ``up`` and ``up_frames`` raise
    the rates of the trace and of the stimulus. Events and gradients are taken from the upsampled steps, so that an event stays
    one sample. ``frame`` counts the frames after raising their rate.
    """
    s = repair_steps(samples, keys, repair) if repair is not None else samples
    if cutoff:
        s = smooth_detrend(s, keys, cutoff)
    if pre_blur_s:
        s = smooth_detrend(s, keys, sigma_s=pre_blur_s)
    if sigma:
        s = smooth_fir(s, keys, sigma)
    if kind != "trace":
        s = steps(s, keys)
    if up > 1:
        s = upsample_linear(s, keys, up)
    if kind != "trace":
        s = events_of_steps(s, keys, kind)
    if up_frames > 1:
        f = upsample_hold(frames.select(*keys, F.col("frame").alias("i"), "t", F.col("frame").cast("double").alias("y")), keys, up_frames)
        frames = f.select(*keys, F.col("i").alias("frame"), "t")
    if ref == "trace":
        d = stim_to_trace(frames, s, keys).select(*keys, "i", "t", "y", "frame")
        d = indexed(d.drop("i"), keys, ["t"], bound=up * largest(samples, keys))
    else:
        d = trace_to_stim(frames, s, keys).withColumn("i", F.col("frame"))
    if post_blur_s:
        d = smooth_detrend(d.withColumn("i", F.col("i").cast("long")), keys, sigma_s=post_blur_s)
    d = join_stats(d, keys, _sd=F.stddev_pop("y"))
    return d.select(*keys, "i", "t", "frame", (F.col("y") / F.nullif(F.col("_sd"), F.lit(0.0))).alias("y"))


def ordered_split(df: DataFrame, keys: list[str], train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """First part train, then dev, then test, by the index ``i``."""
    d = join_stats(df, keys, _n=F.max("i") + 1)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + dev))
    return d.withColumn("split", F.when(F.col("i") < a, "train").when(F.col("i") < b, "dev").otherwise("test")).drop("_n")


def blocked_kfold(df: DataFrame, keys: list[str], k: int, gap: int) -> DataFrame:
    """Every row once per fold as train or dev; folds are contiguous, the first ones a row longer.

    Training rows up to ``gap`` positions after the held-out block are left out.
    """
    d = join_stats(df, keys, _n=F.max("i") + 1).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    lo = F.col("fold") * size + F.least(F.col("fold"), more)
    hi = lo + size - 1 + F.when(F.col("fold") < more, 1).otherwise(0)
    role = F.when(F.col("i").between(lo, hi), "dev").when((F.col("i") < lo) | (F.col("i") > hi + gap), "train")
    return d.withColumn("role", role).filter("role is not null").drop("_n")


def lag_matrix(series: DataFrame, keys: list[str], n_lag: int, shift: int = 0, value: str = "y") -> DataFrame:
    """One row per (position, lag column): the series at ``i + lag - n_lag - shift + 1``, zero outside."""
    offs = [l - n_lag - shift + 1 for l in range(n_lag)]
    cut, w = halo(series, keys, max([-o for o in offs] + [0]), max([*offs, 0]))
    take = [F.coalesce((F.lead(value, o) if o > 0 else F.lag(value, -o)).over(w), F.lit(0.0)) for o in offs]
    d = own(cut.withColumn("_x", F.array(*take)))
    return d.select(*keys, "i", F.posexplode("_x").alias("lag", "x"))


def lag_axis(df: DataFrame, past: Column, future: Column, dt: Column) -> DataFrame:
    """Lag times from ``past`` seconds back to ``future`` seconds ahead, with shift and burn-in."""
    n_past, n_future = F.ceil(past / dt), F.ceil(future / dt)
    d = df.withColumn("shift", -n_future).withColumn("burn_in", n_past)
    ks = F.sequence(1 - n_past, n_future)
    return d.select(*df.columns, "shift", "burn_in", F.posexplode(F.transform(ks, lambda k: k * dt)).alias("lag", "t"))


def rank_tags(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Label of group and rank along an axis, counted from 1."""
    return indexed(df, [group], order, "_r").withColumn(name, F.concat(F.col(group).cast("string"), F.lit("_"), (F.col("_r") + 1).cast("string"))).drop("_r")


def significant_intervals(curve: DataFrame, keys: list[str], x: str, est: str, ci: str) -> DataFrame:
    """Runs where the confidence band excludes zero: from the point before the run to its last."""
    pos, neg = (F.col(est) - F.col(ci) > 0).cast("int"), (F.col(est) + F.col(ci) < 0).cast("int")
    out, big = None, largest(curve, keys)
    for sign, flag in ((1, pos), (-1, neg)):
        d = scan(curve.withColumn("_f", flag), keys, [x], big, _pf=("prev", F.col("_f")), _px=("prev", F.col(x)))
        start = (F.col("_f") == 1) & (F.coalesce("_pf", F.lit(0)) == 0)
        d = scan(d.withColumn("_s", start.cast("int")), keys, [x], big, _run=("sum", F.col("_s"))).filter("_f = 1")
        d = d.groupBy(*keys, "_run").agg(
            F.max(F.when(F.col("_s") == 1, F.coalesce(F.col("_px"), F.col(x)))).alias("x0"), F.max(x).alias("x1")
        )
        d = d.select(*keys, F.lit(sign).alias("sign"), "x0", "x1")
        out = d if out is None else out.unionByName(d)
    return out


def cut_at_index(samples: DataFrame, fixes: DataFrame, keys: list[str], used: DataFrame | None = None) -> DataFrame:
    """Truncate listed recordings at ``bad_i``; a listed key already in use is an error."""
    if used is not None and not fixes.join(used, keys, "left_semi").isEmpty():
        raise ValueError("a listed recording has already been used")
    d = samples.join(fixes.select(*keys, "bad_i"), keys, "left")
    return d.filter(F.col("bad_i").isNull() | (F.col("i") < F.col("bad_i"))).select(*samples.columns)


def blank_repetitions(samples: DataFrame, triggers: DataFrame, edits: DataFrame, keys: list[str], n_per_rep: int) -> DataFrame:
    """``+n`` keeps the first n repetitions (and the sample that ends them), ``-x`` blanks repetition x."""
    first = triggers.filter(F.col("k") % n_per_rep == 0).select(*keys, F.expr(f"k div {n_per_rep}").alias("rep"), "t")
    at = nearest_index(first, samples, keys, side="after", bound=largest(triggers, keys)).filter("si is not null").select(*keys, "rep", F.col("si").alias("_i"))
    e = edits.select(*keys, "edit", F.abs("edit").alias("rep")).join(at, [*keys, "rep"], "left").withColumnRenamed("_i", "_hi")
    e = e.withColumn("rep", F.col("rep") - 1).join(at, [*keys, "rep"], "left").withColumnRenamed("_i", "_lo")
    e = e.withColumn("_from", F.when(F.col("edit") > 0, F.col("_hi") + 1).otherwise(F.col("_lo")))
    e = e.withColumn("_to", F.when(F.col("edit") < 0, F.col("_hi"))).filter("_from is not null")
    e = e.groupBy(*keys).agg(F.collect_set(F.struct("_from", "_to")).alias("_cuts"))
    d = samples.join(e, keys, "left")
    gone = F.exists("_cuts", lambda c: (F.col("i") >= c["_from"]) & (c["_to"].isNull() | (F.col("i") < c["_to"])))
    return d.withColumn("y", F.when(F.coalesce(gone, F.lit(False)), None).otherwise(F.col("y"))).select(*samples.columns)


def top2_peaks_by_time(peaks: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """The two largest peaks; the newest is main, the other pre. See ``peaks`` for the fallback.

    With one peak, pre is the opposite extreme of the series before it (null if there is none).
    """
    w = Window.partitionBy(*keys)
    big = peaks.withColumn("_r", F.row_number().over(w.orderBy(F.abs("y").desc(), F.col("i").desc()))).filter("_r <= 2")
    big = big.withColumn("_t", F.row_number().over(w.orderBy(F.col("i").desc())))
    two = big.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_t") == n, F.col(c))).alias(f"{role}_{c}") for n, role in ((1, "main"), (2, "pre")) for c in ("i", "y")]
    )
    s = series.join(two.filter("pre_i is null").select(*keys, "main_i", "main_y"), keys).filter(F.col("i") < F.col("main_i"))
    sign = F.when(F.col("main_y") > 0, -1.0).otherwise(1.0)
    alt = s.groupBy(*keys).agg(F.max_by(F.struct("i", "y"), F.struct(sign * F.col("y"), -F.col("i"))).alias("_alt"))
    d = two.join(alt, keys, "left")
    return d.select(*keys, "main_i", "main_y", F.coalesce("pre_i", "_alt.i").alias("pre_i"), F.coalesce("pre_y", "_alt.y").alias("pre_y"))
