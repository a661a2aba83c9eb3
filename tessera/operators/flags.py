"""Predicates, flags and case classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigger_count_flag(n: Column, expected: Column, repeated: Column) -> Column:
    """1 if the count equals the expected one, or a multiple of it for repeated stimuli."""
    return F.when(repeated == 1, n % expected == 0).otherwise(n == expected).cast("int")


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def trace_valid_flag(traces: DataFrame, samples: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """1 if the trace has samples and all of them, and their times, are finite."""
    ok = (finite(F.col(t)) & finite(F.col(y))).cast("int")
    per = samples.groupBy(*keys).agg(F.min(ok).alias("trace_flag"))
    return traces.select(*keys).join(per, keys, "left").fillna(0, ["trace_flag"])


def triggers_inside_flag(samples: DataFrame, triggers: DataFrame, keys: list[str]) -> DataFrame:
    """1 if the first and last trigger lie inside the trace."""
    s = samples.groupBy(*keys).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    g = triggers.groupBy(*keys).agg(F.min("t").alias("g0"), F.max("t").alias("g1"))
    inside = F.coalesce((F.col("g0") >= F.col("s0")) & (F.col("g1") <= F.col("s1")), F.lit(False))
    return s.join(g, keys, "left").select(*keys, inside.cast("int").alias("trigger_flag"))


def quality_flag(rois: DataFrame, qi: DataFrame, keys: list[str], qidx: str, minimum: float, name: str) -> DataFrame:
    """-1 without an index, 0 below the minimum, 1 otherwise; two indices for a key are an error."""
    one = qi.groupBy(*keys).agg(F.max(qidx).alias("_q"), F.count("*").alias("_n"))
    flag = (
        F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one quality index for a key")).cast("int"))
        .when(F.col("_n").isNull(), -1)
        .when(F.col("_q") >= minimum, 1)
        .otherwise(0)
    )
    return rois.join(one, keys, "left").withColumn(name, flag).drop("_q", "_n")


def quality_total(flags: list[str], mode: str = "or") -> Column:
    """1 if any (or every) flag is 1."""
    good = [(F.col(f) == 1).cast("int") for f in flags]
    if mode == "or":
        return F.greatest(*good)
    if mode == "and":
        return F.least(*good)
    raise ValueError(mode)


def model_quality_fraction(p: Column, scores: dict[str, list[Column]], perm_alpha=0.0, min_corr=0.0, max_mse=0.0) -> Column:
    """Share of the enabled checks that pass; a missing dev score passes.

    ``scores`` holds train, dev and test columns under ``corr`` and ``mse``.
    """
    checks = []
    if perm_alpha > 0:
        checks.append(p <= perm_alpha)
    for kind, limit, good in (("corr", min_corr, lambda c: c >= min_corr), ("mse", max_mse, lambda c: c <= max_mse)):
        if limit > 0:
            train, dev, test = scores[kind]
            checks.append(good(train) & F.coalesce(good(dev), F.lit(True)) & good(test))
    return sum((c.cast("double") for c in checks), F.lit(0.0)) / F.lit(float(len(checks)))


def rf_quality_filter(df: DataFrame, kind: str, max_lag: float, diameter: tuple[float, float], split_min: float, fit_min: float, contour_min: float) -> DataFrame:
    """Lag limit for all; diameter, split and fit or contour quality where there is a fit."""
    if kind not in ("gauss", "dog", "pos_dog", "contour", "none"):
        raise ValueError(kind)
    ok = F.col("main_peak_lag") <= max_lag
    if kind != "none":
        ok &= F.col("rf_cdia_um").between(*diameter) & (F.col("split_qidx") > split_min)
        ok &= F.col("largest_contour_ratio") >= contour_min if kind == "contour" else F.col("rf_qidx") > fit_min
    return df.filter(ok)


def name_kind(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose text occurs in the name; ``^x`` asks for a prefix. Case is ignored."""
    out, low = None, F.lower(name)
    for text, label in rules:
        hit = low.startswith(text[1:]) if text.startswith("^") else low.contains(text)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


# Field name parts and the ROI kinds they stand for.
ROI_KINDS = [("soma", "soma"), ("stack", "stack"), ("field", "field"), ("^d", "roi")]


def roi_kind(field: Column) -> Column:
    return name_kind(field, ROI_KINDS, "other")


def quadrant_category(tn: Column, vd: Column, centre: float = 0.0) -> dict[str, Column]:
    """Side labels of a position: nasal/temporal, ventral/dorsal and their combinations."""
    nt = F.when(tn < -centre, "t").when(tn > centre, "n").otherwise("c")
    side = F.when(vd < -centre, "v").when(vd > centre, "d").otherwise("c")
    both = F.concat(nt, side)
    return {
        "nt_side": nt,
        "vd_side": side,
        "ntvd_side": both,
        "n_tvd_side": F.when(nt == "t", both).otherwise(nt),
        "nvd_t_side": F.when(nt == "n", both).otherwise(nt),
    }


def wing_category(tn: Column, vd: Column, centre: float = 0.0) -> Column:
    """Diagonal quadrant, or c inside the central disc."""
    right, top = tn > vd, -tn < vd
    wing = F.when(right & top, "n").when(right, "v").when(top, "d").otherwise("t")
    return F.when(F.hypot(tn, vd) < centre, "c").otherwise(wing)


def regroup(label: Column, groups: dict[str, str]) -> Column:
    """Map labels to groups; an unknown label is an error."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    got = F.try_element_at(pairs, label)
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string"))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def response_filter(df: DataFrame, q_min: float, n_min: int, chirp_min: float) -> DataFrame:
    """White response good, and green or blue good, enough repetitions, good chirp."""
    q = (F.col("w_qidx") > q_min) & ((F.col("g_qidx") > q_min) | (F.col("b_qidx") > q_min))
    return df.filter(q & (F.col("n_reps") >= n_min) & (F.col("qidx") > chirp_min))


def region_split(boxes: dict[str, dict[str, tuple]], default: str) -> Column:
    """First named box (open ranges per column, None = unlimited) that holds the row."""
    out = None
    for name, ranges in boxes.items():
        inside = F.lit(True)
        for c, (lo, hi) in ranges.items():
            if lo is not None:
                inside &= F.col(c) > lo
            if hi is not None:
                inside &= F.col(c) < hi
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(default)


def validate_trial_info(trials: Column, per_rep: Column) -> Column:
    """Trials are non-empty, have whole positive counts, and add up to the triggers per repetition."""
    whole = F.forall(trials, lambda s: (s["ntrigger"] == F.floor(s["ntrigger"])) & (s["ntrigger"] > 0) & s["name"].isNotNull())
    total = F.aggregate(trials, F.lit(0.0), lambda a, s: a + s["ntrigger"])
    return F.coalesce((F.size(trials) > 0) & whole & (total == per_rep), F.lit(False))
