"""Data set splits, augmentation, models and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantile import quantiles
from ..plans.scan import indexed, scan
from ..plans.stats import join_stats
from ..session import durable

Model = Callable[[DataFrame], DataFrame]


def seeded(seed: int, *cols: str) -> Column:
    """Order of a seeded shuffle: the MD5 of seed and key as text, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def seeded_number(seed: int, *cols: str) -> Column:
    """First 32 bits of the seeded hash as a whole number."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("long")


def mirror_pair(name: Column) -> Column:
    """Common name of a left/right pair."""
    return F.regexp_replace(F.regexp_replace(name, "left", "*"), "right", "*")


def length_split(items: DataFrame, ident: str, length: str, train: float = 0.7, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Split by total length in a seeded hash order, mirror pairs together.

    The first pair goes to test and the second to dev (where those have a share), the next ones to
    train until it is full, then to dev until that is full, the rest to test.
    """
    d = items.withColumn("_pair", mirror_pair(F.col(ident)))
    p = d.groupBy("_pair").agg(F.sum(length).alias("_len")).withColumn("_h", seeded(seed, "_pair"))
    p = scan(p, [], ["_h", "_pair"], _k=("index", F.lit(1)))
    test = 1 - train - dev > 1e-9
    n0 = int(test) + int(dev > 0)
    first_dev = int(test)
    rest = F.when(F.col("_k") >= n0, F.col("_len")).otherwise(0)
    p = scan(p, [], ["_h", "_pair"], _after=("sum", rest)).withColumn("_before", F.col("_after") - rest)
    p = join_stats(p, [], _tot=F.sum("_len"), _dev0=F.coalesce(F.sum(F.when((F.col("_k") == first_dev) & F.lit(dev > 0), F.col("_len"))), F.lit(0)))
    is_train = (F.col("_k") >= n0) & (F.col("_before") < F.floor(F.col("_tot") * train))
    p = join_stats(p, [], _t=F.coalesce(F.max(F.when(is_train, F.col("_after"))), F.lit(0)))
    is_dev = (F.col("_k") >= n0) & ~is_train & (F.col("_dev0") + F.col("_before") - F.col("_t") < F.floor(F.col("_tot") * dev))
    kind = F.when((F.col("_k") == first_dev) & F.lit(dev > 0), "dev").when((F.col("_k") == 0) & F.lit(test), "test")
    kind = kind.when(is_train, "train").when(is_dev, "dev").otherwise("test")
    return d.join(p.select("_pair", kind.alias("split_kind")), "_pair").drop("_pair")


def count_split(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Shuffled train/test split by count with at least one row on each side."""
    d = scan(df.withColumn("_h", seeded(seed, *keys)), [], ["_h", *keys], _k=("index", F.lit(1)))
    d = join_stats(d, [], _n=F.count("*"))
    m = F.greatest(F.least(F.rint(F.col("_n") * fraction), F.col("_n") - 1), F.lit(1))
    return d.withColumn("split_kind", F.when(F.col("_k") < m, "train").otherwise("test")).drop("_h", "_k", "_n")


def group_folds(df: DataFrame, group: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Fold per group, strata spread evenly; one rule for any number of groups.

    Groups are put in order of their rows per stratum, in ascending strata, larger counts first, and of a seeded
    hash where those agree, and dealt to the folds in turn. So groups that are alike go to different folds, and
    nothing but a row per group is sorted. A group has as many strata as it has rows at most.
    """
    per = df.groupBy(group, stratum).agg(F.count("*").alias("n"))
    profile = per.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(stratum).alias("s"), (-F.col("n")).alias("n")))).alias("_p"))
    order = indexed(profile.withColumn("_h", seeded(seed, group)), [], ["_p", "_h", group], "_k")
    return order.select(group, (F.col("_k") % k).cast("int").alias("fold"))


def distance_split(df: DataFrame, group: str, dist: str, ratios: tuple[int, int, int] = (7, 1, 2), q: int = 10, seed: int = 42) -> DataFrame:
    """Group-preserving train/dev/test split, stratified by quantile bins of a distance; rows without one: none.

    Without any distance all rows are none; an empty table stays empty.
    """
    train, dev, test = ratios
    used = df.filter(F.col(dist).isNotNull())
    cuts = quantiles(used, [], dist, **{f"q{i}": i / q for i in range(1, q)}).first()
    edges = F.array(*[F.lit(float(c)) for c in cuts or () if c is not None]).cast("array<double>")
    used = durable(used.withColumn("_s", F.size(F.filter(edges, lambda e: F.col(dist) > e))))
    t = group_folds(used, group, "_s", (train + dev) // test, seed).filter("fold = 0").select(group, F.lit("test").alias("_t"))
    rest = used.join(t, group, "left_anti")
    d = group_folds(rest, group, "_s", train // dev, seed + 1).filter("fold = 0").select(group, F.lit("dev").alias("_d"))
    out = df.join(t, group, "left").join(d, group, "left")
    kind = F.when(F.col(dist).isNull(), "none").otherwise(F.coalesce("_t", "_d", F.lit("train")))
    return out.withColumn("split_kind", kind).drop("_t", "_d")


def dataset_view(points: DataFrame, norms: DataFrame, splits: DataFrame, file_keys: list[str], point_keys: list[str], split_id: int) -> DataFrame:
    """Points with the norms of their data set and their part of one split."""
    s = splits.filter(F.col("split_id") == split_id).select(*point_keys, "split_kind")
    return points.join(norms, file_keys).join(s, point_keys).filter("split_kind in ('train', 'dev', 'test')")


def shift_target(points: DataFrame, keys: list[str], n: int, targets: list[str], present: Column | None = None) -> DataFrame:
    """Targets from n frames ahead; with ``present`` only frames meeting it, with the frames left per key."""
    t = points.select(*keys, (F.col("frame") - n).alias("frame"), *targets)
    d = points.drop(*targets).join(t, [*keys, "frame"])
    if present is None:
        return d
    d = d.filter(present)
    return d.join(d.groupBy(*keys).agg(F.count("*").alias("x_len")), keys)


def augment_flips(frames: DataFrame, nx: int, ny: int, tx: str = "tx", ty: str = "ty") -> DataFrame:
    """Four mirror versions (``flip`` 0..3) of the pixels with the signs of the targets to match."""
    d = frames.withColumn("flip", F.explode(F.sequence(F.lit(0), F.lit(3))))
    fy, fx = F.col("flip").isin(1, 3), F.col("flip").isin(2, 3)
    return d.withColumns({
        "x": F.when(fx, nx - 1 - F.col("x")).otherwise(F.col("x")), "y": F.when(fy, ny - 1 - F.col("y")).otherwise(F.col("y")),
        tx: F.when(fx, -F.col(tx)).otherwise(F.col(tx)), ty: F.when(fy, -F.col(ty)).otherwise(F.col(ty)),
    })


def with_without_mix(df: DataFrame, keys: list[str], x: str, x_wo: str, seed: int = 42) -> DataFrame:
    """Positives and negatives stacked with their label ``p``, in a seeded hash order ``place``."""
    rest = [c for c in df.columns if c not in (x, x_wo)]
    a = df.select(*rest, F.col(x).alias(x), F.lit(True).alias("p"))
    b = df.select(*rest, F.col(x_wo).alias(x), F.lit(False).alias("p"))
    d = a.unionByName(b).withColumn("_h", seeded(seed, *keys, "p"))
    return scan(d, [], ["_h", *keys, "p"], place=("index", F.lit(1))).drop("_h")


def random_sides(df: DataFrame, keys: list[str], x: str, x_wo: str, seed: int = 42) -> DataFrame:
    """Each positive on a random side ``g`` of a pair, a shuffled negative on the other."""
    d = scan(df.withColumn("_h", seeded(seed, *keys)), [], ["_h", *keys], _k=("index", F.lit(1)))
    pos = indexed(df, [], keys, "_k").select(*keys, F.col(x).alias("_pos"), "_k")
    d = pos.join(d.select("_k", F.col(x_wo).alias("_neg")), "_k")
    g = (seeded_number(seed + 1, *keys) % 2).cast("int")
    left = F.when(g == 0, F.col("_pos")).otherwise(F.col("_neg"))
    right = F.when(g == 0, F.col("_neg")).otherwise(F.col("_pos"))
    return d.select(*keys, g.alias("g"), left.alias("x_left"), right.alias("x_right"))


def seeds_per_key(df: DataFrame, keys: list[str], core: int, n: int) -> DataFrame:
    """One reproducible seed per key and sample."""
    d = df.select(*keys).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("seed", seeded_number(core, *keys, "sample") % 2**31)


def distance_weights(d: Column, p: float = 2.0) -> Column:
    """(1 - d) ** p; a missing distance counts as 1."""
    return F.pow(1 - F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(1.0)), F.lit(p))


# Hidden layer sizes of the perceptrons.
LAYERS = {
    "tiniest_mlp": [4, 4, 4, 4],
    "tiny_mlp": [32, 16],
    "small_mlp": [64, 64, 32, 32],
    "medium_mlp": [256, 256, 128, 128],
    "large_mlp": [512, 512, 256, 256],
}


def _vec(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(x).cast("array<double>")))


def train_presence(df: DataFrame, x: str, p: str, kind: str, seed: int = 42, max_iter: int = 100) -> Model:
    """Model that adds ``p_pred``: baseline, linear (logistic), ridge (targets -1/+1) or a perceptron."""
    d = _vec(df, x).withColumn("_p", F.col(p).cast("double"))
    if kind == "baseline":
        share = d.agg(F.avg("_p")).first()[0]
        return lambda t: t.withColumn("p_pred", F.lit(float(share)))
    if kind == "ridge":
        fit = LinearRegression(featuresCol="_v", labelCol="_s", regParam=1.0, elasticNetParam=0.0, predictionCol="_o").fit(d.withColumn("_s", 2 * F.col("_p") - 1))
        return lambda t: fit.transform(_vec(t, x)).withColumn("p_pred", (F.col("_o") > 0).cast("double")).drop("_v", "_o")
    cols = {"featuresCol": "_v", "labelCol": "_p", "predictionCol": "_o", "probabilityCol": "_q", "rawPredictionCol": "_r"}
    if kind == "linear":
        fit = LogisticRegression(**cols, maxIter=max_iter).fit(d)
    else:
        n = len(d.select(F.col(x)).first()[0])
        fit = MultilayerPerceptronClassifier(**cols, layers=[n, *LAYERS[kind], 2], seed=seed, maxIter=max_iter).fit(d)
    return lambda t: fit.transform(_vec(t, x)).withColumn("p_pred", vector_to_array("_q")[1]).drop("_v", "_o", "_q", "_r")


def _grams(d: DataFrame, x: str, targets: list[str], folds: int) -> np.ndarray:
    """Sums of products of ``(features, 1, targets)`` per fold, from one pass; as many numbers as the models have, squared."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for f, part in pdf.groupby("_f"):
                a = np.column_stack([np.stack(part[x].to_numpy()), np.ones(len(part)), part[targets].to_numpy(float)])
                held[f] = held[f] + a.T @ a if f in held else a.T @ a
        yield pd.DataFrame([[f, g.ravel()] for f, g in held.items()], columns=["f", "g"])

    ok = d.dropna(subset=[x, *targets]).select(F.col(x).cast("array<double>").alias(x), *[F.col(t).cast("double").alias(t) for t in targets], F.col("_f").cast("int").alias("_f"))
    g = ok.mapInPandas(sums, "f int, g array<double>").select("f", F.posexplode("g").alias("p", "v")).groupBy("f", "p").agg(F.sum("v").alias("v"))
    rows = g.orderBy("f", "p").collect()
    m = math.isqrt(max((r["p"] for r in rows), default=-1) + 1)
    out = np.zeros((folds, m * m))
    for r in rows:
        out[r["f"], r["p"]] = r["v"]
    return out.reshape(folds, m, m)


def ridge(gram: np.ndarray, target: int, width: int, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for one target: half the mean squared error plus ``alpha`` / 2 times the squares of
    the weights of features scaled to unit spread (the shortest weights if there are several)."""
    n = gram[width, width]
    mean, my = gram[:width, width] / n, gram[width, width + 1 + target] / n
    cov = gram[:width, :width] / n - np.outer(mean, mean)
    w = np.linalg.lstsq(cov + alpha * np.diag(np.diag(cov)), gram[:width, width + 1 + target] / n - mean * my, rcond=1e-12)[0]
    return w, float(my - mean @ w)


def train_position(df: DataFrame, x: str, targets: list[str], kind: str, alphas: tuple = (1e-4, 1e-2, 1.0), folds: int = 3, seed: int = 42) -> Model:
    """Model that adds ``<target>_pred``: baseline mean, linear, ridge (penalty by folds) or boosted trees.

    The linear kinds need sums of products only: all targets, penalties and folds come from one pass. Rows without
    features or a target are not trained on; without any, predictions are null.
    """
    if kind not in ("baseline", "linear", "ridge", "boosted"):
        raise ValueError(kind)
    if kind == "boosted":
        d = durable(_vec(df, x))
        fits = [GBTRegressor(featuresCol="_v", labelCol=t, predictionCol=f"{t}_pred", maxIter=10, seed=seed).fit(d) for t in targets]

        def grown(data: DataFrame) -> DataFrame:
            out = _vec(data, x)
            for m in fits:
                out = m.transform(out)
            return out.drop("_v")

        return grown
    grams = _grams(df.withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), x), F.lit(folds))), x, targets, folds)
    whole, width = grams.sum(axis=0), grams.shape[1] - len(targets) - 1
    models: list = []
    for k in range(len(targets)):
        if width < 0 or whole[width, width] == 0:
            models.append(None)
        elif kind == "baseline":
            models.append((np.zeros(width), float(whole[width, width + 1 + k] / whole[width, width])))
        else:
            best = 0.0
            if kind == "ridge":
                error = {a: [] for a in alphas}
                for held in grams:
                    rest = whole - held
                    if held[width, width] and rest[width, width]:
                        for a in alphas:
                            w, b = ridge(rest, k, width, a)
                            v = np.concatenate([-w, [-b], np.eye(len(targets))[k]])
                            error[a].append(v @ held @ v / held[width, width])
                best = min(alphas, key=lambda a: np.mean(error[a]) if error[a] else 0.0)
            models.append(ridge(whole, k, width, best))

    def apply(data: DataFrame) -> DataFrame:
        for t, m in zip(targets, models):
            pred = F.lit(None).cast("double")
            if m is not None:
                weights = F.array(*[F.lit(float(v)) for v in m[0]]).cast("array<double>")
                products = F.zip_with(F.col(x).cast("array<double>"), weights, lambda p, q: p * q)
                pred = F.aggregate(products, F.lit(m[1]), lambda s, v: s + v)
            data = data.withColumn(f"{t}_pred", pred)
        return data

    return apply


def ensemble(train: Callable[[int], Model], n: int, col: str, seed: int = 42) -> Model:
    """Mean prediction of n models trained with different seeds."""
    models = [train(seed + i) for i in range(n)]

    def apply(data: DataFrame) -> DataFrame:
        out = data
        for i, m in enumerate(models):
            out = m(out).withColumnRenamed(col, f"_e{i}")
        mean = sum((F.col(f"_e{i}") for i in range(n)), F.lit(0.0)) / n
        return out.withColumn(col, mean).drop(*[f"_e{i}" for i in range(n)])

    return apply


def prediction_table(model: Model, data: DataFrame, decoder_id: str, keep: list[str]) -> DataFrame:
    """Rows of all splits with key, targets, distance, presence and prediction."""
    return model(data).select(F.lit(decoder_id).alias("decoder_id"), *keep, "p_pred")


def accuracy_table(pred: DataFrame, norms: DataFrame, keys: list[str], name: str, min_border: float) -> DataFrame:
    """Targets in micrometres, distance to centre and border, accuracy and condition columns; far from the border.

    The distance to the centre is the root of the mean (not summed) square of both coordinates.
    Norms carry ``y_scale_x``, ``y_scale_y``, ``pixel_size_um``, ``d_min`` and ``d_max``.
    """
    d = pred.join(norms, keys)
    hx, hy = F.col("y_scale_x") * 0.5 * F.col("pixel_size_um"), F.col("y_scale_y") * 0.5 * F.col("pixel_size_um")
    x, y = F.col("tx") * hx, F.col("ty") * hy
    file = F.col(name)
    d = d.select(
        *pred.columns, (F.col("d") * (F.col("d_max") - F.col("d_min")) + F.col("d_min")).alias("distance"), F.sqrt((x * x + y * y) / 2).alias("distance_center"),
        F.least(hx - F.abs(x), hy - F.abs(y)).alias("distance_border"), ((F.col("p") >= 0.5) == (F.col("p_pred") >= 0.5)).alias("accuracy"),
        F.get(F.split(F.get(F.split(F.get(F.split(file, "bcns"), 1), r"\."), 0), "_"), 0).alias("bc_noise"), file.contains("prnoise").cast("int").alias("pr_noise"),
        F.get(F.split(F.get(F.split(file, "w_and_wo_"), 1), "_bcns"), 0).alias("rgc"),
    )
    return d.filter(F.col("distance_border") >= min_border)


def _basis(x: Column, knots: list[float]) -> list[Column]:
    """Cubic truncated power basis."""
    return [F.lit(1.0), x, x * x, x * x * x, *[F.pow(F.greatest(x - k, F.lit(0.0)), 3) for k in knots]]


def smooth_group_curves(df: DataFrame, y: str, x: str, group: str, n_knots: int = 2, n_grid: int = 21) -> DataFrame:
    """Smooth curve of y over x per group with standard errors ``(group, x, fit, se)``.

    Least squares on a cubic basis over a grid on the common range of x, a curve for every group; it is null where
    the group has no x as small or as large, and everywhere if x does not vary. The sums of
    products are one aggregation, one small system per group is solved at the end.
    """
    d = df.dropna(subset=[x, y])
    lo, hi = d.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if lo is None or lo == hi:
        none = F.lit(None).cast("double")
        return d.select(group).distinct().select(group, F.lit(lo).cast("double").alias("x"), none.alias("fit"), none.alias("se"))
    u = (F.col(x) - lo) / (hi - lo)
    b = _basis(u, [(i + 1) / (n_knots + 1) for i in range(n_knots)])
    m = len(b)
    d = d.withColumns({f"_b{i}": c for i, c in enumerate(b)})
    g = d.groupBy(group).agg(
        F.array(*[F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i in range(m) for j in range(m)]).alias("_a"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col(y)) for i in range(m)]).alias("_r"), F.sum(F.col(y) * F.col(y)).alias("_yy"), F.count("*").alias("_n"),
        F.min(x).cast("double").alias("_from"), F.max(x).cast("double").alias("_to"),
    )
    grid = np.linspace(0, 1, n_grid)
    gb = np.column_stack([grid**0, grid, grid**2, grid**3, *[np.maximum(grid - (i + 1) / (n_knots + 1), 0) ** 3 for i in range(n_knots)]])

    @F.pandas_udf("array<struct<x:double,fit:double,se:double>>")
    def curve(a: pd.Series, r: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for ai, ri, yi, ni in zip(a, r, yy, n):
            inv = np.linalg.pinv(np.reshape(ai, (m, m)))
            beta = inv @ np.asarray(ri)
            s2 = max(yi - beta @ np.asarray(ri), 0.0) / max(ni - m, 1)
            se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", gb, inv, gb) * s2, 0))
            out.append([{"x": lo + (hi - lo) * t, "fit": f, "se": e} for t, f, e in zip(grid, gb @ beta, se)])
        return pd.Series(out)

    c = g.select(group, "_from", "_to", F.explode(curve("_a", "_r", "_yy", "_n")).alias("_c"))
    slack = 1e-9 * (hi - lo)
    inside = F.col("_c.x").between(F.col("_from") - slack, F.col("_to") + slack)
    return c.select(group, "_c.x", *[F.when(inside, F.col(f"_c.{v}")).alias(v) for v in ("fit", "se")])


def curve_difference(curves: DataFrame, group: str, a, b, z: float = 1.96) -> DataFrame:
    """Difference of two groups' curves with its confidence half width ``(x, est, ci)``."""
    l = curves.filter(F.col(group) == a).select("x", F.col("fit").alias("_f"), F.col("se").alias("_s"))
    d = curves.filter(F.col(group) == b).join(l, "x")
    return d.select("x", (F.col("_f") - F.col("fit")).alias("est"), (z * F.sqrt(F.col("_s") * F.col("_s") + F.col("se") * F.col("se"))).alias("ci"))


def curve_aic(df: DataFrame, y: str, x: str, group: str, groups: list, family: str = "gaussian", n_knots: int = 2) -> float | None:
    """Akaike criterion of the model with one curve per group (gaussian or binomial); none if x does not vary."""
    df = df.dropna(subset=[x, y])
    lo, hi = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if lo is None or lo == hi:
        return None
    b = _basis((F.col(x) - lo) / (hi - lo), [(i + 1) / (n_knots + 1) for i in range(n_knots)])
    cols = [c * (F.col(group) == F.lit(g)).cast("double") for g in groups for c in b]
    d = df.withColumn("_v", array_to_vector(F.array(*cols))).withColumn("_y", F.col(y).cast("double"))
    return GeneralizedLinearRegression(featuresCol="_v", labelCol="_y", family=family, fitIntercept=False, regParam=1e-6).fit(d).summary.aic


def build_dataset(points: DataFrame, keys: list[str], splits: DataFrame, zscore: list[str], minmax: list[str], shift: int = 0, mix: tuple[str, str] | None = None, seed: int = 42) -> DataFrame:
    """Norms, splits, shifted targets and, on request, mixed positives and negatives, in one table."""
    from .stats import dataset_norm

    d = dataset_norm(points, ["data_set_file"], zscore, minmax)
    if shift:
        d = shift_target(d, keys, shift, [f"{c}_norm" for c in minmax])
    d = d.join(splits, keys)
    return with_without_mix(d, [*keys, "frame"], mix[0], mix[1], seed) if mix else d
