"""Feature tables, decompositions and clusters."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..plans.components import components
from ..plans.scan import indexed, task_rows
from ..plans.stats import join_stats, nz, pearson
from ..session import durable, once, written
from .stats import pairwise_corr


def feature_table(rois: DataFrame, averages: DataFrame, keys: list[str], stims: list[str], rtol: float = 0.15) -> DataFrame:
    """Averages ``(keys, stim_name, j, v)`` of the ROIs that have every stimulus, equal lengths per stimulus.

    Vectors are cut to the shortest of their stimulus; lengths differing by more than ``rtol`` are an error.
    """
    a = averages.filter(F.col("stim_name").isin(stims)).join(rois.select(*keys), keys, "left_semi")
    size = a.groupBy(*keys, "stim_name").agg((F.max("j") + 1).alias("_n"))
    full = size.groupBy(*keys).agg(F.count("*").alias("_k")).filter(F.col("_k") == len(stims))
    size = size.join(full, keys, "left_semi")
    lim = size.groupBy("stim_name").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.avg("_n").alias("_av"))
    d = a.join(full.select(*keys), keys, "left_semi").join(lim, "stim_name")
    far = (F.col("_hi") - F.col("_lo")) / F.col("_av") > rtol
    ok = F.when(far, F.raise_error(F.lit("vector lengths differ too much")).cast("boolean")).otherwise(F.col("j") < F.col("_lo"))
    return d.filter(ok).select(*keys, "stim_name", "j", "v")


def to_vectors(long: DataFrame, keys: list[str], name: str = "vec") -> DataFrame:
    """Long rows ``(j, v)`` as one array per key, in order (vectors have the width of their schema)."""
    arr = F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"])
    return long.groupBy(*keys).agg(arr.alias(name))


def standardize_features(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Zero mean and unit population spread per position."""
    long = df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("j", "v"))
    long = join_stats(long, ["j"], _m=F.avg("v"), _s=F.stddev_pop("v"))
    return to_vectors(long.withColumn("v", F.coalesce((F.col("v") - F.col("_m")) / nz(F.col("_s")), F.lit(0.0))), keys, vec)


def _means(df: DataFrame, vec: str) -> np.ndarray:
    rows = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"))
    return np.array([r["m"] for r in rows.orderBy("j").collect()])


def pca_features(df: DataFrame, keys: list[str], vec: str, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores, reconstruction, components (columns, largest entry positive) and explained shares.

    Only the mean and the components, both as wide as one vector, come to the driver.
    """
    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    fit = PCA(k=n, inputCol="_v", outputCol="_s").fit(d)
    p = fit.pc.toArray()
    p = p * np.sign(p[np.argmax(np.abs(p), axis=0), np.arange(n)])
    mean = _means(df, vec)

    def dot(col: Column, w: np.ndarray) -> Column:
        lit = F.array(*[F.lit(float(x)) for x in w])
        return F.aggregate(F.zip_with(col, lit, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    centred = F.zip_with(F.col(vec).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    out = df.withColumn("_c", centred)
    out = out.withColumn("score", F.array(*[dot(F.col("_c"), p[:, i]) for i in range(n)]))
    rec = F.array(*[dot(F.col("score"), p[j]) + float(mean[j]) for j in range(len(mean))])
    return out.select(*keys, "score", rec.alias("reconstructed")), p, fit.explainedVariance.toArray()


def projection_variance(df: DataFrame, vec: str, p: list[list[float]]) -> DataFrame:
    """Variance explained by any component matrix ``p`` (positions x components), and in total.

    Scores are the least-squares ones, so components need not be orthogonal.
    """
    mat = np.asarray(p, dtype=float)
    gram = mat.T @ mat
    m = mat @ np.linalg.pinv(gram)
    x = F.col(vec).cast("array<double>")
    n, k = mat.shape
    scores = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in m[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for c in range(k)]
    d = df.select(x.alias("_x"), *[s.alias(f"_t{c}") for c, s in enumerate(scores)])
    cov = [(a, b) for a in range(k) for b in range(k)]
    s = d.agg(*[(F.covar_pop(f"_t{a}", f"_t{b}") * F.count("*")).alias(f"c{a}_{b}") for a, b in cov])
    explained = sum((F.col(f"c{a}_{b}") * float(gram[b, a]) for a, b in cov), F.lit(0.0))
    total = df.select(F.posexplode(x).alias("j", "v")).groupBy("j").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s").alias("total"))
    return s.select(explained.alias("explained")).crossJoin(F.broadcast(total))


def compute_features(long: DataFrame, keys: list[str], stims: dict[str, int], kind: str, pre: bool = False, post: bool = False) -> DataFrame:
    """Feature vector per key: per stimulus a decomposition (pca or none), stacked in order, numbered.

    ``stims`` maps a stimulus to its number of components.
    """
    out, long = None, durable(long)
    for s, n in stims.items():
        v = to_vectors(long.filter(F.col("stim_name") == s), keys)
        if pre:
            v = standardize_features(v, keys, "vec")
        if kind == "pca":
            v = pca_features(v, keys, "vec", n)[0].select(*keys, F.col("score").alias("vec"))
        elif kind != "none":
            raise ValueError(kind)
        if post:
            v = standardize_features(v, keys, "vec")
        v = v.withColumnRenamed("vec", f"_v_{s}")
        out = v if out is None else out.join(v, keys)
    out = out.select(*keys, F.flatten(F.array(*[f"_v_{s}" for s in stims])).alias("features"))
    return indexed(out, [], keys, "features_idx")


def _cluster_stats(rows: DataFrame, max_distance: float) -> DataFrame:
    """Size, summed squared distance to the mean, whether that is too large, and where to cut, per cluster.

    The first cut is the middle of the widest-spread position among those that vary.
    """
    m = Summarizer.metrics("count", "variance", "min", "max").summary(F.col("_v")).alias("_m")
    d = rows.groupBy("_path").agg(m).select("_path", F.col("_m.count").alias("_n"), *[vector_to_array(f"_m.{c}").alias(f"_{c}") for c in ("variance", "min", "max")])
    d = d.withColumn("_cost", F.aggregate("_variance", F.lit(0.0), lambda s, v: s + v) * (F.col("_n") - 1))
    far = F.sqrt(F.col("_cost") / F.col("_n")) > max_distance
    wide = F.transform("_variance", lambda v, j: F.struct(F.when(F.get("_max", j) > F.get("_min", j), v).alias("v"), (-j).alias("j")))
    d = d.withColumn("_w", F.array_max(F.filter(wide, lambda s: s["v"].isNotNull())))
    j = -F.col("_w.j")
    lo, hi = F.get("_min", j), F.get("_max", j)
    mid = lo + (hi - lo) / 2
    return d.select("_path", "_n", (F.col("_n") * F.size("_variance")).alias("_numbers"), "_cost", far.alias("missed"), (far & F.col("_w").isNotNull()).alias("_open"), j.alias("_j"), F.when(mid < hi, mid).otherwise(lo).alias("_cut"))


def _nearer(a: str, b: str) -> Column:
    """1 if ``_x`` is nearer to centre ``b`` than to ``a``, else 0."""
    both = F.zip_with(F.zip_with("_x", a, lambda x, c: x - c), F.zip_with("_x", b, lambda x, c: x - c), lambda p, q: p * p - q * q)
    return (F.aggregate(both, F.lit(0.0), lambda s, v: s + v) > 0).cast("int")


def _two_means(rows: DataFrame, open_: DataFrame, rounds: int) -> DataFrame:
    """Two centres ``a`` and ``b`` for every open cluster, by grouped Lloyd rounds over all of them at once."""
    inside = rows.join(open_.select("_path", "_j", "_cut"), "_path")

    def centres(sides: DataFrame) -> DataFrame:
        m = sides.groupBy("_path", "_side").agg(Summarizer.mean(F.col("_v")).alias("_c"))
        m = m.groupBy("_path").agg(F.max(F.when(F.col("_side") == 0, vector_to_array("_c"))).alias("a"), F.max(F.when(F.col("_side") == 1, vector_to_array("_c"))).alias("b"))
        return m.filter("a is not null and b is not null")

    pair = written(centres(inside.withColumn("_side", (F.get("_x", F.col("_j")) > F.col("_cut")).cast("int"))))
    for _ in range(rounds):
        new = centres(rows.join(pair, "_path").withColumn("_side", _nearer("a", "b"))).withColumnsRenamed({"a": "_a", "b": "_b"})
        # A pair that lost a side stays as it was.
        moved = F.coalesce((F.col("_a") != F.col("a")) | (F.col("_b") != F.col("b")), F.lit(False))
        pair = written(pair.join(new, "_path", "left").select("_path", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), moved.alias("_moved")))
        if pair.filter("_moved").isEmpty():
            break
        pair = pair.drop("_moved")
    return pair.select("_path", "a", "b")


# Numbers of a cluster up to which one task splits it to the end (at most four for a row that a task may sort).
SPLIT_NUMBERS = 8_000_000


def _split_up(x: np.ndarray, path: str, max_distance: float, rounds: int) -> tuple[list[str], np.ndarray]:
    """Paths of the final clusters below ``path`` and whether they are too wide, by the steps of the levels over all tasks."""
    paths, missed, todo = [path] * len(x), np.zeros(len(x), dtype=bool), [(np.arange(len(x)), path)]

    def second(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((v - a) ** 2 - (v - b) ** 2).sum(axis=1) > 0

    while todo:
        at, name = todo.pop()
        v = x[at]
        lo, hi = v.min(axis=0), v.max(axis=0)
        var, vary = ((v - v.mean(axis=0)) ** 2).sum(axis=0), hi > lo
        far = not math.sqrt(var.sum() / len(v)) <= max_distance
        if not far or not vary.any():
            missed[at] = far
            for i in at:
                paths[i] = name
            continue
        j = int(np.argmax(np.where(vary, var, -1.0)))
        mid = lo[j] + (hi[j] - lo[j]) / 2
        first = side = v[:, j] > (mid if mid < hi[j] else lo[j])
        a, b = v[~side].mean(axis=0), v[side].mean(axis=0)
        for _ in range(rounds):
            side = second(v, a, b)
            if side.all() or not side.any():
                break
            new = v[~side].mean(axis=0), v[side].mean(axis=0)
            if np.array_equal(new[0], a) and np.array_equal(new[1], b):
                break
            a, b = new
        side = second(v, a, b)
        if side.all() or not side.any():
            side = first
        todo += [(at[~side], name + "0"), (at[side], name + "1")]
    return paths, missed


def hierarchical_clusters(df: DataFrame, vec: str, most: int | None, max_distance: float, rounds: int = 8) -> DataFrame:
    """Divisive clusters: split until the root mean squared distance to the mean is small enough.

    Two-means splits in place of bottom-up linkage. A level splits all clusters that miss the distance at once and leaves
    the others; rows are rewritten once a level. Without ``most`` clusters of up to ``SPLIT_NUMBERS`` numbers need no more levels: each is
    split to the end in one task, so levels grow with the larger ones only. Returns the rows with ``cluster`` (numbered in the order of the
    splits) and ``missed``: whether their cluster is wider than ``max_distance``. ``most`` limits the number of clusters, the
    costliest are split first; without it none is missed. Rows without a vector are left out, as are null components' rows.
    """
    x = F.col(vec).cast("array<double>")
    ok = df.filter(F.col(vec).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = written(ok.select(*df.columns, x.alias("_x"), F.lit("").alias("_path")))
    vector = array_to_vector("_x")
    done, count = [], 1
    out_type = StructType([*df.schema.fields, StructField("_path", StringType()), StructField("missed", BooleanType())])
    whole = 0 if most is not None else min(SPLIT_NUMBERS, 4 * task_rows(df))

    def split_up(t: pa.Table) -> pa.Table:
        x = t["_x"].combine_chunks()
        paths, missed = _split_up(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), t["_path"][0].as_py(), max_distance, rounds)
        return t.select(df_columns).append_column("_path", pa.array(paths, pa.string())).append_column("missed", pa.array(missed))

    df_columns = df.columns
    while True:
        stats = written(_cluster_stats(rows.withColumn("_v", vector), max_distance))
        if whole:
            small = stats.filter(F.col("_numbers") <= whole)
            done.append(written(rows.join(small.select("_path"), "_path", "left_semi").groupBy("_path").applyInArrow(split_up, out_type)))
            stats = stats.filter(F.col("_numbers") > whole)
        open_ = stats.filter("_open")
        if most is not None:
            open_ = written(open_.orderBy(F.col("_cost").desc(), "_path").limit(max(0, most - count)))
        n = open_.count()
        rest = rows.join(stats.join(open_.select("_path"), "_path", "left_anti").select("_path", "missed"), "_path")
        done.append(written(rest.select(*df.columns, "_path", "missed")))
        if not n:
            break
        count += n
        rows = rows.join(open_.select("_path"), "_path", "left_semi")
        pair = _two_means(rows.withColumn("_v", vector), open_, rounds)
        side = F.concat("_path", _nearer("a", "b").cast("string"))
        rows = written(rows.join(pair, "_path").select(*df.columns, "_x", side.alias("_path")))
    out = reduce(DataFrame.unionByName, done)
    number = indexed(out.select("_path").distinct(), [], ["_path"], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return out.join(number, "_path").select(*df.columns, "cluster", "missed")


def correlation_distance(long: DataFrame, key: str, pos: str, value: str, block: int = 512) -> DataFrame:
    """1 minus the correlation of every two vectors ``(key, pos, value)`` over the same positions.

    The result is the matrix itself, so it is worked on in square blocks: every two blocks of
    ``block`` vectors meet in one task, as two small matrices. A constant vector has no correlation.
    """
    vecs = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, F.col(value).cast("double").alias("v")))).alias("_p"))
    vecs = once(indexed(vecs.select(key, F.col("_p.v").alias("_v")), [], [key], "_k").withColumn("_b", F.expr(f"_k div {block}")).drop("_k"))
    last = vecs.agg(F.max("_b")).first()[0] or 0
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    both = vecs.withColumn("_o", other).select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", key, "_v")
    kind = long.schema[key].dataType.simpleString()

    def distances(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for b in at:
            rows = pdf[pdf["_b"] == b].sort_values(key)
            m = np.stack(rows["_v"].to_numpy()).astype(float)
            m = m - m.mean(axis=1, keepdims=True)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            sides.append((rows[key].to_numpy(), np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)))
        (ka, a), (kb, b) = sides
        r = 1 - a @ b.T
        i, j = np.triu_indices(len(ka), 1) if at[0] == at[1] else np.indices(r.shape).reshape(2, -1)
        d = pd.Series(r[i, j]).astype(object)
        return pd.DataFrame({"a": ka[i], "b": kb[j], "distance": d.where(d.notna(), None)})

    return both.groupBy("_i", "_j").applyInPandas(distances, f"a {kind}, b {kind}, distance double")


def correlation_clusters(distances: DataFrame, ids: DataFrame, key: str, threshold: float) -> DataFrame:
    """Components of the graph of pairs below the threshold, named by their smallest member."""
    r = components(ids.select(F.col(key).alias("v")), distances.filter(F.col("distance") < threshold).select("a", "b"))
    return r.select(F.col("v").alias(key), F.col("root").alias("cluster"))


def md5_fold(keys: list[str], folds: int, seed: int = 1) -> Column:
    """Fold of a row: the first 8 hex digits of the MD5 of seed and keys, modulo ``folds``; any engine reproduces it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _log_joint(x: np.ndarray, fit: tuple) -> np.ndarray:
    """Log of weight times density, rows by components; a covariance that is flat is widened a little."""
    out = np.empty((len(x), len(fit[0])))
    for i, (w, m, c) in enumerate(zip(*fit)):
        try:
            half = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            half = np.linalg.cholesky(c + 1e-6 * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c)))
        z = np.linalg.solve(half, (x - m).T)
        out[:, i] = math.log(max(w, 1e-300)) - 0.5 * (len(c) * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(np.diag(half)).sum()
    return out


def _log_sum(p: np.ndarray) -> np.ndarray:
    top = p.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(p - top).sum(axis=1, keepdims=True)))[:, 0]


def responsibilities(vec: Column, weights: list[float], means: list[list[float]], covs: list[list[list[float]]]) -> Column:
    """Share of every component in a vector, as an array."""
    fit = (np.array(weights, dtype=float), np.array(means, dtype=float), np.array(covs, dtype=float))

    @F.pandas_udf("array<double>")
    def of(x: pd.Series) -> pd.Series:
        p = _log_joint(np.stack(x.to_numpy()).astype(float), fit) if len(x) else np.zeros((0, 1))
        return pd.Series(list(np.exp(p - _log_sum(p)[:, None])) if len(x) else [], dtype=object)

    return of(vec.cast("array<double>"))


def _gathered(d: DataFrame, fits: dict, update: bool) -> dict:
    """One pass over all rows for every (number of components, held-out fold) in ``fits``.

    With ``update`` the sufficient statistics of the rows that are not held out: rows, log-likelihood, weights, sums and sums of
    squares of every component; else rows and log-likelihood of the held-out ones (of all rows if the fold is -1).
    Tasks add up all their batches and send one array per fit; their size is that of the models.
    """
    def of(batches):
        held: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, fold = np.stack(pdf["_x"].to_numpy()).astype(float), pdf["_f"].to_numpy()
            for at, fit in fits.items():
                here = x if at[1] < 0 else x[(fold != at[1]) if update else (fold == at[1])]
                if not len(here):
                    continue
                p = _log_joint(here, fit)
                ll = _log_sum(p)
                parts = [[float(len(here)), ll.sum()]]
                if update:
                    r = np.exp(p - ll[:, None])
                    parts += [r.sum(axis=0), (r.T @ here).ravel(), np.einsum("nk,ni,nj->kij", r, here, here, optimize=True).ravel()]
                v = np.concatenate(parts)
                held[at] = held[at] + v if at in held else v
        yield pd.DataFrame([[*at, v] for at, v in held.items()], columns=["k", "f", "v"])

    rows = d.select("_x", "_f").mapInPandas(of, "k int, f int, v array<double>")
    rows = rows.select("k", "f", F.posexplode("v").alias("p", "v")).groupBy("k", "f", "p").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in rows.orderBy("k", "f", "p").collect():
        out.setdefault((r["k"], r["f"]), []).append(r["v"])
    return {at: np.array(v) for at, v in out.items()}


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread starting centres from some rows: each next one with probability by its squared distance."""
    at = [int(rng.integers(len(x)))]
    while len(at) < k:
        far = ((x[:, None] - x[at]) ** 2).sum(axis=2).min(axis=1)
        at.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
    return x[at]


def mixture_clusters(df: DataFrame, keys: list[str], vec: str, ks: list[int], criterion: str = "bic", folds: int = 1, seed: int = 1, steps: int = 60, tol: float = 1e-5, start_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Gaussian mixtures over several numbers of components, the best by held-out criterion.

    ``folds=1`` scores the training rows; otherwise each fold (:func:`md5_fold`) is held out in turn. All numbers of components,
    all folds and the fits to all rows go through expectation-maximisation together: a step is one pass over the rows,
    and only sufficient statistics, as many as the models have numbers, come to the driver. Fits start from the
    ``start_rows`` rows with the smallest MD5 and use all rows from then on; they end when the mean log-likelihood of a row gains less than ``tol``.
    Returns the rows with ``cluster`` and one row per number of components: score, best, and whether its fits ``converged``
    within ``steps``. An empty table has an empty result and null scores.
    """
    x = F.col(vec).cast("array<double>")
    d = written(df.filter(F.col(vec).isNotNull()).select(*keys, x.alias("_x"), md5_fold(keys, folds, seed).alias("_f")))
    order = F.md5(F.concat_ws(":", F.lit(f"start {seed}"), *[F.col(k).cast("string") for k in keys]))
    first = d.orderBy(order, *keys).limit(start_rows).select("_x", "_f").collect()
    schema = "k int, score double, best boolean, converged boolean"
    if not first:
        return d.select(*keys, F.lit(0).alias("cluster")), df.sparkSession.createDataFrame([(k, None, False, False) for k in ks], schema)
    some, fold = np.array([r["_x"] for r in first], dtype=float), np.array([r["_f"] for r in first])
    dim, fits, gain = some.shape[1], {}, {}
    for k in ks:
        for f in [-1, *(range(folds) if folds > 1 else [])]:
            here = some[fold != f] if (fold != f).any() else some
            spread = np.atleast_2d(np.cov(here.T, bias=True))
            # Every component starts as wide as its share of the whole volume.
            wide = spread / max(k, 1) ** (2 / dim) if k > 1 else spread
            fits[k, f] = (np.full(k, 1 / k), _seeds(here, k, np.random.default_rng([seed, k, f + 1])), np.tile(wide, (k, 1, 1)))
            gain[k, f] = None
    going = dict(fits)
    for _ in range(steps):
        if not going:
            break
        for at, v in _gathered(d, going, True).items():
            k = at[0]
            n, ll = v[0], v[1]
            w, s, q = v[2 : 2 + k], v[2 + k : 2 + k + k * dim].reshape(k, dim), v[2 + k + k * dim :].reshape(k, dim, dim)
            old = fits[at]
            mean = np.where((w > 1e-9)[:, None], s / np.maximum(w, 1e-300)[:, None], old[1])
            cov = np.where((w > 1e-9)[:, None, None], q / np.maximum(w, 1e-300)[:, None, None] - mean[:, :, None] * mean[:, None, :], old[2])
            fits[at] = (w / n, mean, cov)
            if gain[at] is not None and ll / n - gain[at] < tol:
                del going[at]
            else:
                going[at] = fits[at]
            gain[at] = ll / n
    scores = []
    held = _gathered(d, {at: fit for at, fit in fits.items() if (folds == 1) == (at[1] < 0)}, False)
    for k in ks:
        free = k - 1 + k * dim + k * dim * (dim + 1) // 2
        parts = [v for at, v in held.items() if at[0] == k]
        # Larger is better for all three.
        total = sum({"bic": 2 * ll - free * math.log(n), "aic": 2 * ll - 2 * free, "likelihood": ll / n}[criterion] for n, ll in parts) / len(parts)
        scores.append((k, float(total), not any(at[0] == k for at in going)))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    share = responsibilities(F.col("_x"), *[part.tolist() for part in fits[best, -1]])
    out = d.withColumn("_r", share).select(*keys, (F.array_position("_r", F.array_max("_r")) - 1).cast("int").alias("cluster"))
    return out, df.sparkSession.createDataFrame([(k, s, k == best, done) for k, s, done in scores], schema)


def drop_small_clusters(df: DataFrame, cluster: str, n: int) -> DataFrame:
    """Clusters with strictly more than n rows numbered from 1 in order, all others -1."""
    size = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    keep = size.filter(F.col("_n") > n).select(cluster, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(cluster)).alias("_c"))
    return df.join(keep, cluster, "left").withColumn(cluster, F.coalesce("_c", F.lit(-1))).drop("_c")


def order_clusters(assigned: DataFrame, traces: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Renumber clusters by the correlation of their mean trace with that of the largest one."""
    a = assigned.filter(F.col(cluster) != -1)
    mean = traces.join(a.select(*keys, cluster), keys).groupBy(cluster, "j").agg(F.avg("v").alias("m"))
    big = a.groupBy(cluster).agg(F.count("*").alias("_n")).agg(F.max_by(cluster, F.struct("_n", -F.col(cluster))).alias("_b"))
    ref = mean.crossJoin(F.broadcast(big)).filter(F.col(cluster) == F.col("_b")).select("j", F.col("m").alias("_r"))
    cc = mean.join(ref, "j").groupBy(cluster).agg(F.round(pearson("m", "_r"), 9).alias("_cc"))
    rank = cc.select(cluster, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_cc").desc(), cluster)).alias("_k"))
    return assigned.join(rank, cluster, "left").withColumn(cluster, F.coalesce("_k", F.lit(-1))).drop("_k")


def cluster_table(features: DataFrame, traces: DataFrame, keys: list[str], params: dict) -> DataFrame | None:
    """Cluster, drop small clusters, order the rest; unsupported combinations give nothing.

    ``params``: ``kind`` (mixture, hierarchical), ``decomposition`` (pca, none), ``min_count`` and the
    options of the method.
    """
    kind, dec = params["kind"], params["decomposition"]
    if (kind == "mixture") == (dec == "none"):
        return None
    if kind == "mixture":
        c = mixture_clusters(features, keys, "features", params["ks"], params.get("criterion", "bic"))[0]
    else:
        c = hierarchical_clusters(features, "features", params["most"], params["max_distance"]).select(*keys, "cluster")
    return order_clusters(drop_small_clusters(durable(c), "cluster", params["min_count"]), traces, keys, "cluster")


def cluster_mean(assigned: DataFrame, traces: DataFrame, keys: list[str], cluster: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """Mean and spread per cluster and position, optionally only for a time range of ``t``."""
    d = traces.join(assigned.select(*keys, cluster), keys)
    if clip is not None:
        d = d.filter((F.col("t") >= clip[0]) & (F.col("t") < clip[1]))
    return d.groupBy(cluster, "j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))
