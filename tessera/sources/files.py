"""File names as data: positional fields, groups, aliases, preferences, paths and identities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import antijoin


def _listed(uri: str, recursive: bool) -> list:
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^(\w+):/+", r"\1:///", uri) if uri.startswith("file:") else uri)
    return fs.get_file_info(pafs.FileSelector(path, recursive=recursive))


def list_files(spark: SparkSession, root: str, ending: str, ignore_hidden: bool = False) -> DataFrame:
    """Folders at or below ``root`` holding a file with the ending; only names are read.

    Spark's readers never see names that begin with a dot or an underscore, so the folders of the
    first level are listed here and everything below each of them in a task of its own.
    ``ignore_hidden`` passes over file names that begin with a dot.
    """

    def wanted(paths: list[str]) -> list[str]:
        names = [(p, p.rsplit("/", 1)) for p in paths]
        return sorted({n[0] for _, n in names if n[1].endswith(ending) and not (ignore_hidden and n[1].startswith("."))})

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for folder in pdf["folder"]:
                yield pd.DataFrame({"folder": wanted([f.path for f in _listed(folder, True) if f.is_file])}, dtype="string")

    top = _listed(root, False)
    here = wanted([f.path for f in top if f.is_file])
    folders = [f.path for f in top if not f.is_file]
    own = spark.createDataFrame([(f,) for f in here], "folder string")
    scheme = root.split(":", 1)[0] + "://" if re.match(r"^(?!file:)\w+:/", root) else ""
    rest = spark.createDataFrame([(f"{scheme}{f}",) for f in folders], "folder string").repartition(max(1, min(len(folders), 1000)))
    return own.unionByName(rest.mapInPandas(below, "folder string")).distinct()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parse_filename(path: Column, locs: dict[str, int], defaults: dict[str, str] | None = None) -> dict[str, Column]:
    """Fields by their position in the name split at ``_``; missing ones take a default or null."""
    parts = F.split(stem(path), "_")
    defaults = defaults or {}
    out = {}
    for n, i in locs.items():
        v = F.get(parts, i)
        out[n] = F.coalesce(v, F.lit(defaults[n])) if n in defaults else v
    return out


def files_by_field(files: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Number of files, first file and region per field; a field in two regions is an error."""
    g = files.filter(F.col("field").isNotNull()).groupBy(folder, *by).agg(
        F.count("*").alias("n_files"), F.min("file").alias("first_file"), F.min("region").alias("region"), F.count_distinct("region").alias("_r")
    )
    bad = F.raise_error(F.lit("one field in several regions")).cast("string")
    return g.withColumn("region", F.when(F.col("_r") > 1, bad).otherwise(F.col("region"))).drop("_r")


def drop_reference_files(files: DataFrame, aliases: list[str], unique_by: list[str] | None = None) -> DataFrame:
    """Remove fields named like an alias or an alias with a number; ``unique_by`` asks for one region per field."""
    hit = reduce(or_, (F.lower("field").rlike(f"^{re.escape(a)}[+-]?[0-9]*$") for a in aliases))
    out = files.filter(~F.coalesce(hit, F.lit(False)))
    if unique_by:
        n = out.groupBy(*unique_by).agg(F.count_distinct("region").alias("_r"))
        bad = F.raise_error(F.lit("the same field name in several regions")).cast("boolean")
        out = out.join(n, unique_by).filter(F.when(F.col("_r") > 1, bad).otherwise(True)).drop("_r")
    return out


def match_alias(name: Column, pattern: Column, loc: int | None = None, mode: str = "full") -> Column:
    """Does a token of the name equal (or contain) a token of the pattern? Case is ignored."""
    tokens = F.split(F.lower(stem(name)), "_")
    if loc is not None:
        tokens = F.array_compact(F.array(F.get(tokens, loc)))
    pats = F.split(F.lower(pattern), "_")
    if mode == "full":
        return F.arrays_overlap(tokens, pats)
    return F.exists(tokens, lambda t: F.exists(pats, lambda p: t.contains(p)))


def mask_penalty(file: Column, mask_alias: list[str], highres_alias: list[str], prefer_control: bool = True) -> Column:
    """Rank of a file as the source of a mask: position of its alias, none, high resolution last."""
    tokens = F.split(F.lower(stem(file)), "_")
    pen = F.lit(len(mask_alias))
    for i, a in enumerate(mask_alias):
        # The last alias found decides.
        pen = F.when(F.array_contains(tokens, a.lower()), i).otherwise(pen)
    high = [a.lower() for a in highres_alias if a]
    if high:
        pen = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(a) for a in high])), len(mask_alias) + 1).otherwise(pen)
    if prefer_control:
        low = F.lower(base_name(file))
        control = low.contains("_control") | low.contains("_ctrl") | low.contains("_c1")
        pen = pen + F.when(control, 0).otherwise(100)
    return pen


def preferred_file(files: DataFrame, by: list[str], file: str, mask_alias: list[str], highres_alias: list[str]) -> DataFrame:
    """Best file per group, the first name on ties."""
    d = files.withColumn("penalty", mask_penalty(F.col(file), mask_alias, highres_alias))
    best = F.min(F.struct("penalty", file)).alias("_b")
    return d.groupBy(*by).agg(best).select(*by, "_b.*")


def presentation_files(files: DataFrame, stimuli: DataFrame, stim_loc: int, cond_loc: int) -> DataFrame:
    """Files whose stimulus token is an alias of a stimulus, with their condition."""
    f = files.withColumns(parse_filename(F.col("file"), {"stim": stim_loc, "cond1": cond_loc}, {"stim": "nostim", "cond1": "control"}))
    f = f.withColumn("_a", F.lower("stim")).filter("stim != 'nostim' and stim != ''")
    s = stimuli.select("stim_name", F.explode(F.split("alias", "_")).alias("_a"))
    return f.join(s, "_a").drop("_a")


def to_pre_path(path: Column) -> Column:
    """Raw file path to the path of its preprocessed file; other folders or endings are an error."""
    raw = path.endswith(".smp") & path.rlike("/Raw/[^/]*$")
    pre = path.endswith(".h5") & path.rlike("/Pre/[^/]*$")
    made = F.regexp_replace(path, r"/Raw/([^/]*)\.smp$", "/Pre/SMP_$1.h5")
    bad = F.raise_error(F.concat(F.lit("unexpected path "), path)).cast("string")
    return F.when(pre, path).when(raw, made).otherwise(bad)


def to_mask_path(path: Column, folder: str, prefix: str = "") -> Column:
    """Path of the label file that belongs to a data file."""
    return F.concat(F.regexp_replace(path, "/[^/]*/[^/]*$", ""), F.lit(f"/{folder}/{prefix}"), F.regexp_replace(stem(path), f"^{prefix}", ""), F.lit("_ROIs.pkl"))


def matched_files(a: DataFrame, b: DataFrame, n: int = 4) -> DataFrame:
    """Files of two lists side by side by the last ``n`` characters of their name, and the side they are on."""
    ident = F.expr(f"right(regexp_replace(element_at(split(file, '/'), -1), '[.][^.]*$', ''), {n})")
    l = a.select(ident.alias("id"), F.col("file").alias("file_a"))
    r = b.select(ident.alias("id"), F.col("file").alias("file_b"))
    side = F.when(F.col("file_b").isNull(), "a_only").when(F.col("file_a").isNull(), "b_only").otherwise("both")
    return l.join(r, "id", "full").withColumn("side", side)


def content_hash(m: Column) -> Column:
    """Id of a parameter map that does not depend on the order of its entries."""
    entries = F.array_sort(F.map_entries(m))
    return F.md5(F.to_json(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].cast("string").alias("v")))))


def raw_dataset_checks(df: DataFrame, keys: list[str], stimulus: str, sample: str, same: list[str]) -> DataFrame:
    """Per data set: are the listed columns constant, and is every stimulus there with every sample?"""
    one = [(F.count_distinct(c) == 1).alias(f"one_{c}") for c in same]
    full = F.count_distinct(stimulus) * F.count_distinct(sample) == F.count("*")
    return df.groupBy(*keys).agg(F.count_distinct(stimulus).alias("n_stimuli"), F.count_distinct(sample).alias("n_samples"), full.alias("complete"), *one)


def export_datasets(df: DataFrame, by: list[str], path: str, existing: DataFrame | None = None) -> int:
    """Write one data set per combination, leaving out those that exist; returns how many were new."""
    d = df if existing is None else antijoin(df, existing, by)
    combos = d.select(*by).distinct().count()
    if combos:
        d.write.mode("append").partitionBy(*by).parquet(path)
    return combos
