"""Relational algebra over keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(preds: Iterable[Column]) -> Column:
    return reduce(and_, preds, F.lit(True))


def _pred(p: dict | str | Column) -> Column:
    if isinstance(p, dict):
        return _all(F.col(c) == v for c, v in p.items())
    return F.expr(p) if isinstance(p, str) else p


def restrict(df: DataFrame, *preds: dict | str | Column) -> DataFrame:
    """Rows meeting every predicate: dicts of equal values, SQL text or columns."""
    return df.filter(_all(_pred(p) for p in preds))


def restrict_any(df: DataFrame, preds: list[dict | str | Column]) -> DataFrame:
    """Rows meeting at least one predicate of the list; an empty list keeps none."""
    return df.filter(reduce(or_, (_pred(p) for p in preds), F.lit(False)))


def restrict_not(df: DataFrame, col: str, values: list) -> DataFrame:
    """Rows whose value is not among the flagged ones."""
    return df.filter(~F.col(col).isin(values)) if values else df


def semijoin(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def antijoin(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def natural_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the key columns both tables have; other shared columns are an error."""
    shared = [c for c in a.columns if c in b.columns]
    extra = [c for c in shared if c not in keys]
    if extra or not shared:
        raise ValueError(f"rename or drop first: {extra}" if extra else "no shared key column")
    return a.join(b, shared)


def project_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys)


def project_rename(df: DataFrame, *keep: str, **new: str) -> DataFrame:
    """Kept columns plus renamed ones, ``new=old``."""
    return df.select(*keep, *[F.col(o).alias(n) for n, o in new.items()])


def self_join_variants(df: DataFrame, col: str, a, b, on: list[str], values: list[str], names=("a", "b")) -> DataFrame:
    """Pair the rows of two variants of a key, e.g. local and global stimulus."""
    sides = [
        df.filter(F.col(col) == v).select(*on, *[F.col(x).alias(f"{x}_{n}") for x in values])
        for v, n in zip((a, b), names)
    ]
    return sides[0].join(sides[1], on)


def pair_two_inputs(pairs: DataFrame, outputs: DataFrame, id_col: str, ids: tuple[str, str], values: list[str]) -> DataFrame:
    """Join the outputs table once per id column of ``pairs``."""
    out = pairs
    for n, c in enumerate(ids, 1):
        side = outputs.select(F.col(id_col).alias(c), *[F.col(v).alias(f"{v}_{n}") for v in values])
        out = out.join(side, c)
    return out


def with_without_pairs(df: DataFrame, flag: str, on: list[str], value: str) -> DataFrame:
    """Rows with flag 1 and flag 0 of the same key side by side; both must exist."""
    one = df.groupBy(*on).agg(
        F.max(F.when(F.col(flag) == 1, F.col(value))).alias(f"{value}_with"),
        F.max(F.when(F.col(flag) == 0, F.col(value))).alias(f"{value}_without"),
    )
    return one.dropna(subset=[f"{value}_with", f"{value}_without"])


def cross_params(keys: DataFrame, params: list[dict]) -> DataFrame:
    """Every key with every parameter set of a literal list."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return keys.withColumn("_p", F.explode(sets)).select(*keys.columns, "_p.*")


def populate(source: DataFrame, done: DataFrame | None, keys: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for the keys of ``source`` which ``done`` does not hold yet."""
    return fn(source if done is None else antijoin(source, done, keys))


def insert_skip_duplicates(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Table plus the rows with unseen keys; of equal new keys the smallest row is taken."""
    order = order or [c for c in rows.columns if c not in keys]
    new = antijoin(rows, table, keys)
    rest = [c for c in rows.columns if c not in keys]
    if rest:
        by = F.struct(*order, *[c for c in rest if c not in order])
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*")
    else:
        new = new.dropDuplicates(keys)
    return table.unionByName(new.select(*table.columns))


def insert_conflicts(table: DataFrame, rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys whose stored columns differ from the offered ones."""
    new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    same = _all(F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in cols)
    return table.join(new, keys).filter(~same).select(*keys)


def insert_or_check(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert unseen keys; a known key with other values is an error."""
    cols = [c for c in table.columns if c not in keys]
    bad = insert_conflicts(table, rows, keys, cols).limit(1).collect()
    if bad:
        raise ValueError(f"stored parameters differ for {bad[0].asDict()}")
    return insert_skip_duplicates(table, rows, keys)


def update_rows(table: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Replace columns of existing keys; unknown keys in ``updates`` are ignored."""
    new = updates.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = table.join(new, keys, "left")
    pick = [F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns]
    return out.select(*pick)


def delete_cascade(tables: dict[str, DataFrame], links: dict[str, tuple[str, list[str]]], root: str, gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Delete keys from ``root`` and every row depending on them.

    ``links[child] = (parent, shared key columns)``, parents listed before their children.
    """
    out = {root: antijoin(tables[root], gone, keys)}
    removed = {root: semijoin(tables[root], gone, keys)}
    for child, (parent, on) in links.items():
        out[child] = antijoin(tables[child], removed[parent], on)
        removed[child] = semijoin(tables[child], removed[parent], on)
    return out


def check_foreign_keys(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child keys without a parent row, with the number of rows behind each."""
    return antijoin(child, parent, keys).groupBy(*keys).agg(F.count("*").alias("n_rows"))


def union_all(dfs: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames and note where each row came from."""
    return reduce(DataFrame.unionByName, (d.withColumn(tag, F.lit(n)) for n, d in dfs.items()))


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def assert_disjoint_cover(parts: dict[str, DataFrame], whole: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts: keys in several parts, in no part, and foreign to the whole table."""
    tagged = union_all({n: p.select(*keys).distinct() for n, p in parts.items()}, "_part")
    hits = tagged.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = hits.join(whole.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "full")
    return both.agg(
        F.count_if(F.col("_n") > 1).alias("n_shared"),
        F.count_if(F.col("_n").isNull()).alias("n_missing"),
        F.count_if(F.col("_in").isNull()).alias("n_foreign"),
    )


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def left_align(a: DataFrame, b: DataFrame, keys: list[str], **exprs: Column) -> DataFrame:
    """Columns computed over key-aligned rows; a missing partner leaves null."""
    return a.join(b, keys, "left").withColumns(exprs)


def update_from(df: DataFrame, other: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Take columns from the matching row, else the default; drop rows where all stay at null."""
    cols = list(defaults)
    out = df.drop(*cols).join(other.select(*keys, *cols), keys, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})
    return out.filter(reduce(or_, (F.col(c).isNotNull() for c in cols)))


def mark_membership(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Boolean column: the key has a partner in ``other``."""
    seen = other.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(seen, keys, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def merge_conflicts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose shared attributes disagree."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    return insert_conflicts(a, b, keys, shared)


def merge_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of two attribute tables; disagreeing attributes are an error."""
    if merge_conflicts(a, b, keys).limit(1).collect():
        raise ValueError("the tables disagree on a shared attribute")
    return merge_or_null(a, b, keys)


def merge_or_null(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The join behind :func:`merge_keys` without the check."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    r = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    out = a.join(r, keys, "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in shared}).drop(*[f"_b_{c}" for c in shared])


def alias_conflicts(df: DataFrame, key: str, alias: str, sep: str = "_") -> DataFrame:
    """Alias tokens used by more than one row, with the number of rows and the first of them.

    Counted per token, so a token shared by very many rows costs one group and no pairs.
    """
    tokens = df.select(key, F.explode(F.array_distinct(F.split(alias, sep))).alias("token"))
    used = tokens.groupBy("token").agg(F.count("*").alias("n_rows"), F.min(key).alias(f"first_{key}"))
    return used.filter("n_rows > 1")


def drop_constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop id columns that hold one value; a column with more values is an error."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    bad = [c for c in cols if row[f"lo_{c}"] != row[f"hi_{c}"]]
    if bad:
        raise ValueError(f"more than one value in {bad}")
    return df.drop(*cols)


def check_unique(df: DataFrame, keys: list[str], col: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per key: are all values equal (numbers: close to the first)?"""
    numeric = dict(df.dtypes)[col] not in ("string", "date", "timestamp", "timestamp_ntz", "boolean")
    lo, hi = F.min(col), F.max(col)
    same = (hi - lo) <= F.lit(atol) + F.lit(rtol) * F.abs(lo) if numeric else lo == hi
    return df.groupBy(*keys).agg(same.alias("is_unique"))
