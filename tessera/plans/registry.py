"""User-defined tables: declared keys and inputs, a function over DataFrames, options with defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import antijoin


@dataclass(frozen=True)
class Table:
    """A derived table. ``key_source`` names the input that lists the keys to fill."""

    name: str
    keys: list[str]
    inputs: list[str]
    make: Callable[..., DataFrame]
    key_source: str | None = None
    options: dict = field(default_factory=dict)

    def with_options(self, name: str | None = None, **options) -> Table:
        """The same table with project-wide options replaced."""
        unknown = set(options) - set(self.options)
        if unknown:
            raise KeyError(f"unknown options {sorted(unknown)}")
        return Table(name or self.name, self.keys, self.inputs, self.make, self.key_source, {**self.options, **options})


class Registry:
    """Tables by name, base tables included; a derived one is computed from its inputs on request."""

    def __init__(self) -> None:
        self._tables: dict[str, Table] = {}
        self._base: dict[str, DataFrame] = {}
        self._done: dict[str, DataFrame] = {}

    def add_base(self, name: str, df: DataFrame) -> None:
        self._base[name] = df

    def register_table(self, name: str, keys: list[str], inputs: list[str], make: Callable[..., DataFrame], key_source: str | None = None, **options) -> Table:
        if name in self._tables or name in self._base:
            raise ValueError(f"{name} is already there")
        missing = [i for i in inputs if i not in self._tables and i not in self._base]
        if missing:
            raise KeyError(f"unknown inputs {missing}")
        t = Table(name, keys, inputs, make, key_source, options)
        self._tables[name] = t
        return t

    def add(self, table: Table) -> None:
        self._tables[table.name] = table

    def set_done(self, name: str, df: DataFrame) -> None:
        """Rows of a derived table that exist already."""
        self._done[name] = df

    def populate(self, name: str, **make_kwargs) -> DataFrame:
        """New rows: the function over the inputs, for keys of the source that are not done yet."""
        t = self._tables[name]
        data = {i: self.fetch(i) for i in t.inputs}
        if name in self._done:
            src = t.key_source or t.inputs[0]
            data[src] = antijoin(data[src], self._done[name], t.keys)
        return t.make(*[data[i] for i in t.inputs], **{**t.options, **make_kwargs})

    def fetch(self, name: str) -> DataFrame:
        if name in self._base:
            return self._base[name]
        new = self.populate(name)
        return self._done[name].unionByName(new) if name in self._done else new


def vector_aggregate(fn: Callable, vec: Column, whole: bool = False) -> Column:
    """A number for every array of a column, from a NumPy function, batch by batch.

    With ``whole`` the function gets all arrays of a batch that are equally long as one matrix and
    returns a vector, which is the way to write it if it can be; else it is called per array.
    """

    @F.pandas_udf("double")
    def agg(v: pd.Series) -> pd.Series:
        if not whole:
            return v.map(lambda a: None if a is None else float(fn(a))).astype("float64")
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        size = v.map(lambda a: -1 if a is None else len(a))
        for _, part in v[size >= 0].groupby(size):
            out[part.index] = np.asarray(fn(np.stack(part.to_numpy())), dtype=float)
        return out

    return agg(vec)


def scaled_with_border(df: DataFrame, keys: list[str], value: str, border: Column, cval: Callable[[Column], Column], norm: Callable[[Column], Column]) -> DataFrame:
    """Values over a scale, with a constant where ``border`` holds; constant and scale are aggregates handed in by the caller."""
    s = df.groupBy(*keys).agg(cval(F.col(value)).alias("_c"), norm(F.col(value)).alias("_n"))
    v = F.when(border, F.col("_c")).otherwise(F.col(value)) / F.nullif(F.col("_n"), F.lit(0.0))
    return df.join(s, keys).withColumn(value, v).select(*df.columns)


def apply_table_function(df: DataFrame, fn: Callable, schema: str, inputs: list[str], keep: list[str]) -> DataFrame:
    """Rows of a user's generator ``fn(*inputs)`` beside the ``keep`` columns of the row it was called on."""

    @F.udtf(returnType=schema)
    class Rows:
        def eval(self, *args):
            yield from fn(*args)

    names = [f"_in{i}" for i in range(len(keep) + len(inputs))]
    src = df.select(*[F.col(c).alias(n) for c, n in zip([*keep, *inputs], names)])
    out = src.lateralJoin(Rows(*[F.col(n).outer() for n in names[len(keep) :]]))
    made = [c for c in out.columns if c not in names]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *made)
