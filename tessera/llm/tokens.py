"""Corpus-wide token counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Distinct tokens a task holds before it passes its counts on.
HOLD = 1_000_000


def counter(pattern: str, lower: bool):
    """Task function: counts of all matches of ``pattern`` in column 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(pattern).findall, Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                held.update(find(t.lower() if lower else t))
                if len(held) > HOLD:
                    yield rows()
                    held.clear()
        yield rows()

    return count


def token_counts(docs: DataFrame, pattern: str, lower: bool = False) -> DataFrame:
    """Occurrences of every token over all texts: token, n. Tasks count before anything is shuffled.

    The table is written once, as its readers would else count the texts again.
    """
    rows = docs.select(text_of().alias("text")).mapInArrow(counter(pattern, lower), "token string, n long")
    return written(rows.groupBy("token").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, size: int, least: int = 1) -> list[tuple[str, int]]:
    """The ``size`` most frequent tokens that occur ``least`` times, ties by token: the fixed size of a model.

    Counts are grouped by powers of two first, so that only tokens from the power at which ``size`` is
    reached are sorted, and tasks without any of them send nothing.
    """
    power = F.floor(F.log2("n")).cast("int")
    seen, low = 0, 0
    for r in counts.filter(F.col("n") >= least).groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():
        seen, low = seen + r["count"], r["p"]
        if seen >= size:
            break
    rows = counts.filter((F.col("n") >= least) & (F.col("n") >= 2**low)).orderBy(F.desc("n"), "token").limit(size)
    return [(r["token"], r["n"]) for r in rows.collect()]
