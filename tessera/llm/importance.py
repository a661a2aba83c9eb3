"""Importance resampling towards a target corpus; drawn by a distributed radix sort."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import match, spare, text_of, written

BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: A word is a run of digits, letters and anything beyond ASCII; A-Z are lower case by then.
FIND = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Rows of a block, and bits of a digit, in the radix sort.
BLOCK, BITS = 4096, 8


def feature_buckets(text: str, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``width`` words.

    The checksum of a run continues that of the run one word shorter.
    """
    words = FIND(text.encode().lower())
    spaced = [b" " + w for w in words]
    sums = list(map(crc32, words))
    every = list(sums)
    for k in range(1, width):
        sums = list(map(crc32, spaced[k:], sums))
        every += sums
    return len(words), np.array(every, dtype=np.int64) % buckets


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; every task sends one count a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                held += np.bincount(feature_buckets(text.as_py(), width, buckets)[1], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    rows = texts.select(text_of().alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths by which a feature of each bucket speaks for the target, smoothed by one a bucket."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(text: Column, gains: np.ndarray, width: int = WIDTH) -> Column:
    """Words, features and weight (floored mean gain) of a text, from the array of gains."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n, at = feature_buckets(text, width, len(gains))
            rows.append((n, len(at), int(gains[at].sum()) // len(at) if len(at) else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    return of(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, floored: from the first 32 bits of a SHA-256."""
    raw = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")
    h = F.conv(F.substring(F.sha2(raw, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, position: str) -> DataFrame:
    """Rows with positions from 0 in the order in which they were written: the input of the first pass."""
    rows = durable(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = match(rows, parts.select("_part", "_first", "_start"), ["_part"])
    return out.withColumn(position, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def counting_pass(rows: DataFrame, digit: Column, position: str, block: int = BLOCK) -> DataFrame:
    """One stable counting sort: rows of equal ``digit`` keep their order of ``position``.

    Every block of positions counts its digits. A row's destination is the number of rows of smaller
    digits, plus those of its digit in earlier blocks, plus those before it in its own block. No
    task sees more than one block and one table row per block and digit.
    """
    cut = rows.withColumn("_digit", digit).withColumn("_block", F.floor(F.col(position) / block))
    counts = cut.groupBy("_block", "_digit").agg(F.count("*").alias("_n"))
    lower = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select("_digit", F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(base, "_digit")
    starts = counts.select("_block", "_digit", (F.col("_base") + F.col("_before")).alias("_start"))
    inside = Window.partitionBy("_block", "_digit").orderBy(position)
    cut = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    out = cut.join(starts, ["_block", "_digit"]).withColumn(position, F.col("_start") + F.col("_inside"))
    return durable(out.drop("_block", "_digit", "_start", "_inside"))


def digits(column: str, low: int | None, high: int | None, descending: bool = False, bits: int = BITS) -> list[Column]:
    """Digits of a long column, least significant first, as many as tell ``low`` from ``high``.

    The sign bit is turned over, so that unsigned digits have the order of the signed numbers.
    """
    if low is None or low == high:
        return []
    unsigned = F.col(column).bitwiseXOR(F.lit(-(2**63)))
    last = (1 << bits) - 1
    out = []
    for at in range(0, (low ^ high).bit_length() if (low < 0) == (high < 0) else 64, bits):
        d = F.shiftrightunsigned(unsigned, at).bitwiseAND(F.lit(last))
        out.append(F.coalesce(F.lit(last) - d if descending else d, F.lit(0)).cast("int"))
    return out


def radix_sorted(rows: DataFrame, order: list[tuple[str, bool]], position: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with their ``position`` (from 0) by ``order``: long columns, True for descending; nulls last.

    A least-significant-digit radix sort. Rows that tie in all columns follow each other in any order.
    """
    rows = numbered(rows, position)
    ends = rows.agg(*[f(c).alias(f"{n}_{i}") for i, (c, _) in enumerate(order) for n, f in (("low", F.min), ("high", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"none_{i}") for i, (c, _) in enumerate(order)]).first()
    for i in reversed(range(len(order))):
        column, descending = order[i]
        for digit in digits(column, ends[f"low_{i}"], ends[f"high_{i}"], descending):
            rows = counting_pass(rows, digit, position, block)
        if ends[f"none_{i}"]:
            rows = counting_pass(rows, F.col(column).isNull().cast("int"), position, block)
    return rows


def importance_rows(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n_features, weight, score and rank of every row of ``docs`` (see :func:`importance_table`)."""
    gains = bucket_gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), weighed(text_of(), gains, width).alias("w"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows)
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = radix_sorted(able, [("score", True), ("doc_id", False)], "position", block)
    ranked = ranked.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("n_words")


def importance_table(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """Importance and rank of every document: doc_id, n_features, weight, score, rank, all long.

    ``docs`` and ``target`` (column ``text``) are counted whole into ``buckets`` of hashed runs of words;
    the array of gains, whose size is fixed, scores every text. Of the documents with
    ``least_words`` words the ``percent`` highest scores are drawn without replacement, ties to the smaller
    ``doc_id``; the others have a null rank. Null texts are empty, texts without words have weight 0,
    very long texts count whole. Rows that repeat a ``doc_id`` have its noise and are ranked each; a null
    ``doc_id`` hashes as the empty string and comes last in ties. Only ``doc_id`` and ``text`` are read, so other
    columns cannot clash. An empty target leaves the smoothing alone; empty ``docs`` give an empty result.
    """
    return importance_rows(docs, target, percent, least_words, seed, width, buckets, block).drop("text_hash")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The drawn documents, with the columns of ``docs``; rows that repeat id and text come or go together."""
    mark, = spare(docs, "text_hash")
    drawn = importance_rows(docs, target, percent, **options).filter("rank is not null")
    drawn = written(drawn.select("doc_id", F.col("text_hash").alias(mark)).distinct())
    return match(docs.withColumn(mark, F.xxhash64(text_of())), drawn, ["doc_id", mark], "left_semi").drop(mark)
