"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import match, running, spare, text_of

#: Multiplier of the linear congruential generator in the published algorithm (fixed value).
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key. A key's jumps do not depend on ``shards``; only the last below it counts."""
    state = keys.astype(np.uint64)
    here = np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(going):
            state[going] = state[going] * MULTIPLIER + np.uint64(1)
            step = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
            there = ((here[going] + 1).astype(np.float64) * step).astype(np.int64)
            inside = there < shards
            going = going[inside]
            here[going] = there[inside]
    return here.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key; no ring table, no state, no shuffle."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf(T.IntegerType())
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return of(key)


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """``docs`` with column ``into``: the shard of column ``key`` alone.

    Rows are not moved. Growing from n to n+1 shards takes 1/(n+1) of the keys, all of them into the
    new shard. Equal keys share a shard; null keys are one key. A column named ``into`` is replaced.
    """
    return docs.withColumn(into, jump_shard(F.xxhash64(F.col(f"`{key}`")), shards))


def shard_slots(rows: DataFrame, shard: str, order: list[str], into: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps along ``order``; no task holds a whole shard.

    Ties are numbered in any order. An empty table stays empty.
    """
    one, before = spare(rows, "_one", "_before")
    cut, blocks = running(rows.withColumn(one, F.lit(1).cast("long")), [shard], order, one, before)
    blocks = blocks.select(shard, "_block", "_offset")
    out = match(cut, blocks, [shard, "_block"])
    return out.withColumn(into, F.col("_offset") + F.col(before)).drop("_block", "_offset", before, one)


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Size, checksum, shard, slot and the shard after one more is appended, for every document.

    Size: UTF-8 bytes of the text plus 1 (a null text has none). Only ``doc_id`` and ``text`` are
    read, so other columns cannot clash; repeated rows get slots of their own.
    """
    raw = F.encode(text_of(), "UTF-8")
    key = F.xxhash64("doc_id")
    rows = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), key.alias("_key"))
    rows = rows.withColumn("shard", jump_shard(F.col("_key"), shards)).withColumn("grown_shard", jump_shard(F.col("_key"), shards + 1))
    out = shard_slots(rows, "shard", ["_key", "doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
