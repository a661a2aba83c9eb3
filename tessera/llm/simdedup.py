"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components
from ..session import durable
from .common import match, spare, text_of, without, written

SEGMENTS, WIDTH, RADIUS = 8, 8, 3
#: Differing bits that the first 1, 2, ... segments of a viable chain may have together.
BUDGETS = [RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Larger buckets are cut by a second set of keys.
BUCKET = 32_768


def shingle_hashes(words: list[bytes], width: int = 3) -> np.ndarray:
    """XXH64, seed 42, of every run of ``width`` words (all words if there are fewer), joined by spaces."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((h(line[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        raw = np.ascontiguousarray(hashes[i : i + 65_536]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    out = np.array([majority(shingle_hashes(t.encode().lower().split())) for t in texts], dtype=np.uint64)
    return pd.Series(out.view(np.int64))


def turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """64-bit rotation to the right by ``by`` bits."""
    by = by.astype(np.uint64)
    return (x >> by) | (x << ((np.uint64(64) - by) & np.uint64(63)))


def chain_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all fingerprints: start of the chain, three per start, and the 32 bits that must agree.

    Among fingerprints that differ in 3 bits of 8 ring segments, some start has a chain within the
    budgets 0, 0, 1, 1, 1, 2, 2, 3. So its first two segments agree, and at least two of the next
    three. Key: (start, the one of the three that may differ, the four segments that agree).
    """
    keys = []
    for start in range(SEGMENTS):
        ring = turned(values, np.full(len(values), start * WIDTH))
        part = [(ring >> np.uint64(WIDTH * i)) & np.uint64(255) for i in range(5)]
        for free in range(3):
            a, b = [part[2 + i] for i in range(3) if i != free]
            keys.append(np.uint64(start * 3 + free) << np.uint64(32) | part[0] << np.uint64(24) | part[1] << np.uint64(16) | a << np.uint64(8) | b)
    return np.concatenate(keys), np.tile(values, len(keys))


def viable(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Chain check of differences ``x`` from the start that ``key`` names: every prefix keeps its budget."""
    alive = np.arange(len(x))
    ring = turned(x, (key >> np.uint64(32)) // np.uint64(3) * np.uint64(WIDTH))
    for n, budget in enumerate(BUDGETS, 1):
        mask = np.uint64((1 << (WIDTH * n)) - 1)
        alive = alive[np.bitwise_count(ring[alive] & mask) <= budget]
    return alive


def spanning_links(key: np.ndarray, sub: np.ndarray, value: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what is linked in the same bucket; rows are sorted by (key, sub).

    Row t is compared with row t+1, t+2, ... while the bucket lasts, whole arrays at a time. Pairs
    that are already joined are passed over, so a bucket gives fewer links than it has rows.
    """
    n, left, right = len(key), [], []
    group = np.arange(n)
    at = np.arange(n - 1) if n > 1 else np.zeros(0, dtype=np.int64)
    step = 1
    while len(at):
        at = at[(key[at] == key[at + step]) & (sub[at] == sub[at + step])]
        near = at[group[at] != group[at + step]]
        near = near[viable(value[near] ^ value[near + step], key[near])]
        if len(near):
            for t in near.tolist():
                a, b = t, t + step
                while group[a] != a:
                    a = group[a]
                while group[b] != b:
                    b = group[b]
                if a != b:
                    group[max(a, b)] = min(a, b)
                    left.append(t)
                    right.append(t + step)
            while (group[group] != group).any():
                group = group[group]
        step += 1
        at = at[at + step < n]
    return left, right


def bucket_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of sorted rows (k, sub, v); a bucket that spans two batches is put together first."""
    rest = None

    def found(p: pd.DataFrame) -> pd.DataFrame:
        v = p["v"].to_numpy().view(np.uint64)
        left, right = spanning_links(p["k"].to_numpy().view(np.uint64), p["sub"].to_numpy(), v)
        return pd.DataFrame({"a": v[left].view(np.int64), "b": v[right].view(np.int64)})

    for p in parts:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        last = (p["k"] == p["k"].iloc[-1]) & (p["sub"] == p["sub"].iloc[-1]) if len(p) else None
        if last is None or last.all():
            rest = p
            continue
        yield found(p[~last])
        rest = p[last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield found(rest)


def finer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second keys of rows in large buckets: which 13 of the 16 bit pairs that are still free agree.

    Of the 32 bits outside the key at most 3 differ, so 13 pairs agree for some choice; at most 64
    fingerprints share such a key.
    """
    choices = list(combinations(range(16), 3))
    for p in parts:
        key, v = p["k"].to_numpy().view(np.uint64), p["v"].to_numpy().view(np.uint64)
        ring = turned(v, (key >> np.uint64(32)) // np.uint64(3) * np.uint64(WIDTH))
        loose = ((ring >> (np.uint64(16) + (key >> np.uint64(32)) % np.uint64(3) * np.uint64(8))) & np.uint64(255)) << np.uint64(24) | ring >> np.uint64(40)
        for i, choice in enumerate(choices):
            mask = (1 << 32) - 1
            for c in choice:
                mask &= ~(3 << (2 * c))
            yield pd.DataFrame({"k": p["k"], "sub": (np.uint64(i + 1) << np.uint64(32) | loose & np.uint64(mask)).view(np.int64), "v": p["v"]})


def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        for i in range(0, len(p), 20_000):
            k, v = chain_keys(p["v"].to_numpy()[i : i + 20_000].view(np.uint64))
            yield pd.DataFrame({"k": k.view(np.int64), "sub": np.zeros(len(k), dtype=np.int64), "v": v.view(np.int64)})


def fingerprint_links(values: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all fingerprints ``v`` (distinct longs) within radius 3 of each other."""
    rows = values.select("v").mapInPandas(keyed, "k long, sub long, v long")
    large = durable(rows.groupBy("k").count().filter(F.col("count") > bucket).select("k"))
    if large.isEmpty():
        fine = rows
    else:
        cut = rows.join(large, "k", "left_semi").mapInPandas(finer, "k long, sub long, v long")
        fine = rows.join(large, "k", "left_anti").unionByName(cut)
    fine = fine.repartition("k", "sub").sortWithinPartitions("k", "sub", "v")
    return fine.mapInPandas(bucket_links, "a long, b long").distinct()


def grouped(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fingerprint ``v``, node ``root`` and ``component_id`` of every row."""
    rows = durable(docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), simhash64(text_of()).alias("v")))
    nodes = durable(rows.groupBy("v").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(nodes, bucket)
    roots = components(nodes.select("v"), links)
    roots = durable(roots.join(nodes, "v"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    member = roots.join(names, "root").select("v", "root", "component_id")
    return rows.join(member, "v")


def dedup_table(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node, so copies are never paired. Nodes within 3 bits are linked, and
    ``component_id`` is the smallest ``doc_id`` reachable. Null texts are empty and have fingerprint
    zero, like any text without words. Rows that repeat a ``doc_id`` are kept; a null ``doc_id`` is
    never the smallest unless a component has no other.
    """
    return grouped(docs, bucket).select("doc_id", F.lower(F.lpad(F.hex("v"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest ``doc_id``.

    Only lists of (doc_id, hash of the text) join the texts (see ``without``). If rows with several
    texts carry the doc_id that stays, the text with the smallest hash stays, once. A component
    whose documents have no id keeps one of them by the same rule.
    """
    table = durable(grouped(docs, bucket).select("doc_id", "text_hash", "root", "component_id"))
    named = table.filter("doc_id <=> component_id").select("doc_id", "text_hash", "root")
    several = named.groupBy("root").agg(F.min("text_hash").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    several = durable(match(named, several, ["root"]).select("doc_id", "text_hash", "keep"))
    mark, row = spare(docs, "text_hash", "_row")
    pair = ["doc_id", F.col("text_hash").alias(mark)]
    gone = table.filter("not (doc_id <=> component_id)").select(*pair).unionByName(several.filter("text_hash <> keep").select(*pair))
    again = written(several.filter("text_hash = keep").groupBy("doc_id", "text_hash").count().filter("count > 1").select(*pair))
    kept = without(docs.withColumn(mark, F.xxhash64(text_of())), gone, long=True)
    if again.isEmpty():
        return kept.drop(mark)
    once = match(kept, again, ["doc_id", mark], "left_anti")
    many = match(kept, again, ["doc_id", mark], "left_semi").withColumn(row, F.struct("*")).groupBy("doc_id", mark).agg(F.first(row).alias(row)).select(f"{row}.*")
    return once.unionByName(many).drop(mark)
