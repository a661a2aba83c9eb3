import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tessera.llm.importance import counting_pass, feature_buckets, importance_table, numbered, radix_sorted, resample
from tessera.llm.queries import QUERIES
from pyspark.sql import functions as F

from .data import DOCS, SF, awkward, empty, prose


def features(text) -> tuple[int, list[int]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [crc32(r.encode()) % 10_000 for r in runs]


def brute(docs: list[tuple], target: list) -> list[tuple]:
    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_query_is_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    out = QUERIES["op12_importance_resample"](spark, SF)
    assert all(t == "bigint" for _, t in out.dtypes)
    assert got(out) == brute(pairs(docs), [r["text"] for r in items.collect()])


def test_awkward_rows_and_empty_tables(spark):
    target = spark.createDataFrame([(1, "the house"), (2, None), (None, "")], "item_id long, text string")
    assert got(importance_table(awkward(spark), target)) == brute(pairs(awkward(spark)), ["the house"])
    assert got(importance_table(awkward(spark), target.limit(0))) == brute(pairs(awkward(spark)), [])
    assert importance_table(empty(spark), target).collect() == [] and resample(empty(spark), target).collect() == []
    kept = resample(awkward(spark), target)
    assert kept.columns == awkward(spark).columns and kept.count() >= 1


def test_small_blocks_give_the_same_ranks(spark):
    rng = random.Random(1)
    rows = [(i * 7 - 3000, prose(rng, rng.randint(15, 30))) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(5)
    target = spark.createDataFrame([(1, "the water of the house")], "item_id long, text string")
    assert got(importance_table(docs, target, block=16)) == brute(rows, ["the water of the house"])


def test_a_pass_is_stable_and_whole(spark):
    rows = numbered(spark.range(500, numPartitions=7).select(F.col("id"), (F.col("id") * 37 % 5).cast("int").alias("d")), "p")
    before = {r["id"]: r["p"] for r in rows.collect()}
    assert sorted(before.values()) == list(range(500))
    after = counting_pass(rows, F.col("d"), "p", 32).collect()
    assert [r["id"] for r in sorted(after, key=lambda r: r["p"])] == sorted(before, key=lambda i: (i * 37 % 5, before[i]))


@pytest.mark.parametrize("block", [64, 4096])
def test_radix_sort_of_extremes_ties_and_nulls(spark, block):
    rng = random.Random(2)
    values = [rng.choice([-(2**63), 2**63 - 1, 0, -1, 1, None, rng.randrange(-(2**40), 2**40)]) for _ in range(400)]
    rows = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "a long, b long").repartition(4)
    for down in (False, True):
        out = sorted(radix_sorted(rows, [("b", True), ("a", down)], "p", block).collect(), key=lambda r: r["p"])
        want = sorted(((v, i % 3) for i, v in enumerate(values)), key=lambda r: (-r[1], r[0] is None, (-1 if down else 1) * (r[0] or 0)))
        assert [r["p"] for r in out] == list(range(400)) and [(r["a"], r["b"]) for r in out] == want


def test_long_text_counts_whole():
    n, at = feature_buckets("Ab1 ü-" * 50_000)
    assert n == 100_000 and len(at) == 199_999 and at.tolist() == features("Ab1 ü-" * 50_000)[1]
