import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simdedup
from tessera.llm.queries import QUERIES
from tessera.llm.simdedup import chain_keys, dedup_table, fingerprint_links, near_dedup, viable

from .data import DOCS, SF, awkward, empty, prose


def fingerprint(text: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[int]) -> dict[int, int]:
    """Brute force: all pairs of distinct fingerprints, smallest fingerprint as the name."""
    v = sorted(set(prints))
    name = {x: x for x in v}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(v):
        for b in v[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                a_, b_ = top(a), top(b)
                name[max(a_, b_)] = min(a_, b_)
    return {x: top(x) for x in v}


def check(docs, rows):
    prints = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    group = components([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    want = [(i, f"{f:016x}", least.get(group[f])) for i, f in prints]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=key) == sorted(want, key=key)


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(docs, QUERIES["op6_simhash_dedup"](spark, SF).collect())


def test_awkward_rows_and_empty_table(spark):
    check(awkward(spark).collect(), dedup_table(awkward(spark)).collect())
    assert dedup_table(empty(spark)).collect() == [] and near_dedup(empty(spark)).collect() == []


def near_prints(rng: random.Random, seeds: int, each: int) -> list[int]:
    out = []
    for _ in range(seeds):
        x = rng.getrandbits(64)
        for _ in range(each):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            out.append(y)
    return sorted(set(out))


def test_pigeonring_keys_lose_no_pair():
    rng = random.Random(3)
    for _ in range(4000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        keys, _ = chain_keys(np.array([a, b], dtype=np.uint64))
        keys = keys.reshape(-1, 2)
        same = keys[keys[:, 0] == keys[:, 1], 0]
        assert len(viable(np.full(len(same), a ^ b, dtype=np.uint64), same))


@pytest.mark.parametrize("bucket", [simdedup.BUCKET, 3])
def test_links_join_what_brute_force_joins(spark, bucket):
    """With buckets of 3 the second set of keys does the work."""
    values = near_prints(random.Random(4), 12, 40) if bucket == 3 else near_prints(random.Random(4), 40, 60)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in fingerprint_links(spark.createDataFrame(signed, "v long"), bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    name = {v: v for v in values}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        name[max(a, b)] = min(a, b)
    assert {v: top(v) for v in values} == components(values)


def test_one_document_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["component_id"] for r in dedup_table(docs).collect()}
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(first)


def test_repeated_and_nameless_rows(spark):
    docs = awkward(spark)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1 stands for its copies, 3 for all texts without words, the nameless one too.
    assert sorted(i for i in ids if i is not None) == [-5, 1, 3, 6, 7, 8, 9] and ids.count(None) == 1
    twice = spark.createDataFrame([(4, prose(random.Random(8), 50), "en", "a", 1)] * 3, DOCS)
    assert near_dedup(twice).count() == 1
    rng = random.Random(9)
    other = spark.createDataFrame([(4, prose(rng, 50), "en", "a", 1), (4, prose(rng, 50), "en", "a", 1)], DOCS)
    assert near_dedup(other).count() == 2
