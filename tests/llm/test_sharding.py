import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm.queries import QUERIES
from tessera.llm.sharding import assign_shards, jump, shard_table

from .data import SF, awkward, empty


def jump_one(key: int, shards: int) -> int:
    here, there = -1, 0
    while there < shards:
        here = there
        key = (key * 2862933555777941757 + 1) % 2**64
        there = int((here + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return here


def test_jump_is_the_published_walk():
    rng = random.Random(1)
    keys = [0, 1, 2**64 - 1] + [rng.getrandbits(64) for _ in range(500)]
    for n in (1, 2, 7, 16, 1000):
        assert jump(np.array(keys, dtype=np.uint64), n).tolist() == [jump_one(k, n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard_and_evenly():
    keys = np.array([random.Random(2).getrandbits(64) for _ in range(1)] + list(range(60_000)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = jump(keys, 16), jump(keys, 17)
    moved = a != b
    assert set(b[moved]) == {16} and 0.05 < moved.mean() < 0.068
    assert max(Counter(a.tolist()).values()) < 1.05 * len(keys) / 16


def check(docs, rows):
    assert len(rows) == docs.count()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in rows)


def test_query_and_awkward_rows(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op9_jump_shards"](spark, SF).collect())
    check(awkward(spark), shard_table(awkward(spark)).collect())
    assert shard_table(empty(spark)).collect() == []


def test_assignment_replaces_a_column_and_keeps_the_rest(spark):
    out = assign_shards(awkward(spark))
    assert out.columns == awkward(spark).columns and out.schema["shard"].dataType.simpleString() == "int"
    assert out.count() == awkward(spark).count()
