import random
import re

import numpy as np
import pytest

from tessera.llm import coordjoin
from tessera.llm.coordjoin import agreeing, cell_links, cell_pairs, drop_near_copies, link_table, match_threshold, overlaps, sieve, signatures
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, awkward, empty, prose


def shingles(text: str, width: int = 3) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows: list[tuple]) -> list[tuple]:
    """All pairs of different sets; smallest doc_id of each component."""
    sets = [shingles(t) for _, t in rows]
    nodes = sorted(set(s for s in sets if s), key=lambda s: (len(s), sorted(s)))
    name = list(range(len(nodes)))

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if 100 * len(a) < 85 * len(b):
                break
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                name[max(x, y)] = min(x, y)
    group = {s: top(i) for i, s in enumerate(nodes)}
    least: dict = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[group[s]] = min(least.get(group[s], i), i)
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(group[s]) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got(QUERIES["op11_coordinate_join"](spark, SF)) == brute([(d["doc_id"], d["text"]) for d in docs])


def test_awkward_rows_and_empty_table(spark):
    assert got(link_table(awkward(spark))) == brute([(d["doc_id"], d["text"]) for d in awkward(spark).collect()])
    assert link_table(empty(spark)).collect() == [] and drop_near_copies(empty(spark)).collect() == []
    kept = drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-5, 1, 3, 4, 5, 6, 7, 8, 9]


def families(rng: random.Random, groups: int, each: int, words: int, edits: int) -> list[tuple]:
    """Groups of texts that differ in up to ``edits`` words, so that similarities lie around the limit."""
    rows = []
    for _ in range(groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [coordjoin.BLOCK, 4])
def test_groups_around_the_limit(spark, block):
    """With blocks of 4 the buckets are compared in many cells; a shared passage makes them mixed."""
    rng = random.Random(block)
    rows = families(rng, 12, 14, 60, 4) + [(1000 + i, t + " same words at the end") for i, t in families(rng, 6, 10, 25, 2)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    assert got(link_table(docs, block=block)) == brute(rows)


def test_matches_are_binomial():
    assert match_threshold(64, 85) == 39
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(800):
        c, own = rng.integers(0, 2**63, 34, dtype=np.uint64), rng.integers(0, 2**63, 6, dtype=np.uint64)
        s = signatures([np.sort(np.concatenate([c, own[:3]])), np.sort(np.concatenate([c, own[3:]]))], 64)
        hits.append(int((s[0] == s[1]).sum()))
    assert abs(np.mean(hits) / 64 - 0.85) < 0.01 and abs(np.std(hits) - (64 * 0.85 * 0.15) ** 0.5) < 0.4 and min(hits) >= 39


def test_long_sets_cross_strips_and_skipping_loses_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3 * coordjoin.STRIP + 7, 2, coordjoin.STRIP, 9)]
    want = [(s[:, None] * coordjoin.multipliers(8)).min(axis=0).tolist() for s in sets]
    assert signatures(sets, 8).tolist() == want
    a, b = rng.integers(0, 3, (500, 64)), rng.integers(0, 3, (500, 64))
    assert agreeing(a, b, 22).tolist() == np.flatnonzero((a == b).sum(axis=1) >= 22).tolist()


def test_a_dense_cell_is_handed_on_and_a_sparse_one_gives_its_pairs():
    import pandas as pd

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.append(sets[0], np.uint64(5)))]
    marks = [(s >> np.uint64(8)).astype(np.uint8).tobytes() for s in signatures(sets, 64)]
    rows = pd.DataFrame({"posting": 7, "cell": "o-0-0", "node": range(100, 121), "root": range(21), "n": [len(s) for s in sets], "marks": marks})
    out = cell_pairs(39, 85)(rows)
    assert out[["a", "b"]].to_numpy().tolist() == [[100, 120]] and out["posting"].isna().all()
    out = cell_pairs(39, 85, 0)(rows)
    assert out["a"].tolist() == list(range(100, 121)) and out["b"].isna().all() and set(out["posting"]) == {7}


def test_overlaps_and_sieve(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (1, 50, 200, 120, 3)]
    for width in (8192, 7):
        got = overlaps(sets, width).astype(int)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) as h")
    for words in (1, 64, 1 << 18):
        kept = {r["id"] for r in sieve(rows, "h", rows.filter("id % 50 = 0"), words).collect()}
        assert set(range(0, 2000, 50)) <= kept and (words < 1 << 18 or len(kept) < 50)


def test_cell_links_give_fewer_links_than_nodes():
    import pandas as pd

    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(7919)
    sets = [np.unique(np.concatenate([base[2:], np.array([10**9 + i], dtype=np.uint64)])) for i in range(50)]
    marks = [(s >> np.uint64(8)).astype(np.uint8).tobytes() for s in signatures(sets, 64)]
    rows = pd.DataFrame({"node": range(50), "root": range(50), "n": [len(s) for s in sets], "marks": marks, "hashes": [s.tobytes() for s in sets]})
    assert len(cell_links(39, 85)(rows)) == 49
