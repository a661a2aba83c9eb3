import math
import random
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm.covertree import BLOCK, code_table, codes, compress, grow, lengths, settle, sums
from tessera.llm.queries import QUERIES

from .data import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], parts: int, entries: int, rounds: int = 2) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, b):
        return min(range(len(b)), key=lambda j: (sum((a - c) ** 2 for a, c in zip(x, b[j])), j))

    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for c in cut:
                own.setdefault(nearest(c[p], book[p]), []).append(c[p])
            book[p] = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if j in own else book[p][j] for j in range(len(book[p]))]
    out, label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        to = [nearest(c[p], book[p]) for p in range(parts)]
        error = sum(sum((a - b) ** 2 for a, b in zip(c[p], book[p][to[p]])) for p in range(parts))
        label[lab] = label.get(lab, 0) + error
        out.append([i, "".join(f"{t:02x}" for t in to), error, lab])
    digest = sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, label[lab], digest) for i, c, e, lab in out], key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def test_query_is_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(QUERIES["op13_vector_codes"](spark, SF)) == brute(rows, 16, 64)


@pytest.mark.parametrize("block", [BLOCK, 7])
def test_clusters_ties_and_bad_vectors(spark, block):
    rng = random.Random(block)
    rows: list = [(i, [float(np.float32(rng.gauss(rng.choice([-3, 0, 4]), 0.05))) for _ in range(8)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(200 + i, [0.5] * 8, 5) for i in range(40)] + [(3, rows[3][1], 1), (None, [0.25] * 8, 5), (None, [0.125] * 8, None)]
    bad = [(300, None, 1), (301, [float("nan")] + [0.0] * 7, 1), (302, [float("inf")] * 8, 1), (303, [None] + [0.0] * 7, None)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'x' as code", "'y' as whole", "1 as part").repartition(3)
    assert got(code_table(df, 4, 16, block=block)) == brute(rows, 4, 16)


def test_vectors_that_fit_no_codebook_keep_their_row(spark):
    rows = [(i, [i / 8.0] * 4, 1) for i in range(5)] + [(7, [1.0, 2.0], 1), (8, [], 2), (9, [1e30] * 4, 3)]
    out = {r["vec_id"]: r for r in code_table(spark.createDataFrame(rows, SCHEMA), 2, 3).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert all(out[i]["code"] is None and out[i]["error"] is None for i in (7, 8, 9))
    assert out[8]["label_error"] is None and out[0]["label_error"] == sum(out[i]["error"] for i in range(5))
    assert code_table(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["code"] for r in code_table(spark.createDataFrame([(1, [], 1), (2, [1.0], 1)], SCHEMA)).collect()] == [None, None]


def test_codes_decode_to_the_error(spark):
    rows = [(i, [math.sin(i * k) for k in range(1, 9)], 0) for i in range(100)]
    table, book = compress(spark.createDataFrame(rows, SCHEMA), 4, 8)
    for r in table.collect():
        back = np.concatenate([book[p][int(r["code"][2 * p : 2 * p + 2], 16)] for p in range(4)])
        whole = np.array([math.floor(256 * float(np.float32(x))) for x in rows[r["vec_id"]][1]])
        assert int(((whole - back) ** 2).sum()) == r["error"]


@pytest.mark.parametrize("spread", [3, 400])
def test_trees_cover_and_settle_exactly(spread):
    rng = np.random.default_rng(spread)
    points = np.concatenate([rng.integers(-spread, spread, (700, 3)) + rng.integers(-5, 6, 3) * 300 for _ in range(4)]).astype(np.int64)
    order, nodes = grow(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (nodes["low"][0], nodes["high"][0]) == (0, len(points))
    for n in nodes:
        d = np.sqrt(lengths(points[order[n["low"] : n["high"]]] - points[n["centre"]]))
        assert d.max() <= n["radius"] and order[n["low"]] == n["centre"]
        if n["children"]:
            kids = nodes[n["child"] : n["child"] + n["children"]]
            assert kids["low"][0] == n["low"] and kids["high"][-1] == n["high"] and (kids["low"][1:] == kids["high"][:-1]).all()
            assert (kids["radius"] <= n["radius"] / 2).all()
            apart = np.sqrt(lengths(points[kids["centre"]][:, None] - points[kids["centre"]]))
            assert (apart[~np.eye(len(kids), dtype=bool)] > n["radius"] / 2 * (1 - 1e-12)).all()
    entries = np.concatenate([points[:5], points[:2], rng.integers(-1500, 1500, (9, 3))])
    inside = points[order]
    want = lengths(inside[:, None] - entries).argmin(axis=1)
    assert (codes(inside, nodes, entries) == want).all()
    count, total = sums(inside, nodes, entries)
    assert count.tolist() == np.bincount(want, minlength=len(entries)).tolist()
    assert all((total[j] == inside[want == j].sum(axis=0)).all() for j in range(len(entries)))
    whole, _, single, _ = settle(inside, nodes, np.array([[-1500, 0, 0], [1500, 0, 0]]))
    assert len(whole) and len(single) < len(points) // 2
