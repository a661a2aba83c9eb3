import hashlib
import random
import struct

import pytest
import xxhash

from tessera.llm.minhash import BINS, PROBES, fingerprint_table, with_next
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, WORDS, awkward, empty, prose

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingles(text: str) -> set[int]:
    words = [w for w in text.lower().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(signed(h))
    return out


def pair_hash(a: int, b: int) -> int:
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", b), seed=xxhash.xxh64_intdigest(struct.pack("<i", a), seed=42)))


def brute(text: str) -> str:
    bins = {}
    for h in shingles(text):
        bins[(h >> 57) + 64] = min(bins.get((h >> 57) + 64, 2**63), h)
    out = []
    for b in range(BINS):
        at = b if b in bins else next((j for t in range(1, PROBES + 1) if (j := pair_hash(b, t) % BINS) in bins), None)
        if at is None and bins:
            at = min(bins, key=lambda j: pair_hash(j, b))
        out.append(f"{bins[at] & 15:x}" if at is not None else "0")
    return "".join(out)


def edited(texts: list[str]) -> list[str]:
    out = []
    for t, after in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        out.append(t[: len(t) - half] + after[:half])
    return out


def like(a: str, b: str) -> float:
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (1 - 1 / 16))


def check(docs, rows):
    docs = sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"], d["text"] or "") if d["doc_id"] is not None else (False, 0, d["text"] or ""))
    texts = [d["text"] or "" for d in docs]
    e = edited(texts)
    p, q = [brute(t) for t in texts], [brute(t) for t in e]
    want = [(d["doc_id"], len(t), hashlib.sha256(x.encode()).hexdigest(), a, b, like(a, b), like(a, c)) for d, t, x, a, b, c in zip(docs, texts, e, p, q, p[1:] + p[:1])]
    got = [tuple(r[c] for c in COLUMNS) for r in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_query_is_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), QUERIES["op1_minhash_fingerprints"](spark, SF).collect())


def test_awkward_rows_and_empty_table(spark):
    check(awkward(spark).collect(), fingerprint_table(awkward(spark)).collect())
    assert fingerprint_table(empty(spark)).collect() == []
    one = spark.createDataFrame([(3, "one two three", "en", "a", 1)], DOCS)
    check(one.collect(), fingerprint_table(one).collect())


def test_neighbours_across_blocks(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-10_000, 10_000), 400) + [7] * 30 + [None, None]
    rows = sorted(((i, f"t{n:04}") for n, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")
    want = [(i, t, after) for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1])]
    for each in (1, 7, 100_000):
        got = [(r["doc_id"], r["text"], r["next_text"]) for r in with_next(df, "doc_id", ["text"], each).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_estimates_are_close_and_unbiased(spark):
    """Pairs of known similarity, long and short: the mean error is small, and so is the spread."""
    rng = random.Random(2)
    errors = []
    rows, truth = [], []
    for n in (12, 40, 300):
        for _ in range(40):
            a = [rng.choice(WORDS) for _ in range(n)]
            b = a[: rng.randint(5, n)]
            b += [rng.choice(WORDS) for _ in range(n - len(b))]
            sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
            truth.append(len(sa & sb) / len(sa | sb))
            rows += [(2 * len(truth), " ".join(a), "en", "s", 0), (2 * len(truth) + 1, " ".join(b), "en", "s", 0)]
    near = {r["doc_id"]: r["near_next"] for r in fingerprint_table(spark.createDataFrame(rows, DOCS)).collect()}
    errors = [near[2 * (i + 1)] - t for i, t in enumerate(truth)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.35


def test_plan_has_no_python(spark):
    plan = fingerprint_table(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_equal_texts_have_equal_fingerprints(spark):
    t = prose(random.Random(3), 200)
    rows = fingerprint_table(spark.createDataFrame([(1, t, "en", "a", 0), (5, "other words here", "en", "a", 0), (9, t, "en", "b", 1)], DOCS)).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[1] == by[9] != by[5]
