import random
import re
from collections import Counter

import pytest

from tessera.llm.decontaminate import decontaminate, passages
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, awkward, empty, prose


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def brute(docs, items, least=0.8):
    """Every window of every item's size, exact multiset Jaccard; windows without a common shingle are 0."""
    want = {}
    for n, (i, text) in enumerate(docs):
        words = tokens(text)
        for j, (item, t) in enumerate(items):
            own = tokens(t)
            width = min(5, len(own))
            g, h = grams(own, width) if width else [], grams(words, width) if width else []
            if not g or not set(g) & set(h):
                continue
            size, best = min(len(g), len(h)), (0.0,)
            for s in range(len(h) - size + 1):
                both = sum((Counter(h[s : s + size]) & Counter(g)).values())
                like = both / (size + len(g) - both)
                if like >= least and like > best[0]:
                    best = (like, s, size + width - 1)
            if len(best) > 1:
                want[n, j] = (i, item, *best)
    return sorted(want.values(), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["item_id"], r["similarity"], r["start"], r["words"]) for r in df.collect()), key=str)


def test_query_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op2_decontaminate"](spark, SF)) == brute(docs, items)


def planted(rng):
    items = [(i, prose(rng, rng.randint(6, 70))) for i in range(60)] + [(100, "only four words here"), (101, ""), (102, None), (103, "solo")]
    docs = []
    for n in range(120):
        text = prose(rng, rng.randint(0, 150))
        if n % 2:
            words = rng.choice(items)[1]
            words = (words or "").split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    k = rng.randrange(len(words))
                    words[k : k + 1] = rng.choice([[], ["zebra"], [words[k].upper() + ",", "quux"]])
            text = f"{text} {' '.join(words)}.\n{prose(rng, rng.randint(0, 80))}"
        docs.append((n, text))
    return docs, items


@pytest.mark.parametrize("slice_words", [400_000, 300])
def test_edited_passages_are_found_like_by_brute_force(spark, slice_words):
    docs, items = planted(random.Random(6))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(passages(d, b, slice_words=slice_words))
    want = brute(docs, items)
    assert len(want) > 15 and got == want


def test_long_documents_and_repeats(spark):
    rng = random.Random(7)
    item = prose(rng, 40)
    text = f"{prose(rng, 30_000)} {item} {prose(rng, 20_000)} {item.upper()} {prose(rng, 5)}"
    d = spark.createDataFrame([(1, text), (1, text), (2, prose(rng, 50_000))], "doc_id long, text string")
    got = rows_of(passages(d, spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")))
    assert got == [(1, 5, 1.0, 30_000, 40)] * 4


def test_stage_removes_only_leaks(spark):
    docs, items = planted(random.Random(8))
    bad = {i for i, *_ in brute(docs, items)}
    d = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in docs], DOCS).selectExpr("*", "'x' as text_hash", "1 as item_id")
    kept = decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _ in docs} - bad)


def test_awkward_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, prose(random.Random(1), 30)), (None, None), (2, "")], "item_id long, text string")
    docs = awkward(spark)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(passages(docs, bench)) == brute(plain, [(r["item_id"], r["text"]) for r in bench.collect()])
    none = spark.createDataFrame([], bench.schema)
    assert passages(docs, none).collect() == [] and passages(empty(spark), bench).collect() == []
    assert decontaminate(docs, none).count() == docs.count()


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "double", "decimal(12,2)", "date"])
def test_items_may_have_any_kind_of_id(spark, kind):
    text = prose(random.Random(3), 30)
    one = {"date": "date'2024-05-06'"}.get(kind, f"cast(7 as {kind})")
    b = spark.sql(f"select {one} as item_id, '{text}' as text")
    got = passages(spark.createDataFrame([(1, text)], "doc_id int, text string"), b).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [(1, b.first()["item_id"], 1.0)]


def test_repeated_shingles_lose_no_pair():
    """Items and texts that share 90 shingles and repeat others: their fingerprints may be far apart."""
    from tessera.llm.decontaminate import Items

    rng, similar = random.Random(12), 0
    for n in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(88, 96))]
        own, text = [*base, *["again"] * rng.randint(4, 14)], [*base, *["elsewhere"] * rng.randint(4, 14)]
        want = brute([(1, " ".join(text))], [(5, " ".join(own))])
        found = Items([" ".join(own)]).find(" ".join(text))
        similar += len(want)
        assert [(1, 5, *x) for x in found.values()] == want
    assert similar > 100


def test_repeats_are_those_of_the_window():
    import numpy as np

    from tessera.llm.decontaminate import repeats

    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 30):
        h = rng.integers(0, 12, 30).astype(np.uint64)
        assert repeats(h, size).tolist() == [len(set(h[s : s + size].tolist())) < size for s in range(len(h) - size + 1)]
