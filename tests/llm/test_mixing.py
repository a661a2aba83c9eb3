import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from tessera.llm.mixing import mix, mix_table
from tessera.llm.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows

from .data import SF, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict) -> dict:
    """The contract's rule as a loop: share by weight, cut at twice the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        all_weight = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * left / all_weight > 2 * sizes[s] + 1e-9}
        if not full:
            return out | {s: weight[s] * left / all_weight for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(docs, rows):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((d["doc_id"], d["source"], len(WORD.findall(d["text"] or ""))) for d in docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_targets_and_budgets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs.collect(), mix_table(docs).collect())
    check(awkward(spark).collect(), mix_table(awkward(spark)).collect())
    assert mix_table(empty(spark)).collect() == [] and mix(empty(spark)).collect() == []


def test_query_matches_sql_and_reruns_agree(spark):
    got = spark_rows(QUERIES["op5_mix_sources"](spark, SF))
    assert got == sql_rows(connect(SF), SQL["op5_mix_sources"]) == spark_rows(QUERIES["op5_mix_sources"](spark, SF))


def test_mixed_documents_are_what_the_table_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = mix_table(docs).collect()
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    words, whole = defaultdict(int), Counter()
    for r in mix(docs).collect():
        n = len(WORD.findall(r["text"]))
        words[r["doc_id"]] += n
        if r["text"] == text[r["doc_id"]]:
            whole[r["doc_id"]] += 1
        else:
            assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    for r in table:
        assert words[r["doc_id"]] == r["taken"]
        assert whole[r["doc_id"]] == (r["taken"] // r["size"] if r["size"] else 0)


def test_mix_of_awkward_rows_keeps_columns(spark):
    docs = awkward(spark)
    out = mix(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == pytest.approx(sum(r["taken"] for r in mix_table(docs).collect()), abs=4)


def test_order_is_by_hash(spark):
    rows = sorted(mix_table(spark.read.parquet(f"{SF}/documents.parquet")).collect(), key=lambda r: (r["source"], r["start"], r["size"]))
    keys = [(r["source"], r["key"]) for r in rows]
    assert keys == sorted(keys) and all(r["key"] == md5(str(r["doc_id"]).encode()).hexdigest() for r in rows)
