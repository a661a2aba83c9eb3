from collections import Counter

import corpus_pipeline as p
from tessera.llm.common import written
from tessera.llm.mixing import mix
from tests.llm import test_decontaminate, test_simdedup

from .data import SF, awkward, empty


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    stage = dict(p.STAGES)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    told = written(stage["language"](spark, docs, SF))
    letters = [r["doc_id"] for r in docs.collect() if sum(c.isalpha() for c in r["text"]) > 40]
    assert told.columns == docs.columns and set(letters) <= {r["doc_id"] for r in told.collect()}

    rows = told.collect()
    prints = {r["doc_id"]: test_simdedup.fingerprint(r["text"]) for r in rows}
    group = test_simdedup.components(list(prints.values()))
    first = {}
    for i, f in prints.items():
        first[group[f]] = min(first.get(group[f], i), i)
    single = written(stage["near_dedup"](spark, told, SF))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    leaks = {i for i, *_ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in single.collect()], bench)}
    clean = written(stage["decontaminate"](spark, single, SF))
    assert leaks and sorted(r["doc_id"] for r in clean.collect()) == sorted({r["doc_id"] for r in single.collect()} - leaks)

    mixed = written(stage["mix"](spark, clean, SF))
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, mix(clean).collect()))

    out = stage["shard"](spark, mixed, SF)
    assert out.columns == [*docs.columns, "shard"] and out.count() == mixed.count()
    run = p.run(spark, SF)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, out.collect()))


def test_awkward_and_empty_tables_pass_all_stages(spark):
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for name, stage in p.STAGES:
            docs = written(stage(spark, docs, SF))
            assert docs.columns == columns if name != "shard" else set(columns) <= set(docs.columns)
