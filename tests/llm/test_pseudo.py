import random

import numpy as np
import pytest

from tessera.llm.pseudo import DIM, REACH, TOKENS, WINDOW, WORDS, Network, Vocabulary, around, fit, score_table
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, awkward, empty


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 5 <> 0"), rounds=2, stride=2)


def test_probabilities_of_all_tokens_sum_to_one():
    net = Network.start(np.arange(TOKENS)[::-1].astype(float))
    context = np.array([[5, TOKENS, 17, 3000]])
    total = np.exp(net.log_prob(np.repeat(context, TOKENS, axis=0), np.arange(TOKENS))).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    net = Network.start(rng.integers(1, 100, TOKENS).astype(float))
    net.flat[:] = net.flat.astype(np.float32)
    ctx, target = rng.integers(0, TOKENS, (6, len(WINDOW))), rng.integers(0, TOKENS, 6)
    wide = Network(net.flat.astype(np.float64))
    grads = Network(np.zeros_like(wide.flat))
    # A huge memory makes the Adagrad step a plain gradient step: step = rate * g / sqrt(memory).
    before = wide.flat.copy()
    memory = Network(np.full_like(wide.flat, 1e12))
    wide.learn(ctx, target, memory, 1e6)
    grads.flat[:] = before - wide.flat
    for k in np.flatnonzero(np.abs(grads.flat) > 1e-6)[:: max(1, (np.abs(grads.flat) > 1e-6).sum() // 60)]:
        up, down = before.copy(), before.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = -(Network(up).log_prob(ctx, target).mean() - Network(down).log_prob(ctx, target).mean()) / 2e-5
        assert grads.flat[k] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_scores_are_summed_conditionals(spark, model):
    words, flat = model
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in score_table(docs, model).collect()}
    net, vocabulary = Network(flat), Vocabulary(words)
    import re

    for d in docs.limit(20).collect():
        ids = np.array([TOKENS] * REACH + [vocabulary[w] for w in re.findall(r"\w+", d["text"].lower())] + [TOKENS] * REACH)
        at = np.arange(REACH, len(ids) - REACH)
        want = net.log_prob(around(ids, at), ids[at]).sum() if len(at) else 0.0
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(at) and r["log_prob"] == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert DIM * WORDS < len(flat)


def test_held_out_texts_beat_shuffled_ones_and_the_unigram_model(spark, model):
    words, flat = model
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 5 = 0 and n_chars > 300")
    rng = random.Random(1)
    mixed = []
    for d in held.collect():
        w = d["text"].split()
        rng.shuffle(w)
        mixed.append((d["doc_id"], " ".join(w), "en", "a", 0))
    real = {r["doc_id"]: r["mean_log_prob"] for r in score_table(held, model).collect()}
    noise = {r["doc_id"]: r["mean_log_prob"] for r in score_table(spark.createDataFrame(mixed, DOCS), model).collect()}
    plain = Network(flat.copy())
    plain.embed[:] = 0
    plain.bias[:] = 0
    base = {r["doc_id"]: r["mean_log_prob"] for r in score_table(held, (words, plain.flat)).collect()}
    print(np.mean(list(real.values())), np.mean(list(noise.values())), np.mean(list(base.values())))
    assert np.mean(list(real.values())) > np.mean(list(base.values()))
    assert np.mean(list(real.values())) >= np.mean(list(noise.values()))


def test_query_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op10_pseudo_likelihood"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert all(r["log_prob"] < 0 for r in rows if r["n_tokens"])
    odd = score_table(awkward(spark)).collect()
    assert len(odd) == awkward(spark).count()
    assert all(r["log_prob"] == 0 and r["mean_log_prob"] is None for r in odd if r["n_tokens"] == 0)
    assert score_table(empty(spark)).collect() == []


def test_rare_words_cost_their_share_of_the_bucket(spark):
    import math
    import re
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    texts = [(r["doc_id"], re.findall(r"\w+", r["text"].lower())) for r in docs.collect()]
    n = Counter(w for _, words in texts for w in words)
    words, flat = fit(docs)
    vocabulary, bucket = Vocabulary(words), Counter()
    for w in n:
        bucket[vocabulary[w]] += n[w]
    assert sum(vocabulary[w] >= WORDS for w in n) > 1000
    plain = sorted((r["doc_id"], r["log_prob"]) for r in score_table(docs, (words, flat)).collect())
    inside = sorted((i, sum(math.log(n[w] / bucket[vocabulary[w]]) for w in ws if vocabulary[w] >= WORDS)) for i, ws in texts)
    got = sorted((r["doc_id"], r["log_prob"], r["mean_log_prob"] * r["n_tokens"]) for r in score_table(docs).collect())
    assert [g[0] for g in got] == [p[0] for p in plain]
    for (_, whole, mean), (_, net), (_, share) in zip(got, plain, inside):
        assert whole == pytest.approx(net + share, rel=1e-3, abs=1e-2) and mean == pytest.approx(whole, rel=1e-9)


def test_rounds_train_on_every_position(spark, monkeypatch):
    import re
    from collections import Counter

    import pyarrow as pa

    from tessera.llm import pseudo

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()] + ["", "one", "two words"]
    want = Counter(w for t in texts for w in re.findall(r"\w+", t.lower()))
    words = sorted(want)[:WORDS]
    flat, seen = Network.start(np.ones(TOKENS)).flat, Counter()
    monkeypatch.setattr(Network, "learn", lambda self, around, target, memory, rate: seen.update(target.tolist()))
    for k in range(pseudo.ROUNDS):
        # Batches differ from round to round; positions must not get lost.
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7 + k])], names=["text"]) for i in range(0, len(texts), 7 + k)]
        list(pseudo.trainer(words, flat, pseudo.STRIDE, k % pseudo.STRIDE, 0.1)(iter(batches)))
    vocabulary, ids = Vocabulary(words), Counter()
    for w, n in want.items():
        ids[vocabulary[w]] += n
    assert seen == ids
    with pytest.raises(ValueError):
        fit(spark.read.parquet(f"{SF}/documents.parquet"), rounds=2, stride=3)


@pytest.mark.parametrize("scale", [1, 300])
def test_logits_come_in_blocks_and_may_be_of_any_size(monkeypatch, scale):
    """Small logits are exponentiated as they are, large ones after a shift; no array of them is longer than a block."""
    from tessera.llm import pseudo

    net = Network.start(np.arange(TOKENS)[::-1].astype(float))
    net.to_class[:] *= scale
    net.to_word[:] *= scale
    rng = np.random.default_rng(2)
    ctx, target = rng.integers(0, TOKENS, (5000, len(WINDOW))), rng.integers(0, 200, 5000)
    sizes, plain = [], Network.exponentials
    monkeypatch.setattr(Network, "exponentials", staticmethod(lambda x: sizes.append(len(x)) or plain(x)))
    got = net.log_prob(ctx, target)
    assert max(sizes) == pseudo.BLOCK and bool(net.large()[0]) == bool(net.large()[1].any()) == (scale > 1)
    h, c = net.hidden(ctx).astype(float), target // pseudo.MEMBERS
    rows = np.arange(len(target))
    first = h @ net.to_class + net.class_bias
    members = c[:, None] * pseudo.MEMBERS + np.arange(pseudo.MEMBERS)
    second = np.einsum("nd,nmd->nm", h, net.to_word[members]) + net.word_bias[members]
    want = sum(x[rows, at] - np.logaddexp.reduce(x, axis=1) for x, at in ((first, c), (second, target % pseudo.MEMBERS)))
    assert got == pytest.approx(want, rel=1e-3, abs=1e-3)
    before = net.flat.copy()
    net.learn(ctx, target, Network(np.full_like(net.flat, 1e-8)), 0.1)
    assert np.isfinite(net.flat).all() and (net.flat != before).any()


def test_pairs_of_rare_words_are_not_sorted_by_their_words(spark):
    plan = score_table(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [word" in plan and "Sort [word" not in plan
