import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.language import LANGUAGES, document_rows, identify, keep_identified, page_rows, smoothed, train
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, awkward, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd, even = docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0 and length(trim(text)) > 0")
    rows = {r["doc_id"]: r for r in identify(document_rows(even), train(odd), ["doc_id"]).collect()}
    truth = {r["doc_id"]: r["lang"] for r in even.collect()}
    right = sum(rows[i]["language"] == lang for i, lang in truth.items())
    assert right >= 0.98 * len(truth) and sum(r["accepted"] for r in rows.values()) >= 0.99 * len(truth)


def test_query_covers_documents_and_pages(spark):
    rows = QUERIES["op3_language"](spark, SF).collect()
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(r["doc_id"] for r in docs.collect())
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == sorted(r["page_id"] for r in pages.collect())
    said = {r["page_id"]: r["html"].split('lang="')[1][:2] for r in pages.collect() if 'lang="' in r["html"]}
    page = {r["page_id"]: r["language"] for r in rows if r["page_id"] is not None}
    assert sum(page[i] == lang for i, lang in said.items()) >= 0.95 * len(said)


def test_prior_is_smoothed_level_by_level(spark):
    counts = spark.createDataFrame([("d1", "h1", 9.0, 1.0), ("d1", "h2", 0.0, 2.0), ("d2", "h3", 50.0, 0.0)], "d string, h string, q0 double, q1 double")
    got = {(r["d"], r["h"]): (r["p_q0"], r["p_q1"]) for r in smoothed(counts, [[], ["d"], ["d", "h"]], ["q0", "q1"]).collect()}
    top = np.array([59.0 + 1, 3.0 + 1]) / 64
    d1 = (np.array([9.0, 3.0]) + 20 * top) / 32
    assert got["d1", "h1"] == pytest.approx((np.array([9.0, 1.0]) + 20 * d1) / 30)
    d2 = (np.array([50.0, 0.0]) + 20 * top) / 70
    assert got["d2", "h3"] == pytest.approx((np.array([50.0, 0.0]) + 20 * d2) / 70)


def test_host_and_markup_decide_what_the_text_leaves_open(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200")
    model = train(docs)
    base = document_rows(docs).select("doc_id", "text", F.concat(F.lit("host-"), "doc_id").alias("host"), "domain", "suffix", F.col("declared"))
    known = docs.select("doc_id", "text", F.concat("lang", F.lit(".example")).alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"))
    open_ = [(-1, "la la la", "fr.example", None, None, None), (-2, "la la la", "es.example", None, None, None), (-3, "la la la", "none", None, None, "fr"), (-4, "la la la", "none", None, None, "es-MX")]
    rows = known.unionByName(spark.createDataFrame(open_, "doc_id long, text string, host string, domain string, suffix string, declared string"))
    got = {r["doc_id"]: r["language"] for r in identify(rows, model, ["doc_id"]).filter("doc_id < 0").collect()}
    assert got == {-1: "fr", -2: "es", -3: "fr", -4: "es"}
    assert base.count() == docs.count()


def test_addresses_and_markup_of_pages(spark):
    html = '<!DOCTYPE html><HTML class="a" LANG=de-AT><head><style>p{}</style><script>var the = 1;</script></head><p>Hallo&nbsp;Welt</p>'
    pages = spark.createDataFrame([(1, "https://user@www.Shop.example.co:8080/fr/a?x=1", html), (2, "no address", "plain"), (3, None, None), (4, "http://localhost", "<b>x</b>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_rows(pages).collect()}
    assert (got[1]["host"], got[1]["domain"], got[1]["suffix"], got[1]["declared"]) == ("www.shop.example.co", "example.co", "co/fr", "de")
    assert got[1]["text"].split() == ["Hallo", "Welt"]
    assert (got[2]["host"], got[2]["suffix"], got[3]["text"], got[4]["domain"], got[4]["suffix"]) == ("", "", "", "", "localhost")


def test_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(-1, "", "en", "src0", 0), (-2, "12345 --- !!!", "en", "src0", 1), (-3, None, None, None, None), (-4, "русский текст здесь", "en", "src0", 9)]
    every = docs.unionByName(spark.createDataFrame(extra, DOCS))
    kept = keep_identified(every)
    ids = {r["doc_id"] for r in kept.collect()}
    letters = {r["doc_id"] for r in docs.collect() if sum(c.isalpha() for c in r["text"]) > 40}
    assert kept.columns == docs.columns and letters <= ids and not ids & {-1, -2, -3}


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    rows = identify(document_rows(docs), train(docs), ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(r["language"] in (*LANGUAGES, "und") and 0 <= r["probability"] <= 1 + 1e-9 and not math.isnan(r["probability"]) for r in rows)
    assert keep_identified(docs).columns == docs.columns and keep_identified(empty(spark)).collect() == []
    assert identify(document_rows(empty(spark)), train(empty(spark)), ["doc_id"]).collect() == []


def buckets(text):
    """Letter trigrams in whole numbers, one after another."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    c, out = [ord(x) for x in f" {' '.join(words)} "] if words else [], []
    for a, b, d in zip(c, c[1:], c[2:]):
        h = (((a * 0x9E3779B1 ^ b * 0x85EBCA77) % 2**32) * 0xC2B2AE3D + d * 0x27D4EB2F) % 2**32
        out.append(((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 17)
    return out


def test_query_is_brute_force(spark):
    """Counts, likelihoods, priors, evidence and posterior once more, row by row in plain Python."""
    import re
    from collections import defaultdict

    from tessera.llm.language import ALPHA, BUCKETS, KAPPA, NONE, TEMPER

    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    n = len(LANGUAGES) + 1
    count = np.full((n - 1, BUCKETS), ALPHA)
    for r in docs.collect():
        if r["lang"] in LANGUAGES:
            for b in buckets(r["text"] or ""):
                count[LANGUAGES.index(r["lang"]), b] += 1
    logs = np.vstack([np.log(count / count.sum(axis=1, keepdims=True)), np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32).astype(float)
    rows = []
    for r in [*document_rows(docs).collect(), *page_rows(pages).collect()]:
        low = {c: (r[c] or "").lower() for c in ("host", "domain", "suffix")}
        short = (re.match(r"\s*([A-Za-z]+)", r["declared"] or "") or ["", ""])[1].lower()
        b = buckets(r["text"] or "")
        rows.append({"id": (r["doc_id"], None) if "doc_id" in r else (None, r["page_id"]), **low, "declared": short if short in ("", *LANGUAGES) else "other", "l": logs[:, b].sum(axis=1) * TEMPER if b else None})

    def share(x):
        p = np.exp(x - x.max())
        return p / p.sum()

    soft = {k: defaultdict(lambda: np.zeros(n)) for k in ("all", "domain", "host", "suffix", "declared")}
    for r in rows:
        if r["l"] is not None:
            q = share(r["l"])
            for k, at in (("all", ""), ("domain", r["domain"]), ("host", (r["domain"], r["host"])), ("suffix", r["suffix"]), ("declared", r["declared"])):
                soft[k][at] += q
    top = (soft["all"][""] + 1) / (soft["all"][""].sum() + n)

    def evidence(kind, at):
        if at == "":
            return np.zeros(n)
        named = [v for k, v in soft[kind].items() if k != ""]
        return np.log((soft[kind][at] + 0.5) / (sum(named) + 0.5 * (len(named) + 1)))

    got = {(r["doc_id"], r["page_id"]): r for r in QUERIES["op3_language"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, p = NONE, 1.0
        if r["l"] is not None:
            d, h = soft["domain"][r["domain"]], soft["host"][r["domain"], r["host"]]
            prior = (d + KAPPA * top) / (d.sum() + KAPPA)
            prior = (h + KAPPA * prior) / (h.sum() + KAPPA)
            q = share(r["l"] + np.log(prior) + evidence("suffix", r["suffix"]) + evidence("declared", r["declared"]))
            lang, p = [*LANGUAGES, NONE][int(q.argmax())], q.max()
        x = got[r["id"]]
        assert (x["language"], x["accepted"]) == (lang, lang != NONE and p >= 0.5) and x["probability"] == pytest.approx(p, abs=1e-4)
