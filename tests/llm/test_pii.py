import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm.boosting import fit
from tessera.llm.pii import KINDS, findings, located, pii_table, redacted, train
from tessera.llm.queries import QUERIES

from .data import DOCS, SF, awkward, empty, prose

#: The contract's patterns as given.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        odd = [int(c) for c in d[::-1]]
        return 13 <= len(d) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * c, 10)) for c in odd[1::2])) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    out = {k: [m.span() for m in re.finditer(RULES[k], text or "", re.ASCII) if passes(k, m[0])] for k in KINDS}
    return out, ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in out[k])


def check(docs, rows):
    want, got = [], []
    for d in docs:
        spans, line = brute(d["text"])
        want.append((d["doc_id"], *[len(spans[k]) for k in KINDS], hashlib.sha256(line.encode()).hexdigest()))
    for r in rows:
        got.append((r["doc_id"], *[r[f"n_{k}"] for k in KINDS], r["base_sha256"]))
        listed = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert len(listed) == sum(r[f"n_{k}"] for k in KINDS) + r["n_added"]
        assert listed == sorted(listed, key=lambda x: (KINDS.index(x[0]), int(x[1])))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query_is_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), QUERIES["op4_pii"](spark, SF).collect())


def noise(rng):
    parts = ["a.b@c.de", "x@y", "x@y.z_d@e.f", "_q+1%@A-1.b-.c", "@a.b", "a@b@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0255.00.1", "12.3", "+49 (30) 1234-567", "+1 2", "++1 555 123 4567 .", "+123456789012345678",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0" * 16, "1234567890123", " ", "ä", "🙂", "-", ".", "(", "\n", "tel", "card ", "(555) 123-4567", "mail me [at] host [dot] org"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " ", " word "]) for _ in range(rng.randint(0, 40)))


def test_adversarial_and_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, noise(rng), "en", "a", 0) for i in range(400)]
    rows += [(1000, "9" * 30_000, "en", "a", 0), (1001, "a" * 30_000 + "@", "en", "a", 0), (1002, "1 " * 20_000, "en", "a", 0), (1003, "x@y.z " * 5_000, "en", "a", 0), (1004, "a.b@c" + ".d" * 10_000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    check(docs.collect(), pii_table(docs).collect())
    check(awkward(spark).collect(), pii_table(awkward(spark)).collect())
    assert pii_table(empty(spark)).collect() == []


def test_positions_and_context(spark):
    text = "".join(f"ü{'-' * (i % 7)} {i}" for i in range(500))
    df = located(spark.createDataFrame([(text,)], "text string"), "text", "[0-9]+", "[0-9]", "m")
    got = df.first()["m"]
    assert [(m["s"], m["e"], m["v"]) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert all(text[m["s"] - len(m["l"]) : m["s"]] == m["l"] and text[m["e"] : m["e"] + len(m["r"])] == m["r"] for m in got)


def test_trees_learn_an_interaction_and_threshold_keeps_precision():
    rows = [((a, b, c), int(a > 1 and b > 0), 20) for a in range(4) for b in range(2) for c in range(3)]
    model = fit(rows, rows, 0.95)
    assert all((model.score(x) >= model.threshold) == bool(y) for x, y, _ in rows)
    never = fit([((0,), 0, 10)], [((0,), 0, 10)], 0.95)
    assert never.score((0,)) < never.threshold


def test_spans_without_the_defining_mark_are_added(spark):
    """Numbers written like the phone numbers of the corpus, but without '+', come on top; prose and dates do not."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"{prose(rng, 8)} call +1 ({rng.randint(200, 999)}) {digits(3)}-{digits(4)} {prose(rng, 5)}", "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 8)} on {rng.randint(1990, 2020)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {prose(rng, 5)}", "en", "a", 0) for i in range(300)]
    rows += [(5000, "please call (212) 555-0187 today", "en", "a", 0), (5001, "on 2014-05-12 we met", "en", "a", 0)]
    got = {r["doc_id"]: r for r in pii_table(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5000]["spans"] == "phone:12:26" and got[5001]["spans"] == ""
    assert all(got[i]["n_phone"] == 1 for i in range(300))


def test_redacted_text(spark):
    df = spark.createDataFrame([("call +1 555 1234567 or a@b.cd", [(0, 23, 29), (3, 5, 19), (2, 8, 19)])], "text string, spans array<struct<k:int,s:long,e:long>>")
    assert df.select(redacted(F.col("text"), F.col("spans")).alias("t")).first()["t"] == "call [PHONE] or [EMAIL]"


def test_patterns_are_counted_over_all_rows_and_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = findings(docs)
    assert found.count() == docs.count() and isinstance(train(found), dict)
    plan = pii_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_base_phones_with_wide_gaps_are_found(spark):
    texts = ["call +1 - 2 - 3 - 4 - 5 - 6 - 7 - 8 - 9 - 0 now", "+4 (((( 9 .... 1 ---- 2     3 ()() 4 )))) 5 - - 6 . . 7 ( ) 8", "no digits", "+ 1 - 2 - 3"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    rows = pii_table(docs).collect()
    check(docs.collect(), rows)
    assert {r["doc_id"]: r["n_phone"] for r in rows} == {0: 1, 1: 1, 2: 0, 3: 0}
