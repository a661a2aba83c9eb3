import hashlib
import random
import re

from tessera.llm.queries import QUERIES
from tessera.llm.secrets import KINDS, Novelty, novel_spans, secret_table

from .data import DOCS, SF, WORDS, awkward, empty, prose


def brute(text):
    """The contract's patterns as given."""
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def check(docs, rows):
    want = []
    for d in docs:
        spans = brute(d["text"] or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((d["doc_id"], *[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(line.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    for r in rows:
        assert len([x for x in r["spans"].split(",") if x]) == r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_novel"]


def test_query_is_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), QUERIES["op8_secrets"](spark, SF).collect())


def test_adversarial_and_awkward_rows(spark):
    rng = random.Random(1)
    parts = ["token", "TOKEN", "toKen", "paſſword", "api_key", "ApiKey", "secret", "passwd", "=", ":", " = ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "short", "longer-than-twelve", "\n", "ü", "🙂"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "en", "a", 0) for i in range(500)] + [(900, "token=secret: abcdefghijklmnop", "en", "a", 0), (901, "f" * 100_000, "en", "a", 0)], DOCS)
    check(docs.collect(), secret_table(docs).collect())
    check(awkward(spark).collect(), secret_table(awkward(spark)).collect())
    assert secret_table(empty(spark)).collect() == []


def test_novelty_tells_random_strings_from_names():
    rng = random.Random(2)
    novelty = Novelty(" ".join(WORDS).encode())
    around = prose(rng, 40)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in (20, 32, 64):
        for _ in range(50):
            value = "".join(rng.choice(alphabet) for _ in range(n))
            assert novelty.of(around, value) >= 0.72 * n
            assert novelty.of(f"{around} {value}", value) < 0.5 * n
        names = ["_".join(rng.choice(WORDS) for _ in range(n // 4)) for _ in range(100)]
        assert sum(novelty.of(around, name) >= 0.72 * len(name) for name in names) <= 10


def test_only_sensitive_incompressible_strings_are_added(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = "".join(rng.choice(alphabet) for _ in range(32))
    text = {1: f"the credential was {value} as agreed", 2: f"the number was {value} as agreed", 3: "the credential was underhouseunderhouse_houseunder as agreed under house", 4: f"Authorization Bearer {value}"}
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in text.items()] + [(100 + i, prose(rng, 50), "en", "a", 0) for i in range(50)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in secret_table(docs).collect()}
    assert got[1] == "novel:19:51" and got[4] == "novel:21:53" and got[2] == ""
    assert not any(got[i] for i in range(100, 150))


def test_spans_do_not_touch_base_spans():
    novelty = Novelty(b"some words here")
    text = "token = Zk39dkWqPz71LmXo88Ta secret Zk39dkWqPz71LmXo88TbQ"
    base = brute(text)
    new = novel_spans(text, novelty, [(s, k, e) for s, k, e in base], 0.2, 4)
    assert new and all(e <= a or b <= s for s, e, _ in new for a, _, b in base)


def test_copies_of_a_secret_nearby_do_not_hide_it():
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    novelty = Novelty(" ".join(WORDS).encode())
    for n in (20, 32, 40):
        value = "".join(rng.choice(alphabet) for _ in range(n))
        for between in (" and again bearer ", ". Bearer ", f" {prose(rng, 40)[: 250 - n // 2]} bearer "):
            text = f"the bearer {value}{between}{value} as agreed"
            first, second = 11, 11 + n + len(between)
            got = [s for s, _, _ in novel_spans(text, novelty, [])]
            assert got == [first, second], (n, between)


def test_secrets_that_start_within_the_reach_are_found():
    novelty = Novelty(" ".join(WORDS).encode())
    value = "q7RzT0xKp4LmW9vB2nYc8HsD"
    for gap in range(1, 70):
        text = f"credential{' ' * gap}{value}"
        assert [(s, e) for s, e, _ in novel_spans(text, novelty, [])] == ([(10 + gap, 10 + gap + len(value))] if gap < 64 else [])
