import random

import pytest

from tessera.llm.chat import best_paths, chat_table, escape, format_paths, parse, render, unescape
from tessera.llm.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows

from .data import SF

NODES = "conv long, node long, parent long, score double, role string, text string"


def test_query_matches_sql(spark):
    assert spark_rows(QUERIES["op7_chat_format"](spark, SF)) == sql_rows(connect(SF), SQL["op7_chat_format"])


def test_control_strings_round_trip():
    rng = random.Random(1)
    marks = ["### ", "#", ": ", ":", "</turn>", "</turn>\n", "<", "\\", "\\\\", "\n", "assistant", "ok", "ü🙂", " ", ""]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "a: b", "### x", "\\", ""]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, mask = render(turns)
        assert parse(text) == turns
        assert [unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]
    assert escape("a</turn>") == "a\\</turn>"
    with pytest.raises(ValueError):
        parse("no turn")


def trees(rng, convs, size):
    rows = []
    for c in range(convs):
        for n in range(rng.randint(1, size)):
            parent = None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - 4), n)
            rows.append((c, n, 900 + n if rng.random() < 0.03 else parent, rng.choice([None, 0.0, 0.5, rng.random()]), rng.choice(["user", "assistant", None]), rng.choice([None, f"text {n}", "# <x>"])))
    return rows


def brute(rows, branches):
    out = []
    for c in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == c}
        children = {r[2] for r in own.values() if r[2] in own}
        paths = []
        for leaf in own:
            if leaf in children:
                continue
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][2]
            if at in seen:
                continue
            paths.append((-sum(own[n][3] or 0.0 for n in path) / len(path), -len(path), leaf, path[::-1]))
        paths.sort(key=lambda p: (round(p[0], 12), p[1], p[2]))
        out += [(c, p[2], k + 1, p[3]) for k, p in enumerate(paths[:branches])]
    return sorted(out)


@pytest.mark.parametrize("branches", [1, 3, 1000])
def test_paths_are_brute_force(spark, branches):
    rows = trees(random.Random(2), 12, 40)
    nodes = spark.createDataFrame(rows, NODES)
    got = {}
    for r in best_paths(nodes, branches).collect():
        got.setdefault((r["conv"], r["leaf"], r["rank"]), []).append((r["depth"], r["node"]))
    want = brute(rows, branches)
    assert sorted((*k, [n for _, n in sorted(v)]) for k, v in got.items()) == want
    own = {(r[0], r[1]): (r[4] or "", r[5] or "") for r in rows}
    texts = {(r["conv"], r["leaf"]): r["formatted"] for r in format_paths(nodes, branches).collect()}
    assert texts == {(c, leaf): render([own[c, n] for n in path])[0] for c, leaf, _, path in want}


def test_long_chain_takes_few_rounds_and_cycles_have_no_path(spark):
    chain = [(1, n, n - 1 if n else None, 1.0, "user", "x") for n in range(3000)]
    cycle = [(2, 0, 2, 1.0, "user", "a"), (2, 1, 0, 1.0, "user", "b"), (2, 2, 1, 1.0, "user", "c"), (2, 3, 2, 1.0, "user", "d"), (2, 9, None, 1.0, "user", "e")]
    out = {r["conv"]: r["formatted"] for r in format_paths(spark.createDataFrame(chain + cycle, NODES)).collect()}
    assert len(parse(out[1])) == 3000 and parse(out[2]) == [("user", "e")]


def test_awkward_turns_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "# a"), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as node", "'y' as leaf", "1 as depth")
    got = {r["conv_id"]: r for r in chat_table(df).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (4, 5), None: (1, 3), 2: (1, 0)}
    assert chat_table(spark.createDataFrame([], schema)).collect() == []
