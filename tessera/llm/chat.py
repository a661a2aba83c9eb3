"""Chat formatting: the best root-to-leaf paths of reply trees, one conversation each."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .common import match

#: The template: a turn is "### role: text</turn>" and a line end. Inside texts a backslash stands
#: before every character that could begin a mark, and before backslashes.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*+): ((?:[^\\#<]|\\.)*+)</turn>\n", re.DOTALL)


def escape(text: str, extra: str = "") -> str:
    return re.sub(rf"[\\#<{extra}]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of it that bear loss: the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, ':')}{MIDDLE}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, exactly as they went in."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables and totals of reply trees, by iterative self-joins that double the distance.

    ``nodes``: conv, node, parent, score; (conv, node) is unique. Returns tables (conv, node, up) with
    ``up`` the ancestor 1, 2, 4, ... steps away, and (conv, node, total, depth) for nodes that reach a
    root. A missing parent makes a root; nodes that lead into a cycle reach none.
    """
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    step = match(nodes, known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("depth"))
    step = durable(step)
    longest = step.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    for _ in range(int(longest).bit_length()):
        ahead = step.filter("up is not null")
        if ahead.isEmpty():
            break
        jumps.append(ahead.select("conv", "node", "up"))
        far = step.select("conv", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        step = match(ahead, far, ["conv", "up"]).select("conv", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("depth") + F.col("_depth")).alias("depth")).unionByName(step.filter("up is null"))
        step = durable(step)
    return jumps, step.filter("up is null").select("conv", "node", "total", "depth")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes of the ``branches`` best root-to-leaf paths of every conversation: conv, leaf, rank, node, depth.

    A path's score is the mean score of its nodes; ties go to the longer path, then the smaller leaf.
    Null scores count 0. All leaves are ranked from totals, before any path is spelled out.
    """
    jumps, totals = ancestors(nodes)
    parents = nodes.filter("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = match(totals, parents, ["conv", "node"], "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    path = durable(chosen.select("conv", F.col("node").alias("leaf"), "rank", "node"))
    # Every distance is one sum of different powers of two, so each ancestor is reached once.
    for jump in jumps:
        up = match(path, jump, ["conv", "node"]).select("conv", "leaf", "rank", F.col("up").alias("node"))
        path = durable(path.unionByName(up))
    return match(path, totals.select("conv", "node", "depth"), ["conv", "node"])


def linear(turns: DataFrame) -> DataFrame:
    """Conversations as reply trees: every row answers the one before it by turn (then role and text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").alias("conv"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("mask", T.ArrayType(T.ArrayType(T.IntegerType())))])
DIGEST = T.StructType([T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])


@F.pandas_udf(FORMATTED)
def rendered(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [render(list(zip(r, t))) for r, t in zip(roles, texts)]
    return pd.DataFrame({"formatted": [t for t, _ in rows], "mask": [[list(m) for m in mask] for _, mask in rows]})


@F.pandas_udf(DIGEST)
def read_back(formatted: pd.Series, masks: pd.Series) -> pd.DataFrame:
    rows = []
    for text, mask in zip(formatted, masks):
        turns = parse(text)
        loss = "".join(unescape(text[s:e]) for s, e in mask)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=DIGEST.names)


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path of the reply trees ``nodes`` (conv, node, parent, score, role, text).

    Columns: conv, leaf, rank, formatted, mask (spans under loss, in code points of ``formatted``). The
    texts join the chosen paths once, at the end. A path is one row, as a conversation is one example.
    """
    nodes = durable(nodes.select("conv", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    path = best_paths(nodes.select("conv", "node", "parent", "score"), branches)
    whole = match(path, nodes.select("conv", "node", "role", "text"), ["conv", "node"])
    turns = whole.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    out = turns.select("conv", "leaf", "rank", rendered(F.col("turns.role"), F.col("turns.text")).alias("f"))
    return out.select("conv", "leaf", "rank", "f.formatted", "f.mask")


def chat_table(turns: DataFrame) -> DataFrame:
    """What reads back from every formatted conversation: turns, text under the loss mask, lengths.

    Rows are ordered by turn; rows that repeat a turn follow each other by role and text. Null texts and
    roles are empty; a null ``conv_id`` is a conversation of its own. Empty tables give no rows.
    """
    paths = format_paths(linear(turns))
    return paths.select(F.col("conv").alias("conv_id"), read_back("formatted", "mask").alias("d")).select("conv_id", "d.*")
