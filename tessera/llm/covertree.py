"""Vector codes by parts: Lloyd rounds over cover trees of every block of rows.

Each block of vectors has one cover tree for each part position, grown once and kept as a row. A tree
node knows its centre, its radius, and through running sums the sum of all points below it. In
a round a node whose points are all nearest to one entry by the triangle inequality gives its count
and sum as a whole; only nodes that are not clear descend, down to exact comparisons in a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import match, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block, and points of a leaf.
BLOCK, LEAF = 4096, 16
#: Components of 2^LIMIT and more in size cannot be squared exactly; such vectors get no code.
LIMIT = 27
NODE = np.dtype([("low", "i4"), ("high", "i4"), ("centre", "i4"), ("child", "i4"), ("children", "i4"), ("radius", "f8")])


def lengths(a: np.ndarray) -> np.ndarray:
    """Squared lengths of whole-number vectors along the last axis."""
    return (a * a).sum(axis=-1)


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Cover tree of ``points``: their order, in which every node is a range, and the nodes, parents first.

    The children of a node halve its cover radius: centres are picked until each point lies within the
    half of one; they are further apart than that, and the first is the node's own centre.
    """
    order, nodes = np.arange(len(points)), []

    def node(low: int, members: np.ndarray) -> tuple:
        order[low : low + len(members)] = members
        far = np.sqrt(lengths(points[members] - points[members[0]]).max())
        nodes.append([low, low + len(members), members[0], 0, 0, far])
        return len(nodes) - 1, far

    waiting = [node(0, order.copy())] if len(points) else []
    for at, radius in waiting:
        low, high = nodes[at][:2]
        if high - low <= leaf or radius == 0:
            continue
        rest, nodes[at][3] = order[low:high].copy(), len(nodes)
        half = (radius / 2) ** 2
        while len(rest):
            near = lengths(points[rest] - points[rest[0]]) <= half
            waiting.append(node(low, rest[near]))
            low += int(near.sum())
            rest = rest[~near]
            nodes[at][4] += 1
    return order.astype("i4"), np.array([tuple(n) for n in nodes], dtype=NODE)


def settle(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) of all points, given in the order of the tree.

    Returns the nodes that are clear as a whole with their entries, and the positions of the points that
    were compared one by one with theirs. The bounds leave room for rounding, so the answer is exact.
    """
    none = np.zeros(0, dtype=np.int64)
    whole, to, single, alone = [none], [none], [none], [none]
    front, wide = np.arange(min(1, len(nodes))), entries.astype(np.float64)
    while len(front):
        n = nodes[front]
        centre = points[n["low"]].astype(np.float64)
        away = np.sqrt(lengths(centre[:, None, :] - wide))
        reach = away.min(axis=1) + 2 * n["radius"]
        can = away <= (reach + 1e-9 * (1 + reach))[:, None]
        clear = can.sum(axis=1) == 1
        whole.append(front[clear])
        to.append(can[clear].argmax(axis=1))
        dim = n[~clear]
        last = dim[dim["children"] == 0]
        at = ranges(last["low"], last["high"])
        single.append(at)
        alone += [lengths(points[part, None, :] - entries).argmin(axis=1) for part in np.array_split(at, max(1, len(at) // 4096))]
        inner = dim[dim["children"] > 0]
        front = ranges(inner["child"], inner["child"] + inner["children"])
    return np.concatenate(whole), np.concatenate(to), np.concatenate(single), np.concatenate(alone)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers from each ``low`` up to its ``high``, one range after another."""
    size = (high - low).astype(np.int64)
    if not size.sum():
        return np.zeros(0, dtype=np.int64)
    return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def sums(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points nearest to each entry; whole nodes give the difference of two running sums."""
    whole, to, single, alone = settle(points, nodes, entries)
    running = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points, axis=0)))
    count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
    low, high = nodes["low"][whole], nodes["high"][whole]
    np.add.at(count, to, high - low)
    np.add.at(total, to, running[high] - running[low])
    np.add.at(count, alone, 1)
    np.add.at(total, alone, points[single])
    return count, total


def codes(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entry of every point, in the order of the tree."""
    whole, to, single, alone = settle(points, nodes, entries)
    out = np.zeros(len(points), dtype=np.int64)
    low, high = nodes["low"][whole], nodes["high"][whole]
    out[ranges(low, high)] = np.repeat(to, high - low)
    out[single] = alone
    return out


def trees_of(width: int, parts: int, block: int, schema: pa.Schema):
    """Task function: rows (vec_id, label, whole) to one row per block, with its points and trees."""

    def row(rows: pa.Table) -> pa.RecordBatch:
        points = np.stack(rows.column("whole").to_numpy()).astype("i4").reshape(len(rows), parts, width)
        grown = [grow(points[:, p].astype(np.int64)) for p in range(parts)]
        trees = [o.tobytes() for o, _ in grown], [n.tobytes() for _, n in grown]
        values = [rows.column("vec_id").to_pylist(), rows.column("label").to_pylist(), points.tobytes(), *trees]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema)], schema=schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= block:
                rows = pa.concat_tables(held)
                full = len(rows) // block * block
                for low in range(0, full, block):
                    yield row(rows.slice(low, block))
                held = [rows.slice(full)]
        if sum(map(len, held)):
            yield row(pa.concat_tables(held))

    return of


def unpacked(row, width: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part position, order, points in that order and nodes of every tree of a block."""
    points = np.frombuffer(row.points, dtype="i4").reshape(-1, parts, width)
    for p in range(parts):
        order = np.frombuffer(row.orders[p], dtype="i4")
        yield p, order, points[order, p].astype(np.int64), np.frombuffer(row.trees[p], dtype=NODE)


def improved(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that no part is nearest to stays.

    Tasks add up what their trees give and send one row per component of the codebooks.
    """
    parts, entries, width = book.shape

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        for batch in batches:
            for row in batch.itertuples(index=False):
                for p, _, points, nodes in unpacked(row, width, parts):
                    n, s = sums(points, nodes, book[p])
                    count[p] += n
                    total[p] += s
        at = np.indices(book.shape).reshape(3, -1)
        yield pd.DataFrame({"part": at[0], "entry": at[1], "dim": at[2], "n": np.repeat(count.ravel(), width), "s": total.ravel()})

    rows = blocks.select("points", "orders", "trees").mapInPandas(gather, "part long, entry long, dim long, n long, s long")
    rows = rows.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = book.copy()
    for r in rows.filter("n > 0").collect():
        out[r["part"], r["entry"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def coded(blocks: DataFrame, book: np.ndarray, schema: T.StructType) -> DataFrame:
    """vec_id, label, code and error of every vector of the blocks."""
    parts, _, width = book.shape
    fields = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                ids, labels = row.column("vec_ids").flatten(), row.column("labels").flatten()
                code, error = np.zeros((len(ids), parts), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
                for p, order, points, nodes in unpacked(next(row.select(["points", "orders", "trees"]).to_pandas().itertuples(index=False)), width, parts):
                    to = codes(points, nodes, book[p])
                    code[order, p] = to
                    error[order] += lengths(points - book[p][to])
                texts = ["".join(f"{c:02x}" for c in line) for line in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, type=pa.string()), pa.array(error)], schema=fields)

    return blocks.mapInArrow(of, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, code, error) and the codebooks: parts x entries x width.

    Only the codebooks, whose size is fixed, pass through the driver; no vector is shuffled.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    label = vectors.schema["label"].dataType
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("e")).filter("e is not null")
    kept = kept.filter("forall(e, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    sizes = kept.filter(f"size(e) > 0 and size(e) % {parts} = 0").groupBy(F.size("e").alias("n")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return uncoded(kept), np.zeros((parts, 0, 0), dtype=np.int64)
    able = F.expr(f"size(e) = {usual['n']} and forall(e, x -> abs(floor(cast(x as double) * 256)) < {1 << LIMIT})")
    whole = kept.filter(able).select("vec_id", "label", F.expr("transform(e, x -> cast(floor(cast(x as double) * 256) as int))").alias("whole"))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    if not first:
        return uncoded(kept), np.zeros((parts, 0, 0), dtype=np.int64)
    width = usual["n"] // parts
    book = np.array([r["whole"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("vec_ids", T.ArrayType(T.LongType())), ("labels", T.ArrayType(label)), ("points", T.BinaryType()),
        ("orders", T.ArrayType(T.BinaryType())), ("trees", T.ArrayType(T.BinaryType())))])
    blocks = written(whole.mapInArrow(trees_of(width, parts, block, to_arrow_schema(schema)), schema))
    for _ in range(rounds):
        book = improved(blocks, book)
    out = T.StructType([T.StructField(n, t) for n, t in (("vec_id", T.LongType()), ("label", label), ("code", T.StringType()), ("error", T.LongType()))])
    return coded(blocks, book, out).unionByName(uncoded(kept.filter(~able))), book


def uncoded(rows: DataFrame) -> DataFrame:
    """Vectors that fit no codebook, without code and error."""
    return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Code and error of every vector: vec_id, code, error, label_error, codebooks_sha256.

    Columns vec_id, embedding and label are read, so others cannot clash. Rows whose vector is null or has a null, NaN or
    infinite component go. Vectors have the most frequent length that ``parts`` divides (ties: the
    longest); others, and those with a component of 2^19 and more in size, keep their row with null
    code and error. Codebooks start from the smallest vec_ids, null last, ties by vector; fewer vectors
    make fewer entries. Equal distances go to the lower index. Rows that repeat a vec_id are coded
    each; null labels are one label, whose error is null if none of its vectors has a code. An empty table
    gives an empty result.
    """
    rows, book = compress(vectors, parts, entries, rounds, block)
    rows = written(rows)
    by = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    return match(rows, by, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
