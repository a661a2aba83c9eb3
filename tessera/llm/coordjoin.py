"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set of shingles has a signature of K coordinates, each the minimum of its shingles
under one hash. A document is posted under every (coordinate, value) pair it has. Two sets of
similarity s share each posting with probability s, so pairs that share fewer than ``matches`` of
them are passed over; what is left is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import match, spare, text_of, without, written
from .simdedup import shingle_hashes

WIDTH, PERCENT, COORDINATES = 3, 85, 64
#: Chance that a pair of exactly the wanted similarity shares fewer postings than required.
LOSS = 1e-6
#: Hashes that are minimised together; they stay in a core's cache.
STRIP = 1 << 15
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 1024


def match_threshold(coordinates: int = COORDINATES, percent: int = PERCENT, loss: float = LOSS) -> int:
    """Most matches that a pair of similarity ``percent`` misses with a chance of at most ``loss``."""
    s, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * s**m * (1 - s) ** (coordinates - m)
        if below > loss:
            return m
    return coordinates


@cache
def multipliers(coordinates: int) -> np.ndarray:
    """One odd 64-bit multiplier for each coordinate; multiplying by it permutes the hashes."""
    return np.array([xxhash.xxh64_intdigest(f"coordinate {k}") | 1 for k in range(coordinates)], dtype=np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; they stand for the shingles from here on."""
    return np.unique(shingle_hashes(text.encode().lower().split(), width))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Minimum of every set under every coordinate's hash; sets must not be empty."""
    out = np.full((len(sets), coordinates), np.iinfo(np.uint64).max, dtype=np.uint64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(size)
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for low in range(0, len(every), STRIP):
        strip = every[low : low + STRIP]
        first = int(np.searchsorted(ends, low, side="right"))
        last = int(np.searchsorted(ends, low + len(strip) - 1, side="right"))
        starts = np.maximum(ends[first : last + 1] - size[first : last + 1] - low, 0)
        for k, by in enumerate(multipliers(coordinates)):
            here = out[first : last + 1, k]
            np.minimum(here, np.minimum.reduceat(strip * by, starts), out=here)
    return out


def sketch(text: Column, width: int, coordinates: int) -> Column:
    """Size of the set, two halves of its 128-bit hash, its postings, and one byte of each."""

    @F.pandas_udf("n long, key_a long, key_b long, postings array<long>, marks binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), 2), dtype=np.uint64)
        posted: list = [None] * len(sets)
        marks: list = [b""] * len(sets)
        for i, row in zip(full, signatures([sets[i] for i in full], coordinates)):
            whole = xxhash.xxh3_128_intdigest(sets[i].tobytes())
            keys[i] = whole & (2**64 - 1), whole >> 64
            posted[i] = row.view(np.int64)
            marks[i] = (row >> np.uint64(8)).astype(np.uint8).tobytes()
        size = np.array([len(s) for s in sets], dtype=np.int64)
        return pd.DataFrame({"n": size, "key_a": keys[:, 0].view(np.int64), "key_b": keys[:, 1].view(np.int64), "postings": posted, "marks": marks})

    return of(text)


def agreeing(left: np.ndarray, right: np.ndarray, matches: int, step: int = 16) -> np.ndarray:
    """Rows of two matrices of marks that agree in at least ``matches`` places.

    The postings are merged ``step`` at a time; a row that cannot reach ``matches`` with those left
    is skipped from there on. A mark is a byte of the posting, so no true match is missed.
    """
    alive, count = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for low in range(0, left.shape[1], step):
        count += (left[alive, low : low + step] == right[alive, low : low + step]).sum(axis=1)
        can = count + max(0, left.shape[1] - low - step) >= matches
        alive, count = alive[can], count[can]
    return alive


def alike(sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar at all."""
    return 100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two full sets, ascending and distinct."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def postings_table(nodes: DataFrame, matches: int, coordinates: int) -> DataFrame:
    """Prefix of every node that can have a link: node, prefix (postings, rarest first).

    Only postings that two nodes have count. A node with fewer than ``matches`` of them has no link.
    In the order (count, posting) two nodes that share ``matches`` postings share one among
    their first ``coordinates - matches + 1``, those that nobody shares included.
    """
    posts = nodes.select("node", F.explode("postings").alias("posting"))
    shared = written(posts.groupBy("posting").agg(F.count("*").alias("many")).filter("many > 1"))
    held = posts.join(shared, "posting").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "posting"))).alias("held"))
    return held.filter(F.size("held") >= matches).select("node", F.expr(f"slice(held, 1, size(held) - {matches} + 1).posting").alias("prefix"))


def buckets_of(posts: DataFrame) -> DataFrame:
    """One row per posting under which two or more nodes meet: posting, leader (its smallest node), many.

    Of postings with the same nodes one stays: a pair that meets there is compared once.
    """
    met = posts.groupBy("posting").agg(
        F.count("*").alias("many"), F.min("node").alias("leader"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"),
    )
    return met.filter("many > 1").groupBy("many", "leader", "s", "x").agg(F.min("posting").alias("posting")).select("posting", "leader", "many")


def sieve(rows: DataFrame, hashes: str, wanted: DataFrame, words: int = 1 << 18) -> DataFrame:
    """Rows whose long column ``hashes`` may be among those of ``wanted``: all that are, and few others.

    A bitmap of ``words`` times 64 bits, so a broadcast of at most ``words`` rows of two numbers at any size of
    ``wanted``. It only spares rows a shuffle; the join behind it decides.
    """
    word, bit = spare(rows, "_word", "_bits")
    at = lambda c: F.pmod(F.shiftright(F.col(c), 6), F.lit(words))
    one = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    bits = wanted.groupBy(at(hashes).alias(word)).agg(F.bit_or(one(hashes)).alias(bit))
    out = rows.withColumn(word, at(hashes)).join(F.broadcast(bits), word)
    return out.filter(F.col(bit).bitwiseAND(one(hashes)) != 0).drop(word, bit)


def close(pairs: DataFrame, info: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and that share enough postings."""

    @F.pandas_udf("boolean")
    def near(n_a: pd.Series, marks_a: pd.Series, n_b: pd.Series, marks_b: pd.Series) -> pd.Series:
        out = alike(n_a.to_numpy(), n_b.to_numpy(), percent)
        at = np.flatnonzero(out)
        matrix = [np.frombuffer(b"".join(m.iloc[at]), dtype=np.uint8).reshape(len(at), -1) for m in (marks_a, marks_b)]
        out[:] = False
        if len(at):
            out[at[agreeing(*matrix, matches)]] = True
        return pd.Series(out)

    both = pairs.join(_side(info, "a", "n", "marks"), "a").join(_side(info, "b", "n", "marks"), "b")
    return both.filter(near("n_a", "marks_a", "n_b", "marks_b")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(a, b)])

    both = written(pairs).join(_side(sets, "b", "hashes"), "b").join(_side(sets, "a", "hashes"), "a")
    return written(both.filter(same("hashes_a", "hashes_b")).select("a", "b"))


def _side(table: DataFrame, at: str, *columns: str) -> DataFrame:
    return table.select(F.col("node").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in columns])


def cells(rest: DataFrame, block: int) -> DataFrame:
    """Rows (posting, cell) of buckets whose nodes are not all joined yet.

    A bucket's largest component is set apart, as its nodes need no comparison with each other. Its
    blocks meet every block of the other nodes, and these meet each other, so every pair of
    different components meets in some cell of at most two blocks.
    """
    sizes = rest.groupBy("posting", "root").agg(F.count("*").alias("k")).groupBy("posting")
    main = written(sizes.agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("k")).select(
        "posting", F.col("m.root").alias("main"), F.ceil(F.col("m.k") / block).cast("int").alias("mains"), F.ceil((F.col("k") - F.col("m.k")) / block).cast("int").alias("others")))
    part = "cast(pmod(xxhash64(node, 7), if(root = main, mains, others)) as int)"
    cell = f"""if(root = main,
        transform(sequence(0, others - 1), o -> concat_ws('-', 'm', {part}, o)),
        concat(transform(sequence(0, mains - 1), m -> concat_ws('-', 'm', m, {part})),
               transform(sequence(0, others - 1), o -> concat_ws('-', 'o', least(o, {part}), greatest(o, {part})))))"""
    return rest.join(main, "posting").withColumn("cell", F.explode(F.expr(cell))).select("posting", "cell", "node", "root")


def candidates(rows: pd.DataFrame, matches: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a cell that are not joined yet and share enough postings."""
    size, root = rows["n"].to_numpy(), rows["root"].to_numpy()
    marks = np.frombuffer(b"".join(rows["marks"]), dtype=np.uint8).reshape(len(rows), -1)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(len(rows) - 1):
        at = np.flatnonzero((root[i + 1 :] != root[i]) & alike(size[i + 1 :], size[i], percent)) + i + 1
        at = at[agreeing(np.broadcast_to(marks[i], (len(at), marks.shape[1])), marks[at], matches)]
        left.append(np.full(len(at), i))
        right.append(at)
    return np.concatenate(left), np.concatenate(right)


def cell_pairs(matches: int, percent: int, dense: int = 4):
    """Task function for a cell: its candidate pairs, or, if these are more than ``dense`` for a node, its nodes (b null)."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = candidates(rows, matches, percent)
        node, none = rows["node"].to_numpy(), len(rows) * dense < len(i)
        out = pd.DataFrame({"a": node if none else node[i], "b": None if none else node[j]}).astype("Int64")
        out["posting"], out["cell"] = (rows[c].iloc[0] if none else None for c in ("posting", "cell"))
        return out.astype({"posting": "Int64"})

    return of


def overlaps(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets, by products of incidence matrices of the members that several share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, member, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = many[member] > 1
    row, member = row[keep], np.unique(member[keep], return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        a, b = np.searchsorted(member, [low, low + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[a:b], member[a:b] - low] = 1
        out += m @ m.T
    return out


def cell_links(matches: int, percent: int):
    """Task function for a dense cell: links that join what is linked there, from the full sets; joined pairs are skipped."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        size, root = rows["n"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(h, dtype=np.uint64) for h in rows["hashes"]]
        node, common = rows["node"].to_numpy(), overlaps(sets)
        i, j = candidates(rows, matches, percent)
        real = 100 * common[i, j].astype(np.int64) >= percent * (size[i] + size[j] - common[i, j].astype(np.int64))
        left, right = [], []
        for a, b in zip(i[real].tolist(), j[real].tolist()):
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                left.append(node[a])
                right.append(node[b])
        return pd.DataFrame({"a": left, "b": right}, dtype="int64")

    return of


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n (set size) and component_id of every row of ``docs``.

    Equal sets are one node. First every node is compared with the smallest node of each of its
    buckets, which joins most groups of copies with one comparison a node; then only
    buckets that still hold several components are compared in full, in cells of bounded size. Their candidate pairs are few, as
    a rule, and confirmed like the first; a cell that is dense with them gets the sets of its nodes instead.
    """
    matches = match_threshold(coordinates, percent)
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), sketch(text_of(), width, coordinates).alias("s"))
    rows = written(rows.select("doc_id", "text_hash", "s.*"))
    nodes = rows.filter("n > 0").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("postings").alias("postings"), F.first("marks").alias("marks"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    prefixes = written(postings_table(nodes, matches, coordinates))
    info = written(prefixes.select("node").join(nodes.select("node", "n", "marks", "one"), "node"))
    posts = prefixes.select("node", F.explode("prefix").alias("posting"))
    buckets = written(buckets_of(posts))
    posts = written(posts.join(buckets, "posting").select("posting", "node", "leader", "many"))

    texts = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hashes = F.pandas_udf(lambda t: t.map(lambda x: shingle_set(x, width).tobytes()), "binary")
    wanted = info.select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"))
    sets = match(sieve(texts, "text_hash", wanted), wanted, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
    sets = written(sets.select("node", hashes("text").alias("hashes")))

    first = posts.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = confirmed(close(first, info, matches, percent), sets, percent)
    found = written(components(info.select(F.col("node").alias("v")), near))
    open_ = written(posts.filter("many > 2").join(found.select(F.col("v").alias("node"), "root"), "node").select("posting", "node", "root"))
    mixed = written(open_.groupBy("posting").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("posting"))
    split = written(cells(open_.join(mixed, "posting", "left_semi"), block))
    marked = split.join(info.select("node", "n", "marks"), "node").groupBy("posting", "cell")
    pairs = written(marked.applyInPandas(cell_pairs(matches, percent), "a long, b long, posting long, cell string"))
    sparse = confirmed(pairs.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent)
    crowd = split.join(pairs.filter("b is null").select("posting", "cell").distinct(), ["posting", "cell"], "left_semi")
    crowd = crowd.join(info.select("node", "n", "marks"), "node").join(sets, "node").groupBy("posting", "cell")
    dense = written(crowd.applyInPandas(cell_links(matches, percent), "a long, b long"))
    more = sparse.unionByName(dense).distinct()
    roots = components(nodes.select(F.col("node").alias("v")), near.unionByName(more))
    roots = written(roots.join(nodes.select(F.col("node").alias("v"), "key_a", "key_b", "least"), "v"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    member = written(roots.join(names, "root").select("key_a", "key_b", "component_id"))
    out = rows.join(member.withColumnsRenamed({"key_a": "_a", "key_b": "_b"}), (F.col("n") > 0) & (F.col("key_a") == F.col("_a")) & (F.col("key_b") == F.col("_b")), "left")
    return out.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def link_table(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """Set size and component of every document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is
    ``percent`` or more. Null texts are empty; texts without words have an empty set, are linked with
    nothing and kept. Very long texts are hashed whole. Rows that repeat a ``doc_id`` are rows of
    their own; with equal texts they are in one component and all kept if it has their id. A null ``doc_id``
    names a component only if it has no other; ties go to the smallest id. Only ``doc_id`` and ``text`` are
    read, so other columns cannot clash. An empty table gives an empty result.
    """
    out = linked(docs, width, percent, coordinates, block)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that :func:`link_table` does not keep, its columns unchanged."""
    mark, = spare(docs, "text_hash")
    gone = linked(docs, width, percent).filter("not (doc_id <=> component_id)").select("doc_id", F.col("text_hash").alias(mark))
    return without(docs.withColumn(mark, F.xxhash64(text_of())), gone, long=True).drop(mark)
