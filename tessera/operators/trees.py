"""Rooted trees and geometry: nodes ``(cell, n, parent, x, y, z)``, path points ``(cell, path_id, j, x, y, z)``.

Chains are followed by pointer jumping, so deep trees take rounds in the logarithm of their depth.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, IntegralType, LongType, StringType, StructField, StructType

from ..plans.near import nearest_point
from ..plans.quantile import quantiles
from ..plans.scan import group_sizes, is_hot, scan, task_rows
from ..plans.stats import join_stats, nz
from ..session import durable, once, written
from .joins import locate_on_path
from .series import with_neighbours
from .stats import bin_index


def _dist(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def xyz(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{a}{suffix}") for a in "xyz"]


def dedupe_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct edges ``(u, v)``, u < v, after nodes at one position became the one with the smallest number."""
    same = nodes.groupBy(*keys, "x", "y", "z").agg(F.min("n").alias("_rep"))
    rep = nodes.join(same, [*keys, "x", "y", "z"]).select(*keys, "n", "_rep")
    e = nodes.filter(F.col("parent") >= 0).select(*keys, "n", "parent")
    e = e.join(rep, [*keys, "n"]).select(*keys, F.col("_rep").alias("_a"), F.col("parent").alias("n"))
    e = e.join(rep, [*keys, "n"]).select(*keys, F.least("_a", "_rep").alias("u"), F.greatest("_a", "_rep").alias("v"))
    return e.filter("u != v").distinct()


def edge_lengths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the edge from every node to its parent."""
    p = nodes.select(*keys, F.col("n").alias("parent"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    d = nodes.join(p, [*keys, "parent"])
    return d.select(*keys, "n", "parent", _dist(xyz(), xyz("p")).alias("length"))


def _doublings(links: DataFrame, keys: list[str]) -> int:
    """Rounds after which every chain has been followed to its end, unless it is a circle."""
    longest = links.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return int(longest).bit_length() + 1


def follow(links: DataFrame, keys: list[str]) -> DataFrame:
    """Last element and number of steps of the chain from each ``id`` along ``ptr`` (null ends it)."""
    d = links.select(*keys, "id", F.coalesce("ptr", "id").alias("head"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    d = durable(d)
    for _ in range(_doublings(d, keys)):
        o = d.select(*keys, F.col("id").alias("head"), F.col("head").alias("_h"), F.col("steps").alias("_s"))
        d = durable(d.join(o, [*keys, "head"]).select(*keys, "id", F.col("_h").alias("head"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("_s") > 0).alias("_go")))
        if d.filter("_go").isEmpty():
            return d.drop("_go")
        d = d.drop("_go")
    raise RuntimeError("the links contain a cycle")


def chain_totals(links: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Number of ancestors (``steps``) of every ``id`` and the sum of their ``weight`` (``total``).

    The reach doubles each round and a row is all an id carries, so there are as many rows as ids. Rows whose chain
    has ended take no part in the join but as its targets, so their null pointers do not meet in one task. Rounds are
    written, not checkpointed: a checkpoint keeps the size that the planner guessed, which squares with every join.
    """
    w = F.col(weight) if weight else F.lit(0.0)
    above = links.select(*keys, F.col("id").alias("ptr"), w.cast("double").alias("_w"))
    d = links.select(*keys, "id", "ptr").join(above.hint("merge"), [*keys, "ptr"], "left")
    d = written(d.select(*keys, "id", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("_w", F.lit(0.0)).alias("total")))
    for _ in range(_doublings(d, keys)):
        going = d.filter("ptr is not null")
        if going.isEmpty():
            return d.drop("ptr")
        o = d.select(*keys, F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("steps").alias("_s"), F.col("total").alias("_t"))
        going = going.join(o.hint("merge"), [*keys, "ptr"], "left")
        going = going.select(*keys, "id", F.col("_p").alias("ptr"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"))
        d = written(d.filter("ptr is null").unionByName(going))
    raise RuntimeError("the links contain a cycle")


def subtree_sizes(links: DataFrame, keys: list[str]) -> DataFrame:
    """Number of nodes at or below every ``id`` (``size``).

    After k rounds a node knows how many are less than 2^k steps below it and points 2^k steps up. Each round it adds what
    those pointing to it know, so the rounds are as many as the depth has binary digits, with a row a node.
    """
    d = written(links.select(*keys, "id", "ptr", F.lit(1).cast("long").alias("size")))
    for _ in range(_doublings(d, keys)):
        going = d.filter("ptr is not null")
        if going.isEmpty():
            return d.drop("ptr")
        below = going.groupBy(*keys, F.col("ptr").alias("id")).agg(F.sum("size").alias("_more"))
        o = d.filter("ptr is not null").select(*keys, F.col("id").alias("_at"), F.col("ptr").alias("_p"))
        ahead = going.select(*keys, "id", F.col("ptr").alias("_at")).join(o.hint("merge"), [*keys, "_at"]).select(*keys, "id", "_p")
        d = d.select(*keys, "id", "size").join(below.hint("merge"), [*keys, "id"], "left").join(ahead.hint("merge"), [*keys, "id"], "left")
        d = written(d.select(*keys, "id", F.col("_p").alias("ptr"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
    raise RuntimeError("the links contain a cycle")


class Grown:
    """A result that grows by one table a round.

    Tables of like size are put together as in a binary counter, so a row is rewritten a
    logarithmic number of times, not once a round.
    """

    def __init__(self, empty: DataFrame):
        self.empty, self.parts = empty, []

    def add(self, part: DataFrame) -> None:
        self.parts.append((0, part))
        while len(self.parts) > 1 and self.parts[-1][0] == self.parts[-2][0]:
            size, last = self.parts.pop()
            self.parts[-1] = (size + 1, durable(self.parts[-1][1].unionByName(last)))

    def all(self) -> DataFrame:
        out = self.empty
        for _, part in self.parts:
            out = out.unionByName(part)
        return out


def split_paths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Unbranched paths between branch points as points in order from the root side.

    A path is named by its first node after the branch point; position 0 is that branch point.
    """
    kids = nodes.filter(F.col("parent") >= 0).groupBy(*keys, F.col("parent").alias("n")).agg(F.count("*").alias("_kids"))
    inner = nodes.join(kids.filter("_kids = 1"), [*keys, "n"], "left_semi").filter(F.col("parent") >= 0)
    inner = inner.select(*keys, F.col("n").alias("parent"), F.lit(True).alias("_in"))
    e = nodes.filter(F.col("parent") >= 0).join(inner, [*keys, "parent"], "left")
    links = e.select(*keys, F.col("n").alias("id"), F.when(F.col("_in"), F.col("parent")).alias("ptr"))
    at = follow(links, keys).select(*keys, F.col("id").alias("n"), F.col("head").alias("path_id"), (F.col("steps") + 1).alias("j"))
    first = nodes.filter(F.col("parent") >= 0).join(at.filter("n = path_id").select(*keys, "n"), [*keys, "n"], "left_semi")
    first = first.select(*keys, F.col("parent").alias("n"), F.col("n").alias("path_id"), F.lit(0).cast("long").alias("j"))
    pts = at.unionByName(first)
    return pts.join(nodes.select(*keys, "n", "x", "y", "z"), [*keys, "n"]).select(*keys, "path_id", "j", "n", "x", "y", "z")


def path_parents(points: DataFrame, keys: list[str]) -> DataFrame:
    """Path each path connects to: the one whose last node is its first; null at the root."""
    last = points.groupBy(*keys, "path_id").agg(F.max_by("n", "j").alias("n")).withColumnRenamed("path_id", "connect_to")
    first = points.filter("j = 0").select(*keys, "path_id", "n")
    return first.join(last, [*keys, "n"], "left").select(*keys, "path_id", "connect_to")


def orient_paths(paths: DataFrame, soma: DataFrame, keys: list[str]) -> DataFrame:
    """Direct paths ``(path_id, a, b)`` away from the soma node and record what each connects to.

    One round per level of branching: paths touching an end reached before are turned towards it.
    Paths no round reaches are loose and missing in the result, which is empty if that holds for all.
    """
    todo = durable(paths.select(*keys, "path_id", "a", "b"))
    of = paths.schema["path_id"].dataType
    done = Grown(todo.limit(0).select(*keys, "path_id", F.col("a").alias("start"), F.col("b").alias("end"), F.lit(0).alias("reversed"), F.lit(None).cast(of).alias("connect_to"), F.lit(0).alias("level")))
    front = soma.select(*keys, F.col("n").alias("_at"), F.lit(None).cast(paths.schema["path_id"].dataType).alias("_from"))
    # A level that reaches no new path is the last; every other one takes paths away.
    level = 0
    while True:
        hit_a = todo.join(front, todo_on(keys, todo, front, "a"), "inner").select(*[todo[k] for k in keys], "path_id", F.col("a").alias("start"), F.col("b").alias("end"), F.lit(0).alias("reversed"), "_from")
        hit_b = todo.join(front, todo_on(keys, todo, front, "b"), "inner").select(*[todo[k] for k in keys], "path_id", F.col("b").alias("start"), F.col("a").alias("end"), F.lit(1).alias("reversed"), "_from")
        new = hit_a.unionByName(hit_b).groupBy(*keys, "path_id").agg(F.min(F.struct("reversed", "start", "end", "_from")).alias("_m"))
        new = durable(new.select(*keys, "path_id", "_m.start", "_m.end", "_m.reversed", F.col("_m._from").alias("connect_to"), F.lit(level).alias("level")))
        if new.isEmpty():
            return done.all()
        done.add(new)
        todo = durable(todo.join(new.select(*keys, "path_id"), [*keys, "path_id"], "left_anti"))
        front = new.groupBy(*keys, F.col("end").alias("_at")).agg(F.min("path_id").alias("_from"))
        level += 1


def todo_on(keys: list[str], a: DataFrame, b: DataFrame, end: str) -> Column:
    cond = a[end] == b["_at"]
    for k in keys:
        cond = cond & (a[k] == b[k])
    return cond


def _attachment_schema(loose: DataFrame, keys: list[str], path_type: DataType, node_type: DataType) -> StructType:
    names = [*[(k, loose.schema[k].dataType) for k in keys], ("path_id", loose.schema["path_id"].dataType), ("attach_to", node_type), ("to_path", path_type), ("to_part", IntegerType())]
    names += [("at_j", LongType()), ("by_j", LongType()), ("dist", DoubleType()), ("split", BooleanType())]
    return StructType([StructField(n, t) for n, t in names])


def _tree_tails(tree: DataFrame, keys: list[str], path_type: DataType) -> DataFrame:
    """The last point of every tree path and the number of its points; points without a path are paths of their own."""
    if "path_id" not in tree.columns:
        tree = tree.withColumns({"path_id": F.col("n"), "j": F.lit(0)})
    last = F.max_by(F.struct("n", "x", "y", "z"), "j").alias("_m")
    d = tree.groupBy(*keys, F.col("path_id").cast(path_type).alias("to_path")).agg(last, (F.max("j") + 1).cast("long").alias("at_j"))
    return d.select(*keys, "to_path", F.lit(0).alias("to_part"), "at_j", "_m.*")


def reconnect_paths(tree: DataFrame, loose: DataFrame, keys: list[str], local: int = 20_000) -> DataFrame:
    """Attach loose paths to the tails of the tree, always the nearest one of a cell first.

    ``loose`` has path points ``(path_id, j, n, x, y, z)``, j from 0 without gaps; ``tree`` has the same, or only
    points ``(n, x, y, z)`` that are paths of their own. A loose path hangs by its vertex nearest to
    any tail. By an end it continues the tail's path, whose tail is then its other end. By an inner
    vertex it is split there: the tail's path is bridged to that vertex, and two new paths start from
    it, whose ends are tails from then on. One row per loose path: the node ``attach_to`` that was the tail, its path
    (``to_path``, ``to_part``; part 0 is the path itself, 1 and 2 are the halves of a split one), the
    number of points that path had (``at_j``), the vertex ``by_j``, the distance, and whether it was split. Ties go to the smallest
    path, then tail, then vertex. Loose paths of a cell without a tree hang on nothing; without loose paths the result is empty.

    Cells of up to ``local`` points are grown in one task each. In larger ones a round attaches, besides
    the nearest, every loose path that is its tail's nearest and nearer to it than to any other loose
    path: what happens before its turn takes place out of its reach, so the order does not matter.
    """
    loose = once(loose.select(*keys, "path_id", F.col("j").cast("long").alias("j"), "n", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    own = loose.schema["path_id"].dataType
    if "path_id" in tree.columns and tree.schema["path_id"].dataType == own:
        path_type = own
    else:
        whole = isinstance(own, IntegralType) and isinstance(tree.schema["path_id" if "path_id" in tree.columns else "n"].dataType, IntegralType)
        path_type = LongType() if whole else StringType()
    schema = _attachment_schema(loose, keys, path_type, tree.schema["n"].dataType)
    tails = written(_tree_tails(tree.withColumns({c: F.col(c).cast("double") for c in "xyz"}), keys, path_type))
    sizes = loose.groupBy(*keys).agg(F.count("*").alias("_p")).join(tails.groupBy(*keys).agg(F.count("*").alias("_t")), keys, "left")
    sizes = once(sizes.withColumn("_t", F.coalesce("_t", F.lit(0))))
    local = min(local, task_rows(loose))
    bare = loose.join(sizes.filter("_t = 0"), keys, "left_semi").select(*keys, "path_id").distinct()
    gaps = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(keys) + 1 :]]
    large = sizes.filter((F.col("_t") > 0) & ((F.col("_p") > local) | (F.col("_p") * F.col("_t") > local * 2500)))
    small = sizes.filter("_t > 0").join(large, keys, "left_anti")
    grow = _grower(keys, schema)
    pieces = loose.join(small, keys, "left_semi").groupBy(*keys).cogroup(tails.join(small, keys, "left_semi").groupBy(*keys)).applyInPandas(grow, schema)
    out = Grown(bare.select("*", *gaps))
    out.add(pieces)
    tails, todo = durable(tails.join(large, keys, "left_semi")), durable(loose.join(large, keys, "left_semi"))
    while not todo.isEmpty():
        new = durable(_round(tails, todo, keys).select(*schema.names))
        out.add(new)
        tails = durable(_next_tails(tails, todo, new, keys))
        todo = durable(todo.join(new.select(*keys, "path_id"), [*keys, "path_id"], "left_anti"))
    return out.all()


def _round(tails: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """Attachments of the loose paths whose place is final."""
    pk, axes = [*keys, "path_id"], ["x", "y", "z"]
    near = nearest_point(todo, tails, [*pk, "j"], axes, "n", keys=keys)
    best = near.groupBy(*pk).agg(F.min(F.struct("dist", "n", "j")).alias("_m")).select(*pk, "_m.*")
    best = written(best)
    # Tails at one place are one target: the nearest loose path of that place goes first.
    at = tails.select(*keys, "n", *[F.col(a).alias(f"t{a}") for a in axes])
    best = written(best.join(at, [*keys, "n"]))
    turn = best.groupBy(*keys, "tx", "ty", "tz").agg(F.min(F.struct("dist", "path_id")).alias("_f")).select(*keys, F.col("_f.path_id").alias("path_id"))
    mine = todo.join(best.join(turn, pk, "left_semi").select(*pk, F.col("dist").alias("_d")), pk)
    close = nearest_point(mine, todo, [*pk, "j"], axes, "n", keys=keys, other="path_id", within="_d").select(*pk).distinct()
    first = best.groupBy(*keys).agg(F.min(F.struct("dist", "path_id")).alias("_f")).select(*keys, F.col("_f.path_id").alias("path_id"))
    free = turn.join(close, pk, "left_anti").unionByName(first).distinct()
    pick = best.join(free, pk, "left_semi")
    ends = todo.groupBy(*pk).agg(F.max("j").alias("_last"))
    pick = pick.join(ends, pk).join(tails.select(*keys, "n", "to_path", "to_part", "at_j"), [*keys, "n"])
    inner = (F.col("j") > 0) & (F.col("j") < F.col("_last"))
    return pick.select(*pk, F.col("n").alias("attach_to"), "to_path", "to_part", "at_j", F.col("j").alias("by_j"), "dist", inner.alias("split"))


def _next_tails(tails: DataFrame, todo: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Tails after a round: the hit paths' moved, two more for every split path."""
    path_type = new.schema["to_path"].dataType
    d = join_stats(todo.join(new, [*keys, "path_id"]), [*keys, "path_id"], _last=F.max("j"))
    at, gap = F.col("j"), (F.col("dist") > 0).cast("long")
    end = F.when(F.col("by_j") == 0, F.col("_last")).otherwise(F.lit(0).cast("long"))
    moved = d.filter((F.col("split") & (at == F.col("by_j"))) | (~F.col("split") & (at == end)))
    # A bridged path gains the vertex, a continued one all points; a vertex that lies on the tail is not a new point.
    gain = F.when(F.col("split"), gap).otherwise(F.col("_last") + gap)
    stays = F.col("split") | (F.col("_last") == 0)
    node = F.when(stays & (F.col("dist") == 0), F.col("attach_to")).otherwise(F.col("n").cast(new.schema["attach_to"].dataType))
    moved = moved.select(*keys, "to_path", "to_part", (F.col("at_j") + gain).alias("at_j"), node.alias("n"), "x", "y", "z")
    halves = d.filter(F.col("split") & at.isin(0) | F.col("split") & (at == F.col("_last")))
    halves = halves.select(*keys, F.col("path_id").cast(path_type).alias("to_path"), F.when(at == 0, 1).otherwise(2).alias("to_part"), F.when(at == 0, F.col("by_j") + 1).otherwise(F.col("_last") - F.col("by_j") + 1).alias("at_j"), F.col("n").cast(new.schema["attach_to"].dataType).alias("n"), "x", "y", "z")
    kept = tails.join(new.select(*keys, "to_path", "to_part"), [*keys, "to_path", "to_part"], "left_anti")
    return kept.unionByName(moved).unionByName(halves)


def _grower(keys: list[str], schema: StructType):
    """Task function for one cell: the same growth, one loose path after another."""

    def grow(loose: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
        loose = loose.sort_values(["path_id", "j"], kind="stable", ignore_index=True)
        points, nodes = loose[["x", "y", "z"]].to_numpy(float), loose["n"].to_numpy()
        paths, starts = np.unique(loose["path_id"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(loose)) - 1
        room = len(tails) + 2 * len(paths)
        pos, name, count = np.full((room, 3), np.inf), [None] * room, len(tails)
        pos[:count] = tails[["x", "y", "z"]].to_numpy(float)
        number = np.full(room, np.iinfo(np.int64).max)
        number[:count] = tails["n"].to_numpy()
        name[:count] = list(zip(tails["to_path"].tolist(), tails["to_part"].tolist(), tails["at_j"].tolist()))
        dist, slot = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int64)

        def nearest(of: np.ndarray) -> None:
            """Best tail of some points among all."""
            for part in np.array_split(of, max(1, len(of) * count // 2_000_000)):
                if len(part):
                    d = _apart(points[part], pos[:count])
                    dist[part] = d.min(axis=1)
                    slot[part] = np.where(d == dist[part][:, None], number[:count], np.iinfo(np.int64).max).argmin(axis=1)

        open_ = np.ones(len(points), dtype=bool)
        nearest(np.arange(len(points)))
        rows = []
        for _ in range(len(paths)):
            reach = np.minimum.reduceat(np.where(open_, dist, np.inf), starts)
            p = int(reach.argmin())
            a, b = starts[p], ends[p]
            here = np.flatnonzero(dist[a : b + 1] == reach[p]) + a
            v = int(here[number[slot[here]].argmin()])
            s, inner, gap = int(slot[v]), a < v < b, int(reach[p] > 0)
            path, part, size = name[s]
            rows.append((paths[p], number[s], path, part, size, v - a, float(reach[p]), inner))
            open_[a : b + 1] = False
            new = [s]
            if inner:
                to = paths[p] if not isinstance(path, str) else str(paths[p])
                pos[s], name[s] = points[v], (path, part, size + gap)
                number[s] = nodes[v] if gap else number[s]
                for at, half, length in ((a, 1, v - a + 1), (b, 2, b - v + 1)):
                    pos[count], number[count], name[count] = points[at], nodes[at], (to, half, length)
                    new.append(count)
                    count += 1
            else:
                end = b if v == a else a
                pos[s], name[s] = points[end], (path, part, size + int(b - a) + gap)
                number[s] = nodes[end] if gap or b > a else number[s]
            lost = np.flatnonzero(open_ & (slot == s))
            rest = np.flatnonzero(open_ & (slot != s))
            for t in new:
                d = _apart(points[rest], pos[t : t + 1])[:, 0]
                won = (d < dist[rest]) | ((d == dist[rest]) & (number[t] < number[slot[rest]]))
                dist[rest[won]], slot[rest[won]] = d[won], t
            nearest(lost)
        out = pd.DataFrame(rows, columns=schema.names[len(keys) :])
        for k in keys:
            out[k] = loose[k].iloc[0]
        return out[schema.names]

    return grow


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``, summed in the order of the axes."""
    d = a[:, None, :] - b[None, :, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def reconnected(tree: DataFrame, loose: DataFrame, attached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The connected paths that :func:`reconnect_paths` describes: points and connections.

    Points: ``(path_id, part, j, n, x, y, z)``. Connections, for the halves of split paths: ``(path_id, part, connect_to,
    connect_part)``, they hang on the path that was bridged to them. Every attachment says where its points go, so this is one join.
    """
    pk, path_type = [*keys, "path_id"], attached.schema["to_path"].dataType
    if "path_id" not in tree.columns:
        tree = tree.withColumns({"path_id": F.col("n"), "j": F.lit(0)})
    old = tree.select(*keys, F.col("path_id").cast(path_type).alias("path_id"), F.lit(0).alias("part"), F.col("j").cast("long").alias("j"), "n", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    d = loose.join(attached.filter("to_path is not null"), pk)
    gap, j = (F.col("dist") > 0).cast("long"), F.col("j").cast("long")
    off = F.abs(j - F.col("by_j"))

    def put(path: Column, part: Column, at: Column) -> Column:
        return F.struct(path.cast(path_type).alias("path_id"), part.cast("int").alias("part"), at.cast("long").alias("j"))

    to = put(F.col("to_path"), F.col("to_part"), F.col("at_j") + off - 1 + gap)
    first, second = put(F.col("path_id"), F.lit(1), F.col("by_j") - j), put(F.col("path_id"), F.lit(2), j - F.col("by_j"))
    # The vertex that lies on the tail is that tail's point already.
    joint = (off == 0) & (gap == 0)
    places = F.when(F.col("split"), F.when(j < F.col("by_j"), F.array(first)).when(j > F.col("by_j"), F.array(second)).when(joint, F.array(first, second)).otherwise(F.array(to, first, second)))
    places = places.otherwise(F.when(joint, F.slice(F.array(to), 1, 0)).otherwise(F.array(to)))
    new = d.withColumn("_to", F.explode(places)).select(*keys, "_to.*", "n", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    halves = attached.filter("split").withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    links = halves.select(*keys, F.col("path_id").cast(path_type).alias("path_id"), "part", F.col("to_path").alias("connect_to"), F.col("to_part").alias("connect_part"))
    return old.unionByName(new), links


def ancestors(links: DataFrame, keys: list[str]) -> DataFrame:
    """All ancestors of every ``id`` with their depth (1 = parent); the reach doubles each round.

    The whole closure, as many rows as all depths together: for a test of pairs see :func:`mark_ancestors`.
    """
    rounds = _doublings(links, keys)
    d = durable(links.filter("ptr is not null").select(*keys, "id", F.col("ptr").alias("anc"), F.lit(1).cast("long").alias("depth")))
    reach = 1
    for _ in range(rounds):
        top = d.filter(F.col("depth") == reach)
        o = d.select(*keys, F.col("id").alias("anc"), F.col("anc").alias("_a"), F.col("depth").alias("_d"))
        more = durable(top.join(o, [*keys, "anc"]).select(*keys, "id", F.col("_a").alias("anc"), (F.col("depth") + F.col("_d")).alias("depth")))
        if more.isEmpty():
            return d
        d = durable(d.unionByName(more))
        reach *= 2
    raise RuntimeError("the links contain a cycle")


def tree_intervals(links: DataFrame, keys: list[str]) -> DataFrame:
    """Entry and exit number of every ``id``: an ancestor's interval holds those of all below it.

    A walk around the tree enters every node once, children in the order of their ids, roots likewise, and after
    these the nodes whose ``ptr`` is no ``id``, as roots of trees of their own. A node is entered after its parent and
    all that is below its earlier siblings, so its number is a sum of such steps along its ancestors: rounds in the
    logarithm of the depth, not of the length of the walk.
    ``enter`` counts the nodes entered before, ``exit`` is the number of the last one entered
    at or below the node, ``size`` how many these are.
    """
    links = once(links.select(*keys, "id", "ptr"))
    # Roots look for themselves, so that their null pointers do not meet in one task.
    known = links.select(*keys, F.col("id").alias("_at"), F.lit(True).alias("_known"))
    links = links.withColumn("_at", F.coalesce("ptr", "id")).join(known.hint("merge"), [*keys, "_at"], "left")
    links = written(links.select(*keys, "id", F.when(F.col("_known"), F.col("ptr")).alias("ptr"), F.col("_known").isNull().alias("_lost")))
    d = links.join(subtree_sizes(links, keys).hint("merge"), [*keys, "id"])
    d = scan(d, [*keys, "ptr"], ["_lost", "id"], _run=("sum", F.col("size")))
    # Steps from the parent, which is entered itself, to the node; roots follow each other.
    step = F.col("_run") - F.col("size") + F.when(F.col("ptr").isNull(), 0).otherwise(1)
    d = written(d.select(*keys, "id", "ptr", "size", step.alias("_step")))
    above = chain_totals(d, keys, "_step").select(*keys, "id", F.col("total").cast("long").alias("_above"))
    enter = F.col("_above") + F.col("_step")
    return d.join(above.hint("merge"), [*keys, "id"]).select(*keys, "id", enter.alias("enter"), (enter + F.col("size") - 1).alias("exit"), "size")


def mark_ancestors(pairs: DataFrame, intervals: DataFrame, keys: list[str], name: str = "is_ancestor") -> DataFrame:
    """Whether ``anc`` lies above ``id``, for each pair; null if one of them is in no tree. No closure is made."""
    a = intervals.select(*keys, F.col("id").alias("anc"), F.col("enter").alias("_a"), F.col("exit").alias("_b"))
    b = intervals.select(*keys, "id", F.col("enter").alias("_e"))
    d = pairs.join(a, [*keys, "anc"], "left").join(b, [*keys, "id"], "left")
    return d.withColumn(name, (F.col("_e") > F.col("_a")) & (F.col("_e") <= F.col("_b"))).select(*pairs.columns, name)


def path_lengths(points: DataFrame, keys: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Length along the path, straight length and, with ``parents``, the branch order."""
    pk = [*keys, "path_id"]
    d = with_neighbours(points.withColumnRenamed("j", "i"), pk, _x=("x", -1), _y=("y", -1), _z=("z", -1))
    step = F.coalesce(_dist(xyz(), xyz("_")), F.lit(0.0))
    at = F.struct("x", "y", "z")
    d = d.groupBy(*pk).agg(F.sum(step).alias("real_length"), F.min_by(at, "i").alias("_a"), F.max_by(at, "i").alias("_b"))
    out = d.select(*pk, "real_length", _dist([F.col(f"_a.{a}") for a in "xyz"], [F.col(f"_b.{a}") for a in "xyz"]).alias("euclidean_length"))
    if parents is None:
        return out
    order = chain_totals(parents.select(*keys, F.col("path_id").alias("id"), F.col("connect_to").alias("ptr")), keys)
    order = order.select(*keys, F.col("id").alias("path_id"), F.col("steps").alias("branch_order"))
    return out.join(order, pk, "left").fillna(0, ["branch_order"])


def distance_to_root(points: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Length along the tree from the root to every path point."""
    pk = [*keys, "path_id"]
    d = with_neighbours(points.withColumnRenamed("j", "i"), pk, _x=("x", -1), _y=("y", -1), _z=("z", -1))
    d = once(d.withColumn("_s", F.coalesce(_dist(xyz(), xyz("_")), F.lit(0.0))).select(*pk, "i", "_s"))
    run = scan(d.select(*pk, "i", "_s"), pk, ["i"], _run=("sum", F.col("_s")))
    whole = d.groupBy(*pk).agg(F.sum("_s").alias("_len"))
    links = parents.select(*keys, "path_id", F.col("connect_to").alias("ptr")).join(whole, pk, "left").withColumnRenamed("path_id", "id")
    above = chain_totals(links, keys, "_len").select(*keys, F.col("id").alias("path_id"), F.col("total").alias("_above"), F.col("steps").alias("_k"))
    r = run.join(above, pk, "left")
    return r.select(*pk, F.col("i").alias("j"), (F.coalesce("_above", F.lit(0.0)) + F.col("_run")).alias("dist"), (F.coalesce("_k", F.lit(0)) + 1).alias("num_paths"))


def point_metrics(rois: DataFrame, points: DataFrame, parents: DataFrame, soma: DataFrame, keys: list[str]) -> DataFrame:
    """Path, vertex, tree and straight distance to the soma, the share of the largest, paths to the soma."""
    at = locate_on_path(rois, points.select(*keys, "path_id", "j", "x", "y", "z"), [*keys, "x", "y", "z"])
    dist = distance_to_root(points, parents, keys)
    far = dist.groupBy(*keys).agg(F.max("dist").alias("_far"))
    d = at.join(dist, [*keys, "path_id", "j"]).join(far, keys).join(soma.select(*keys, *[F.col(a).alias(f"s{a}") for a in "xyz"]), keys)
    return d.select(
        *rois.columns, "path_id", F.col("j").alias("loc_on_path"), F.col("dist").alias("d_dist"), (F.col("dist") / nz(F.col("_far"))).alias("norm_d_dist"),
        _dist(xyz(), xyz("s")).alias("ec_dist"), F.col("num_paths").alias("num_branches"),
    )


def soma_position(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Position of the first soma node (type 1), else of the first node; untyped nodes count as dendrite (3)."""
    t = F.coalesce("type", F.lit(3))
    best = F.min_by(F.struct("n", "x", "y", "z", t.alias("type")), F.struct((t != 1).alias("_o"), "n"))
    return nodes.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")


def _hull(x: list[float], y: list[float]) -> list[int]:
    """Corners of the convex hull, counter-clockwise, as places in points that are sorted and distinct."""
    if len(x) < 3:
        return list(range(len(x)))

    def half(places):
        out: list = []
        for q in places:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[q] - y[a]) - (y[b] - y[a]) * (x[q] - x[a]) > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    return half(range(len(x))) + half(range(len(x) - 1, -1, -1))


def _outside(points: DataFrame, keys: list[str], directions: int = 16) -> DataFrame:
    """Points that are not strictly inside the polygon of the extremes in some directions.

    Only such points can be corners of the hull. Extremes are one partial aggregation.
    """
    turns = [2 * math.pi * n / directions for n in range(directions)]
    points = once(points.select(*keys, "x", "y"))
    at = F.struct("x", "y")
    far = [F.max_by(at, F.struct((F.col("x") * math.cos(a) + F.col("y") * math.sin(a)).alias("d"), "x", "y")).alias(f"_e{n}") for n, a in enumerate(turns)]
    d = points.join(points.groupBy(*keys).agg(*far), keys)
    inside = F.lit(True)
    for n in range(directions):
        p, q = F.col(f"_e{n}"), F.col(f"_e{(n + 1) % directions}")
        left = (q["x"] - p["x"]) * (F.col("y") - p["y"]) - (q["y"] - p["y"]) * (F.col("x") - p["x"])
        inside = inside & (((p["x"] == q["x"]) & (p["y"] == q["y"])) | (left > 0))
    # With fewer than three different extremes there is no inside.
    flat = F.size(F.array_distinct(F.array(*[F.col(f"_e{n}") for n in range(directions)]))) < 3
    return d.filter(flat | ~F.coalesce(inside, F.lit(False))).select(*keys, "x", "y")


# Points that share a call of Python.
LOT_ROWS = 65_536


def hull_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Corner points of each key's convex hull, in order.

    Many keys share a call of Python, so small regions do not cost a call each. If a key has more points than a task should
    sort, points inside the polygon of the extremes in 16 directions go first. Then hulls of hulls: rows are
    spread over parts of bounded size, every part sends on its own corners, and the corners of all
    parts of a key go to one task.
    """
    points = once(points.select(*keys, "x", "y"))
    schema = StructType([*points.schema.fields, StructField("k", IntegerType())])

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), dtype=np.int64)
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        order = np.lexsort((y, x, code))
        code, x, y = code[order], x[order], y[order]
        new = np.concatenate([[True], (np.diff(code) != 0) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        order, code, x, y = order[new], code[new], x[new].tolist(), y[new].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        at, k = [], []
        for a, b in zip(cuts, cuts[1:]):
            h = _hull(x[a:b], y[a:b])
            at += [a + q for q in h]
            k += range(len(h))
        out = pdf.iloc[order[at]][[*keys, "x", "y"]].copy()
        out["k"] = np.array(k, dtype="int32")
        return out

    def hulls(rows: DataFrame, parts: list[str], n: int) -> DataFrame:
        """Hulls per key and part, dealt into lots of ``LOT_ROWS`` of ``n`` rows."""
        lots = n // LOT_ROWS + 1
        lot = F.pmod(F.xxhash64(*keys, *parts), F.lit(lots)) if keys or parts else F.lit(0).cast("long")
        return rows.withColumn("_lot", lot).repartition(lots, "_lot", *parts).groupBy("_lot", *parts).applyInPandas(corners, schema)

    if is_hot(points, keys):
        points = once(_outside(points, keys))
        rows = task_rows(points)
        n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
        cut = points.join(n, keys) if keys else points.crossJoin(F.broadcast(n))
        cut = cut.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / rows))).drop("_n")
        points = written(hulls(cut, ["_part"], group_sizes(points, keys)[1]).drop("k"))
    return hulls(points, [], group_sizes(points, keys)[1])


def hull_area(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull area and the diameter of the circle with that area."""
    h = hull_points(points, keys)
    nxt = F.struct(F.col("k").alias("k"), "x", "y")
    a = h.groupBy(*keys).agg(F.sort_array(F.collect_list(nxt)).alias("_h"))
    shifted = F.concat(F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(1))), F.slice("_h", 1, 1))
    cross = F.zip_with("_h", shifted, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    area = F.when(F.size("_h") < 3, 0.0).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2)
    return a.select(*keys, F.size("_h").alias("n_corners"), area.alias("hull_area")).withColumn("hull_dia", 2 * F.sqrt(F.col("hull_area") / math.pi))


def path_limits(points: DataFrame, keys: list[str], step: float = 20.0) -> DataFrame:
    """Extent of every cell's grid: its largest coordinate in x or y to either side, rounded up to whole steps (``lim``)."""
    far = F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))
    return points.groupBy(*keys).agg((F.ceil(far / step) * step).alias("lim"))


def _limited(df: DataFrame, keys: list[str], lim: float | DataFrame) -> tuple[DataFrame, Column]:
    """Rows and their extent: one for all, or that of their cell (:func:`path_limits`)."""
    if isinstance(lim, DataFrame):
        return df.join(lim.select(*keys, F.col("lim").cast("double").alias("_lim")), keys), F.col("_lim")
    return df, F.lit(float(lim))


def density_map(points: DataFrame, keys: list[str], lim: float | DataFrame, n_grid: int) -> DataFrame:
    """Gaussian kernel density on a square grid of ``n_grid ** 2`` points over ``-lim..lim``.

    ``lim`` is one number, or a table with the extent of every cell; a cell whose points all lie in the
    middle has no extent and no map.
    Bandwidth from the count (power -1/6) and the sample covariance. A point adds to the grid
    points within 8.6 spreads, beyond which the kernel is below double precision.
    """
    d = join_stats(points, keys, _n=F.count("*"), _xx=F.var_samp("x"), _yy=F.var_samp("y"), _xy=F.covar_samp("x", "y"))
    f = F.pow(F.col("_n").cast("double"), F.lit(-1 / 3))
    d = d.withColumns({"_a": F.col("_xx") * f, "_b": F.col("_xy") * f, "_c": F.col("_yy") * f}).withColumn("_det", F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b"))
    d, lim = _limited(d, keys, lim)
    step = nz(2 * lim / (n_grid - 1))
    for a, v in (("x", "_a"), ("y", "_c")):
        r = 8.6 * F.sqrt(v)
        lo = F.greatest(F.ceil((F.col(a) - r + lim) / step), F.lit(0))
        hi = F.least(F.floor((F.col(a) + r + lim) / step), F.lit(n_grid - 1))
        d = d.withColumn(f"g{a}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    dx, dy = F.col("gx") * step - lim - F.col("x"), F.col("gy") * step - lim - F.col("y")
    q = (F.col("_c") * dx * dx - 2 * F.col("_b") * dx * dy + F.col("_a") * dy * dy) / F.col("_det")
    k = F.exp(-0.5 * q) / (2 * math.pi * F.sqrt("_det") * F.col("_n"))
    return d.groupBy(*keys, "gx", "gy").agg(F.sum(k).alias("density"))


def density_center(density: DataFrame, keys: list[str], lim: float | DataFrame, n_grid: int) -> DataFrame:
    """Centre of mass in grid steps and in world units, and its distance from the middle; ``lim`` as in :func:`density_map`."""
    w = F.col("density")
    c = density.groupBy(*keys).agg((F.sum(F.col("gx") * w) / nz(F.sum(w))).alias("mx"), (F.sum(F.col("gy") * w) / nz(F.sum(w))).alias("my"))
    c, lim = _limited(c, keys, lim)
    wx, wy = F.col("mx") * 2 * lim / n_grid - lim, F.col("my") * 2 * lim / n_grid - lim
    return c.withColumns({"cx": wx, "cy": wy}).withColumn("asymmetry", F.hypot("cx", "cy")).select(*keys, "mx", "my", "cx", "cy", "asymmetry")


def mean_radius(corners: DataFrame, centre: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of the hull corners (the first one counted twice, as a closed line) from a centre."""
    d = corners.join(centre, keys).withColumn("_r", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    w = F.when(F.col("k") == 0, 2).otherwise(1)
    return d.groupBy(*keys).agg((F.sum(F.col("_r") * w) / F.sum(w)).alias("radius"))


def depth_profile(edges: DataFrame, keys: list[str], group: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Share of each cell's length per depth bin (by the middle of its edges), and the group mean.

    ``edges`` carry ``length`` and the middle depth ``zm``; empty bins of a cell count as zero.
    """
    d = edges.withColumn("bin", bin_index(F.col("zm"), bins, lo, hi)).filter("bin is not null")
    per = join_stats(d.groupBy(group, *keys, "bin").agg(F.sum("length").alias("_l")), [group, *keys], _t=F.sum("_l"))
    cells = edges.groupBy(group).agg(F.count_distinct(*keys).alias("_cells"))
    g = per.groupBy(group, "bin").agg(F.sum(F.col("_l") / nz(F.col("_t"))).alias("_s")).join(cells, group)
    return g.select(group, "bin", (F.col("_s") / F.col("_cells")).alias("density"))


def length_per_cell(candidates: DataFrame, ri: float, by: list[str]) -> DataFrame:
    """Segment length inside each hexagon (flat top, inner radius ``ri``) of candidate pairs.

    The segment is cut by the three pairs of parallel sides: the smallest leaving minus the largest
    entering share of it.
    """
    # Each step is a column of its own and nothing is filtered on the way: in one expression with the conditions of the
    # join they are too long to be compiled. Pairs without a length add zero and cells of length zero go at the end.
    t0, t1 = [F.lit(0.0)], [F.lit(1.0)]
    empty, d = F.lit(False), candidates
    for deg in (30, 90, 150):
        nx, ny = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        a = nx * (F.col("x0") - F.col("cx")) + ny * (F.col("y0") - F.col("cy"))
        v = nx * (F.col("x1") - F.col("x0")) + ny * (F.col("y1") - F.col("y0"))
        d = d.withColumns({f"_a{deg}": a, f"_v{deg}": v})
        a, v = F.col(f"_a{deg}"), F.col(f"_v{deg}")
        flat = F.abs(v) < 1e-12
        d = d.withColumns({f"_p{deg}": F.when(~flat, (-ri - a) / v), f"_q{deg}": F.when(~flat, (ri - a) / v)})
        p, q = F.col(f"_p{deg}"), F.col(f"_q{deg}")
        t0.append(F.when(flat, 0.0).otherwise(F.least(p, q)))
        t1.append(F.when(flat, 1.0).otherwise(F.greatest(p, q)))
        empty = empty | (flat & (F.abs(a) > ri))
    d = d.withColumn("_l", F.greatest(F.least(*t1) - F.greatest(*t0), F.lit(0.0)))
    whole = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return d.groupBy(*by).agg(F.sum(F.when(empty, 0.0).otherwise(F.col("_l") * whole)).alias("length")).filter("length > 0")


def _terms(x: Column, y: Column, kind: str) -> list[Column]:
    base = [F.lit(1.0), x, y]
    return base if kind == "linear" else [*base, x * x, x * y, y * y]


def fit_surface(points: DataFrame, keys: list[str], kind: str = "quadratic") -> DataFrame:
    """Least-squares surface z = f(x, y) per key: coefficients over centred and scaled coordinates.

    The sums of the normal equations are one aggregation; one small system per key is solved at the
    end. Stands in for spline surfaces.
    """
    d = join_stats(points, keys, mx=F.avg("x"), my=F.avg("y"), sx=F.stddev_pop("x"), sy=F.stddev_pop("y"))
    u, v = (F.col("x") - F.col("mx")) / nz(F.col("sx")), (F.col("y") - F.col("my")) / nz(F.col("sy"))
    t = _terms(u, v, kind)
    m = len(t)
    d = d.withColumns({f"_t{i}": c for i, c in enumerate(t)})
    sums = [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")) for i in range(m) for j in range(m)]
    rhs = [F.sum(F.col(f"_t{i}") * F.col("z")) for i in range(m)]
    g = d.groupBy(*keys, "mx", "my", "sx", "sy").agg(F.array(*sums).alias("_a"), F.array(*rhs).alias("_b"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(p, (m, m)), np.asarray(q), rcond=None)[0] for p, q in zip(a, b)])

    return g.select(*keys, "mx", "my", "sx", "sy", solve("_a", "_b").alias("coef"))


def surface_at(x: Column, y: Column, prefix: str = "") -> Column:
    """Height of a fitted surface whose columns are in the row."""
    c = F.col(f"{prefix}coef")
    u, v = (x - F.col(f"{prefix}mx")) / F.col(f"{prefix}sx"), (y - F.col(f"{prefix}my")) / F.col(f"{prefix}sy")
    lin = F.get(c, 0) + F.get(c, 1) * u + F.get(c, 2) * v
    quad = F.get(c, 3) * u * u + F.get(c, 4) * u * v + F.get(c, 5) * v * v
    return lin + F.coalesce(quad, F.lit(0.0))


def _prefixed(surface: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return surface.withColumnsRenamed({c: f"{prefix}{c}" for c in surface.columns if c not in keys})


def surface_grid(surface: DataFrame, boxes: DataFrame, keys: list[str], d: float) -> DataFrame:
    """Heights of each surface on a grid over its box ``(x0, x1, y0, y1)``."""
    g = boxes.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("x1") - F.col("x0")) / d))))
    g = g.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("y1") - F.col("y0")) / d))))
    g = g.select(*keys, (F.col("x0") + F.col("_i") * d).alias("x"), (F.col("y0") + F.col("_j") * d).alias("y"))
    return g.join(surface, keys).select(*keys, "x", "y", surface_at(F.col("x"), F.col("y")).alias("z"))


def flatten_depth(points: DataFrame, lower: DataFrame, upper: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """Depth relative to the lower surface over the median distance of the two surfaces on shared points."""
    lo, up = _prefixed(lower, keys, "l_"), _prefixed(upper, keys, "u_")
    x, y = F.col("x"), F.col("y")
    gap = shared.join(lo, keys).join(up, keys).withColumn("_g", surface_at(x, y, "u_") - surface_at(x, y, "l_"))
    med = quantiles(gap, keys, "_g", _med=0.5)
    d = points.join(lo, keys).join(med, keys)
    return d.select(*points.columns, ((F.col("z") - surface_at(x, y, "l_")) / nz(F.col("_med"))).alias("z_flat"))


def column_depth(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of the brightest voxel of every column (the smallest on ties)."""
    return voxels.groupBy(*keys, "x", "y").agg(F.max_by("z", F.struct("v", -F.col("z"))).cast("double").alias("z"))


def apply_depth_correction(points: DataFrame, volume: DataFrame, reference: DataFrame, keys: list[str], kind: str = "linear") -> DataFrame:
    """Shift points by the fitted difference in depth between two volumes."""
    ref = column_depth(reference, keys).withColumnRenamed("z", "_z")
    diff = column_depth(volume, keys).join(ref, [*keys, "x", "y"])
    diff = diff.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("_z") - F.col("z")).alias("z"))
    s = _prefixed(fit_surface(diff, keys, kind), keys, "s_")
    return points.join(s, keys).select(*points.columns, (F.col("z") + surface_at(F.col("x"), F.col("y"), "s_")).alias("z_new"))
