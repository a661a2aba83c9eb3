"""Exact nearest neighbours in space by blocks along a Z-order curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once, written
from .scan import indexed, scan

# Distinct positions of a block.
LEAF_ROWS = 64
# Bits of the curve, shared by the axes; cells below 2 ** -FINEST of the box are not told apart.
CURVE_BITS, FINEST = 62, 40
# Distances are compared with this much slack, so that rounding never drops the right block.
SLACK = 1 + 1e-9


def _sq(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _curve(axes: list[str]) -> Column:
    """Position along the Z-order curve of offsets ``_o_a`` within a box as wide as ``_w``."""
    bits = CURVE_BITS // len(axes)
    top = float(2**bits)
    q = [F.greatest(F.least(F.floor(F.col(f"_o_{a}") * (top / F.col("_w"))), F.lit(2**bits - 1)), F.lit(0)).cast("long") for a in axes]
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate(q):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), i * len(axes) + k))
    return out


def _with(df: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the row of their key; without keys the single row is sent to all."""
    return df.join(one.hint("merge"), keys) if keys else df.crossJoin(F.broadcast(one))


def nearest_point(points: DataFrame, cloud: DataFrame, pid: list[str], axes: list[str], cid: str, scale: dict[str, float] | None = None, keys: list[str] | None = None, other: str | None = None, within: str | None = None) -> DataFrame:
    """For each point the nearest cloud row (smallest ``cid`` on ties) and its distance.

    Copies in the cloud collapse to their smallest id. The cloud is cut into even blocks along a
    Z-order curve, each with its bounding box. A point's own block, found by one ordered scan, gives an
    upper bound; a grid whose cells are as wide as that bound leads to the blocks around it, and of
    these only blocks whose box is within the bound are compared. The number of joins does not
    depend on the data. These joins are shuffles: written tables are small as files, not as rows, so the planner
    would broadcast them whole. With ``keys`` points meet only cloud rows of their key; points whose key has none are missing.
    Rows whose column ``other`` equals the point's do not count, nor, with ``within``, rows
    farther than the point's column of that name; points left without a row are missing then.
    An empty cloud has no nearest row: everything about it is null.
    """
    scale, keys = scale or {}, keys or []
    label = [other] if other else []
    extra = [c for c in [*keys, *label, *([within] if within else [])] if c not in pid]
    place = [f"c_{a}" for a in axes]
    uniq = cloud.groupBy(*keys, *label, *axes).agg(F.min(cid).alias("_cid"))
    uniq = once(uniq.select(*keys, *[F.col(c).alias("_label") for c in label], *[F.col(a).alias(c) for a, c in zip(axes, place)], "_cid"))
    s = {a: float(scale.get(a, 1.0)) for a in axes}
    box = uniq.groupBy(*keys).agg(*[f(F.col(c).cast("double") * s[a]).alias(f"{n}_{a}") for a, c in zip(axes, place) for n, f in (("_lo", F.min), ("_hi", F.max))])
    box = box.select(*keys, *[f"_lo_{a}" for a in axes], (F.greatest(F.lit(1e-9), *[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in axes]) * SLACK).alias("_w"))
    box = written(box.filter(F.col(f"_lo_{axes[0]}").isNotNull()))
    if not keys and box.isEmpty():
        none = [F.lit(None).cast(cloud.schema[cid].dataType).alias(cid), F.lit(None).cast("double").alias("dist")]
        return points.select(*pid, *none, *[F.lit(None).cast(cloud.schema[a].dataType).alias(f"near_{a}") for a in axes])

    def offsets(df: DataFrame, names: list[str]) -> DataFrame:
        d = _with(df, box, keys)
        return d.withColumns({f"_o_{a}": F.col(c).cast("double") * s[a] - F.col(f"_lo_{a}") for a, c in zip(axes, names)}).withColumn("_z", _curve(axes))

    inside = [f"_o_{a}" for a in axes]
    leaf = offsets(uniq, place).select(*uniq.columns, *inside, "_z")
    leaf = indexed(leaf, keys, ["_z", *place, *[f"_{c}" for c in (["label"] if other else [])]], "_i")
    leaf = written(leaf.withColumn("_block", F.floor(F.col("_i") / LEAF_ROWS)).drop("_i"))
    blocks = leaf.groupBy(*keys, "_block").agg(F.min("_z").alias("_z"), *[f(c).alias(f"{n}{c}") for c in inside for n, f in (("_a", F.min), ("_b", F.max))])
    blocks = written(blocks)
    ask = offsets(points.select(*pid, *extra, *axes).dropDuplicates(pid), axes)
    ask = ask.filter(F.col("_z").isNotNull()).select(*pid, *extra, *axes, *inside, "_w", "_z")

    # A point's own block is the last one that starts at or before it on the curve, else the first.
    starts = blocks.select(*keys, "_z", F.lit(0).alias("_t"), F.lit(0).cast("long").alias("_u"), F.col("_block").alias("_s"))
    marks = ask.withColumns({"_t": F.lit(1), "_u": F.xxhash64(*pid), "_s": F.lit(None).cast("long")}).unionByName(starts, allowMissingColumns=True)
    ask = scan(marks, keys, ["_z", "_t", "_u"], _block=("last", F.col("_s"))).filter("_t = 1")
    ask = written(ask.withColumn("_block", F.coalesce("_block", F.lit(0))).drop("_t", "_u", "_s", "_z"))

    def apart(df: DataFrame) -> DataFrame:
        """Distances to the rows of joined blocks; offsets of the row are ``_q_a``."""
        row = leaf.select(*keys, "_block", *[F.col(c).alias(f"_q{c}") for c in inside], *place, "_cid", *(["_label"] if other else []))
        d = df.join(row.hint("merge"), [*keys, "_block"])
        if other:
            d = d.filter(~F.col("_label").eqNullSafe(F.col(other)))
        return d.withColumn("dist", F.sqrt(_sq([(F.col(a).cast("double") - F.col(c)) * s[a] for a, c in zip(axes, place)])))

    own = apart(ask).groupBy(*pid).agg(F.min("dist").alias("_own"))
    limit = [F.col("_own"), *([F.col(within)] if within else [])]
    far = F.sqrt(_sq([F.greatest(F.abs(F.col(c)), F.abs(F.col(c) - F.col("_w"))) for c in inside]))
    ask = ask.drop("_block").join(own.hint("merge"), pid, "left").withColumn("_ub", F.coalesce(F.least(*limit) if within else F.col("_own"), far) * SLACK)
    ask = ask.withColumn("_level", F.ceil(F.log2(F.greatest(F.col("_ub"), F.col("_w") * 2.0**-FINEST))).cast("int"))
    ask = written(ask.drop("_own", "_w"))

    def cell(c: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), F.col("_level"))).cast("long")

    levels = ask.select(*keys, "_level").distinct()
    cells = [f"_g{c}" for c in inside]
    near = _levelled(leaf, levels, keys).select(*keys, "_block", "_level", *[cell(F.col(c)).alias(g) for c, g in zip(inside, cells)]).distinct()
    around = ask.select(*pid, *extra, *axes, "_level", "_ub", *inside)
    for c, g in zip(inside, cells):
        around = around.withColumn(g, F.explode(F.sequence(cell(F.col(c) - F.col("_ub")), cell(F.col(c) + F.col("_ub")))))
    found = around.join(near.hint("merge"), [*keys, "_level", *cells]).select(*pid, *extra, *axes, "_ub", *inside, "_block").distinct()
    found = found.join(blocks.drop("_z").hint("merge"), [*keys, "_block"])
    gap = F.sqrt(_sq([F.greatest(F.col(f"_a{c}") - F.col(c), F.col(c) - F.col(f"_b{c}"), F.lit(0.0)) for c in inside]))
    # Only rows within the bound are sorted for the smallest, not whole blocks.
    hit = apart(found.filter(gap <= F.col("_ub") * SLACK).select(*pid, *extra, *axes, "_ub", "_block")).filter(F.col("dist") <= F.col("_ub") * SLACK)
    if within:
        hit = hit.filter(F.col("dist") <= F.col(within))
    out = hit.groupBy(*pid).agg(F.min_by(F.struct("_cid", "dist", *place), F.struct("dist", "_cid")).alias("_m"))
    return out.select(*pid, F.col("_m._cid").alias(cid), "_m.dist", *[F.col(f"_m.c_{a}").alias(f"near_{a}") for a in axes])


def _levelled(leaf: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Cloud rows once for every level that a point of their key asks for: at most one per power of two."""
    if keys:
        return leaf.join(levels.hint("merge"), keys)
    return leaf.withColumn("_level", F.explode(F.array(*[F.lit(r[0]) for r in levels.collect()]) if not levels.isEmpty() else F.array().cast("array<int>")))
