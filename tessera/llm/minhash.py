"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import block_count, spare, text_of

WIDTH = 5
#: Bins, stored bits per bin, bins per packed long.
BINS, BITS, PACK = 128, 4, 16
#: Top bits of a hash that name its bin.
TOP = 64 - 7
#: Probes of an empty bin before all filled bins are ranked for it.
PROBES = 6
#: Neighbouring documents per block, and the most blocks whose borders are held at once.
BLOCK_ROWS, MOST_BLOCKS = 4096, 65_536


def with_fingerprint(df: DataFrame, text: Column, into: str) -> DataFrame:
    """``df`` with ``into``: the packed fingerprint of ``text``, an array of 8 longs of 16 bins of 4 bits.

    Shingles are runs of five lower-cased words (all words if there are fewer). Their hashes are
    computed once and sorted, so that every bin, named by the top 7 bits, starts with its minimum. An
    empty bin takes the value of the first filled one along its own random sequence of bins, which
    depends on nothing but the bin (optimal densification): six probes, then the filled bin that
    ranks first for it. The low 4 bits are stored. A text without words has all bins zero.
    """
    words, hashes, mins, filled, place, values = spare(df, "_words", "_hashes", "_mins", "_filled", "_place", "_values")
    bare = F.trim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    runs = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(hashes, F.sort_array(F.transform(runs, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WIDTH)]))))
    first = lambda x, i: (i == 0) | (F.shiftright(x, TOP) != F.shiftright(F.get(F.col(hashes), i - 1), TOP))
    df = df.withColumn(mins, F.filter(F.col(hashes), first))
    df = df.withColumn(filled, F.transform(F.col(mins), lambda x: (F.shiftright(x, TOP) + BINS // 2).cast("int")))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    df = df.withColumn(place, F.transform(bins, lambda b: F.array_position(F.col(filled), b).cast("int")))

    def source(b: Column) -> Column:
        at = lambda j: F.nullif(F.get(F.col(place), j), F.lit(0))
        probes = [at(F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(1, PROBES + 1)]
        ranked = F.array_min(F.transform(F.col(filled), lambda j, i: F.struct(F.xxhash64(j, b), i + 1)))
        return F.coalesce(at(b), *probes, ranked["col2"])

    low = lambda b: F.coalesce(F.get(F.col(mins), source(b) - 1).bitwiseAND(2**BITS - 1), F.lit(0).cast("long"))
    df = df.withColumn(values, F.transform(bins, low))
    pack = lambda k: F.aggregate(F.slice(F.col(values), k * PACK + 1, F.lit(PACK)), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v))
    return df.withColumn(into, F.transform(F.sequence(F.lit(0), F.lit(BINS // PACK - 1)), pack)).drop(words, hashes, mins, filled, place, values)


def as_text(packed: str) -> Column:
    """A packed fingerprint as 128 hex digits, one per bin."""
    return F.array_join(F.transform(F.col(packed), lambda p: F.lpad(F.lower(F.hex(p)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity: share of equal bins, corrected for bins that agree by chance (1/16), 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(0x1111111111111111))

    apart = F.aggregate(F.zip_with(F.col(a), F.col(b), unequal), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), ((BINS - apart) / float(BINS) - chance) / (1 - chance))


def with_next(docs: DataFrame, key: str, columns: list[str], each: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by (``key``, columns); the last row is followed by the first.

    Keys are range-partitioned to find borders of even blocks. Every row goes to its block by binary
    search in the borders, and a row on a border also to the block before, as its last neighbour.
    So one shuffle brings neighbours together and no task sorts more than a block, unless one key
    alone is larger. Borders are one row of at most 65 536 keys, which is broadcast. Null keys come first.
    """
    role, block, borders, low, order = spare(docs, "_role", "_block", "_borders", "_low", "_order")
    n = min(block_count(docs.count(), each), MOST_BLOCKS)
    kind = docs.schema[key].dataType
    cut = docs.select(F.col(f"`{key}`").alias("k")).filter("k is not null").repartitionByRange(n, "k")
    firsts = durable(cut.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")))
    one = firsts.agg(F.sort_array(F.collect_set("k")).alias(borders))
    steps = F.sequence(F.lit(1), F.lit(MOST_BLOCKS.bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.get(F.col(borders), mid) <= F.col(f"`{key}`")
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    span = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))
    rows = docs.crossJoin(F.broadcast(one))
    rows = rows.withColumn(low, F.when(F.col(f"`{key}`").isNull(), 0).otherwise(F.aggregate(steps, span, halve)["lo"] - 1))
    on_border = F.col(f"`{key}`") == F.get(F.col(borders), F.col(low))
    begins = F.col(f"`{key}`").isNull() | (on_border & (F.col(low) == 0))
    last = F.size(borders) - 1
    # (block, role): the row itself, the end of the block before, the end of the whole ring.
    places = F.array(F.struct(F.col(low).alias("b"), F.lit(0).alias("r")), F.when(on_border & (F.col(low) > 0), F.struct((F.col(low) - 1).alias("b"), F.lit(1).alias("r"))), F.when(begins, F.struct(F.greatest(last, F.lit(0)).alias("b"), F.lit(2).alias("r"))))
    rows = rows.withColumn(order, F.explode(F.filter(places, lambda p: p.isNotNull()))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{order}.b").alias(block), F.col(f"{order}.r").alias(role))
    along = Window.partitionBy(block).orderBy(role, F.col(f"`{key}`").asc_nulls_first(), *[F.col(f"`{c}`") for c in columns])
    # Borders of the block after sort behind the block's own rows, so the next row is right for the last one too.
    rows = rows.withColumns({f"next_{c}": F.lead(f"`{c}`").over(along) for c in columns})
    return rows.filter(F.col(role) == 0).drop(block, role)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are.

    The edited text ends with the beginning of the next document, by ascending ``doc_id``, in place
    of its own last floor(n/2) code points. Null texts are empty. Rows that repeat a ``doc_id``
    follow each other by text. Only ``doc_id`` and ``text`` are read.
    """
    rows = with_fingerprint(docs.select("doc_id", text_of().alias("text")), F.col("text"), "packed")
    rows = with_next(rows, "doc_id", ["text", "packed"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half))).drop("next_text")
    rows = rows.withColumn("n_chars", n.cast("long")).drop("text")
    rows = with_fingerprint(rows, F.col("edited"), "edited_packed")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("packed").alias("fingerprint"), as_text("edited_packed").alias("edited_fingerprint"), likeness("packed", "edited_packed").alias("near_edited"), likeness("packed", "next_packed").alias("near_next"))
