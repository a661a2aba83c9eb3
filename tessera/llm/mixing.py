"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, match, running, spare, text_of, written

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def plan_sources(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """Target words of every source; ``totals`` has ``source`` and ``source_size``, one row per source.

    Sources in code point order, null last, get ``weights`` in turn and share ``percent`` of all
    words. No target exceeds ``epochs`` times its source; the excess goes to the others by weight
    until none is above. In order of size per weight the full sources are a prefix, and whether
    the next one fills up is decided in whole numbers. The table has one row per configured source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", share).withColumn("cap", F.col("source_size") * epochs)
    every = Window.partitionBy()
    t = t.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(earlier), none)).withColumn("weight_before", F.coalesce(F.sum("weight").over(earlier), none))
    left = F.col("all_size") * percent - F.col("cap_before") * 100
    t = t.withColumn("full", F.col("weight") * left > F.col("cap") * 100 * (F.col("all_weight") - F.col("weight_before")))
    t = t.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), none))
    t = t.withColumn("full_weight", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), none))
    open_share = (F.col("weight") * (F.col("all_size") * percent - F.col("full_cap") * 100)).cast("double") / (100 * (F.col("all_weight") - F.col("full_weight"))).cast("double")
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_share))
    budget = F.floor("target").cast("long")
    size = F.col("source_size")
    return t.withColumn("rounds", F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long")).withColumn("rest", budget - F.col("rounds") * size).select("source", "source_size", "weight", "target", "rounds", "rest")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """How many words of every document the mix takes.

    Every row gets a hash-random key, the MD5 of its ``doc_id``. Rows are range-sorted by (source,
    key), prefix sums of their words run over the blocks, and each source is cut at its exact
    budget: whole rounds first, then the documents whose words lie before the rest; the one that
    lies across the cut gives its first words only. Null texts have no words, null sources are one
    source, rows that repeat a ``doc_id`` follow each other in any order. Columns: doc_id, source,
    size, key, start, source_size, target, rounds, rest, taken.
    """
    rows = docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    cut, blocks = running(rows, ["source"], ["key", "size"], "size", "before")
    plan = plan_sources(cut.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs)
    blocks = blocks.select("source", "_block", "_offset")
    out = match(cut, match(blocks, plan, ["source"]), ["source", "_block"])
    out = out.withColumn("start", F.col("_offset") + F.col("before"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return out.withColumn("taken", F.col("rounds") * F.col("size") + part).drop("_block", "_offset", "before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """The mixed documents: one row per round in which a document is taken, with the columns of ``docs``.

    The table of cuts, one row per source, is what joins the texts: they are not sorted or
    shuffled unless that table is too long to broadcast. The document across a source's cut is
    shortened to its first words (``n_chars`` follows). Documents without words are not taken.
    Copies of one (doc_id, size) at the cut share its words evenly, rounded down.
    """
    table = mix_table(docs, weights, percent, epochs)
    at = table.groupBy("source", "rounds", "rest", "key", "size").agg(F.min("start").alias("first"), F.count("*").alias("copies"))
    at = at.filter("first <= rest and rest < first + size * copies").withColumn("words", F.floor((F.col("rest") - F.col("first")) / F.col("copies")).cast("long"))
    every = table.groupBy("source").agg(F.max("rounds").alias("rounds"))
    names = spare(docs, "_source", "_rounds", "_key", "_size", "_words", "_mine", "_length", "_part", "_copy")
    source, rounds, key, size, words, mine, length, part, copy = names
    cuts = match(every, at.drop("rounds", "rest"), ["source"], "left")
    cuts = written(cuts.select(F.col("source").alias(source), F.col("rounds").alias(rounds), F.col("key").alias(key), F.col("size").alias(size), F.col("words").alias(words)))
    out = docs.join(cuts, docs["source"].eqNullSafe(cuts[source]))
    out = out.withColumn(mine, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(length, word_count(text_of()))
    this, cut = F.struct(mine, length), F.struct(F.col(key).alias(mine), F.col(size).alias(length))
    out = out.withColumn(part, F.when(F.col(key).isNull() | (this > cut), 0).when(this == cut, F.col(words)).otherwise(F.col(length)))
    out = out.filter(F.col(length) > 0).withColumn(copy, F.explode(F.expr(f"filter(sequence(1L, {rounds} + 1L), i -> i <= {rounds} or {part} > 0)")))
    short = (F.col(copy) > F.col(rounds)) & (F.col(part) < F.col(length))
    head = F.expr(rf"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){{', cast({part} as string), '}}+'), 0)")
    values = {"text": F.when(short, head).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(short, F.length(head)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(values).select(*[F.col(f"`{c}`") for c in docs.columns])
