"""Small frames that hold every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = "the of and to in that was for with his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here between both being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part school thought went say general once upon war left every don does got united number hand course water until always away public something fact though less night asked mind".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(words))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    plain = prose(rng, 60)
    rows = [
        (1, plain, "en", "a", 10), (2, plain, "en", "a", 10), (2, plain, "en", "a", 10), (3, None, "en", "b", None), (4, "", "de", "b", 0),
        (5, " \t\n ", None, None, 4), (6, "x", "en", "a", 1), (None, prose(rng, 30), "en", None, 5), (None, None, None, None, None),
        (7, "word " * 30_000, "en", "c", 150_000), (8, prose(rng, 3000), "fr", "c", 1), (9, "ÄÖÜ ß 日本語 🙂 " * 4, "de", "ü", 3), (-5, "\u0000 a b", "en", "a", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["shard", "slot", "key", "size", "fold", "base", "v", "_block", "packed", "text_hash", "_words", "rank", "Source_Size"]
    for c in clash:
        df = df.selectExpr("*", f"cast('kept' as string) as `{c}`")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
