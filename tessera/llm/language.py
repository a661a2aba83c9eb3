"""Language identification by fusing text, markup, address and host evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import match, spare, text_of, without, written

LANGUAGES = ("de", "en", "es", "fr")
#: Name of the hypothesis that the text is in none of the languages.
NONE = "und"
BUCKETS = 1 << 15
#: Pseudo-counts: per trigram bucket, and of the parent level in a child's prior.
ALPHA, KAPPA = 0.1, 20.0
#: Trigrams overlap, so their log-likelihoods count a third.
TEMPER = 1 / 3
LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams; words are lower-cased and set off by single spaces."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint32)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


def counter(languages: tuple[str, ...]):
    """Task function: trigram counts by language of all labelled rows of a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in languages:
                    total[languages.index(lang)] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int32()), pa.array(bucket, type=pa.int32()), pa.array(total[at, bucket])], names=["lang", "bucket", "n"])

    return count


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probability of every trigram bucket (rows) in every language and, last, in none.

    Counts come from all documents with a known ``lang``. The model has a fixed size.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    counts = rows.mapInArrow(counter(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), ALPHA)
    table[counts["bucket"].to_numpy(), counts["lang"].to_numpy()] += counts["n"].to_numpy()
    model = np.full((BUCKETS, len(languages) + 1), -np.log(BUCKETS), dtype=np.float32)
    model[:, :-1] = np.log(table / table.sum(axis=0))
    return model


def likelihoods(model: np.ndarray):
    """Tempered log-likelihoods of a text, one per hypothesis; empty without letters."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = trigrams(t)
            sums = sum((model[h[i : i + 65_536]].sum(axis=0, dtype=np.float64) for i in range(0, len(h), 65_536)), np.zeros(model.shape[1]))
            out.append((sums * TEMPER).tolist() if len(h) else [])
        return pd.Series(out)

    return score


def softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


def smoothed(counts: DataFrame, levels: list[list[str]], names: list[str]) -> DataFrame:
    """Prior of every key of the last level, smoothed towards its parent, level by level.

    ``counts`` has one row per key of the last level with soft counts ``names``; ``levels`` are key
    columns from the most general (none) to the most special.
    """
    prior = None
    for keys in levels:
        own = counts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
        whole = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        if prior is None:
            prior = own.select([((F.col(n) + 1) / (whole + len(names))).alias(f"p_{n}") for n in names])
            above: list[str] = []
            continue
        own = match(own, prior, above) if above else own.crossJoin(F.broadcast(prior))
        prior = own.select(*keys, *[((F.col(n) + KAPPA * F.col(f"p_{n}")) / (whole + KAPPA)).alias(f"p_{n}") for n in names])
        above = keys
    return prior


def evidence(rows: DataFrame, key: str, names: list[str], into: str) -> DataFrame:
    """Log-probability of every value of ``key`` under each hypothesis, from soft counts; 0 for an empty value."""
    own = rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    total = own.filter(F.col(key) != "").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"t_{n}") for n in names], F.count("*").alias("_values"))
    logs = [F.when(F.col(key) == "", 0.0).otherwise(F.log((F.col(n) + 0.5) / (F.col(f"t_{n}") + 0.5 * (F.col("_values") + 1)))).alias(f"{into}{i}") for i, n in enumerate(names)]
    return own.crossJoin(F.broadcast(total)).select(key, *logs)


def identify(rows: DataFrame, model: np.ndarray, carry: list[str], languages: tuple[str, ...] = LANGUAGES, least: float = 0.5) -> DataFrame:
    """Language of every row: the ``carry`` columns, ``language``, ``probability``, ``accepted``.

    ``rows`` has ``text``, ``host``, ``domain``, ``suffix`` and ``declared`` (a language code); a null
    in any of them is no evidence. The posterior is the product of the text's likelihood, the prior
    of the host (smoothed towards its domain and that towards all rows), and the probabilities of
    the declared language and the address suffix under each hypothesis. Priors and probabilities
    are grouped sums of the text-only posteriors of all rows. A row is accepted if some language,
    and not ``und``, has a probability of ``least`` or more. A text without letters is ``und`` with
    probability 1 and not accepted. Only counts are grouped; texts are not shuffled.
    """
    n = len(languages) + 1
    names = [f"q{i}" for i in range(n)]
    own = spare(rows, *[f"_c{i}" for i in range(len(carry))])
    short = F.lower(F.regexp_extract(F.coalesce(F.col("declared"), F.lit("")), r"^\s*([A-Za-z]+)", 1))
    declared = F.when(short.isin("", *languages), short).otherwise("other")
    blank = {c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{c}") for c in ("host", "domain", "suffix")}
    base = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own)], *blank.values(), declared.alias("_declared"), likelihoods(model)(text_of()).alias("_ll"))
    base = durable(base.withColumn("_known", F.size("_ll") > 0).withColumns({f"_l{i}": F.coalesce(F.get("_ll", F.lit(i)), F.lit(0.0)) for i in range(n)}).drop("_ll"))
    soft = base.filter("_known").withColumns(dict(zip(names, softmax([F.col(f"_l{i}") for i in range(n)]))))
    counts = durable(soft.groupBy("_domain", "_host", "_suffix", "_declared").agg(*[F.sum(x).alias(x) for x in names]))
    priors = written(smoothed(counts, [[], ["_domain"], ["_domain", "_host"]], names))
    tables = [(priors, ["_domain", "_host"]), (written(evidence(counts, "_suffix", names, "_s")), ["_suffix"]), (written(evidence(counts, "_declared", names, "_d")), ["_declared"])]
    for t, keys in tables:
        base = match(base, t, keys, "left")
    logs = [F.col(f"_l{i}") + F.coalesce(F.log(f"p_q{i}"), F.lit(0.0)) + F.coalesce(f"_s{i}", F.lit(0.0)) + F.coalesce(f"_d{i}", F.lit(0.0)) for i in range(n)]
    base = base.withColumns({f"_z{i}": x for i, x in enumerate(logs)})
    base = base.withColumns({f"_p{i}": x for i, x in enumerate(softmax([F.col(f"_z{i}") for i in range(n)]))})
    top = F.greatest(*[F.col(f"_p{i}") for i in range(n)])
    code = F.lit(NONE)
    for i in reversed(range(n - 1)):
        code = F.when(F.col(f"_p{i}") == top, languages[i]).otherwise(code)
    out = base.withColumn("_lang", F.when(F.col("_known"), code).otherwise(NONE)).withColumn("_prob", F.when(F.col("_known"), top).otherwise(1.0))
    return out.select(*[F.col(o).alias(c) for c, o in zip(carry, own)], F.col("_lang").alias("language"), F.col("_prob").alias("probability"), ((F.col("_lang") != NONE) & (F.col("_prob") >= least)).alias("accepted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as input of ``identify``: the source is the host; they have no markup and no address."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), F.xxhash64(text_of()).alias("text_hash"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Raw pages as input of ``identify``: visible text, host, registered domain, address suffix, markup language.

    The suffix is the last label of the host, followed by the first part of the path if that has two
    letters.
    """
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[a-zA-Z]+;|&#\d+;", " ")
    part = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    return pages.select("page_id", text.alias("text"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), F.when(part != "", part)).alias("suffix"), declared.alias("declared"))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, least: float = 0.5) -> DataFrame:
    """``docs`` without those that ``identify`` does not accept; only the rejected keys are joined."""
    mark, = spare(docs, "text_hash")
    rows = document_rows(docs)
    # Written first: a filter pushed into the posterior would repeat its terms many times over.
    table = written(identify(rows, train(docs, languages), ["doc_id", "host", "text_hash"], languages, least))
    gone = table.filter("not accepted").select("doc_id", F.col("host").alias("source"), F.col("text_hash").alias(mark))
    return without(docs.withColumn(mark, F.xxhash64(text_of())), gone).drop(mark)
