"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.registry import SETTINGS
from .chat import chat_table
from .common import table
from .coordjoin import link_table
from .covertree import code_table
from .decontaminate import passages
from .importance import importance_table
from .language import document_rows, identify, page_rows
from .language import train as train_language
from .minhash import fingerprint_table
from .mixing import mix_table
from .pii import pii_table
from .pseudo import score_table
from .secrets import secret_table
from .sharding import shard_table
from .simdedup import dedup_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return deco


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS HUGEINT) AS weight,
    CAST(2 * source_size AS HUGEINT) AS cap, sum(source_size) OVER () AS all_size
  FROM totals),
filling AS (
  SELECT *, sum(weight) OVER () AS all_weight, coalesce(sum(cap) OVER earlier, 0) AS cap_before, coalesce(sum(weight) OVER earlier, 0) AS weight_before
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, weight * (3 * all_size - 2 * cap_before) > 2 * cap * (all_weight - weight_before) AS is_full FROM filling),
rest AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS full_cap, coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0) AS full_weight
  FROM filled),
plan AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE)
      ELSE CAST(weight * (150 * all_size - 100 * full_cap) AS DOUBLE) / CAST(100 * (all_weight - full_weight) AS DOUBLE) END AS target
  FROM rest),
placed AS (
  SELECT s.*, p.source_size, p.target, CAST(floor(p.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END)) AS s
  FROM words),
nodes AS (SELECT min(row) AS node, min(doc_id) AS least, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT node, least FROM nodes
  UNION SELECT pairs.b, reach.least FROM reach JOIN pairs ON pairs.a = reach.node),
named AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS component_id,
  sets.doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS kept
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN named ON named.node = nodes.node
"""


WEIGH_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1])))) AS f FROM words WHERE len(w) > 0),
counted AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY side, row, f),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
bucketed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM features, bits),
sides AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS BIGINT) AS t
  FROM counted JOIN bucketed USING (f) GROUP BY bucket),
whole AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sides),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM sides, whole),
sums AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g
  FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
weighed AS (
  SELECT words.row, doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (g - (((g % n) + n) % n)) // n END AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN sums USING (row) WHERE side = 'd'),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n_able
  FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
  CASE WHEN able AND place <= 25 * n_able // 100 THEN place END AS rank
FROM placed
"""


def _lloyd_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every round states all distances; components are whole numbers, so all sums are exact."""
    floored = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
    steps = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p)),
book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT vec_id, label, parts.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN book{r} ON parts.p = book{r}.p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (
  SELECT p, e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m.e AS e, x, unnest(range(1, len(x) + 1)) AS k FROM near{r}) GROUP BY p, e, k),
book{r + 1} AS (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, e, list({floored} ORDER BY k) AS c FROM sums{r} GROUP BY p, e) s ON s.p = b.p AND s.e = b.e)""")
    steps.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
codes AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(m.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest""")
    return ",\n".join(steps)


@query()
def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint_table(table(spark, sf_dir, "documents"))


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every raw page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = document_rows(docs).drop("text_hash").withColumn("page_id", none)
    rows = rows.unionByName(page_rows(pages).withColumn("doc_id", none))
    return identify(rows, train_language(docs), ["doc_id", "page_id"])


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return pii_table(table(spark, sf_dir, "documents"))


@query(MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    return mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return dedup_table(table(spark, sf_dir, "documents"))


@query(CHAT_SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from every formatted conversation, and from one full of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    marks = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat_table(turns.unionByName(marks))


@query()
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_table(table(spark, sf_dir, "documents"))


@query()
def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document."""
    return shard_table(table(spark, sf_dir, "documents"))


@query()
def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return score_table(table(spark, sf_dir, "documents"))


@query(NEAR_SQL)
def op11_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return link_table(table(spark, sf_dir, "documents"))


@query(WEIGH_SQL)
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the benchmark texts, and the rank of those drawn."""
    return importance_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(_lloyd_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by sixteen codebooks of 64 entries."""
    return code_table(table(spark, sf_dir, "embeddings"))
