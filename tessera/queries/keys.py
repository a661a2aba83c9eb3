"""Queries for the keyed relational algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys as K
from .fixtures import samples, table
from .registry import query


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def restrict_dict(spark, sf):
    out = K.restrict(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return out.select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02::DOUBLE AND l_returnflag <> 'N'")
def restrict_expr(spark, sf):
    out = K.restrict(table(spark, sf, "lineitem"), "l_quantity > 45", "l_discount < 0.02D", "l_returnflag != 'N'")
    return out.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') OR o_totalprice > 450000")
def restrict_any(spark, sf):
    preds = [{"o_orderstatus": "P"}, {"o_orderstatus": "O", "o_orderpriority": "5-LOW"}, "o_totalprice > 450000"]
    return K.restrict_any(table(spark, sf, "orders"), preds).select("o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1', 'src2')")
def restrict_not(spark, sf):
    return K.restrict_not(table(spark, sf, "documents"), "source", ["src0", "src1", "src2"]).select("doc_id", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semijoin(spark, sf):
    placed = table(spark, sf, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return K.semijoin(table(spark, sf, "customer"), placed, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def antijoin(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return K.antijoin(table(spark, sf, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def natural_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return K.natural_join(docs, table(spark, sf, "labels"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def project_keys(spark, sf):
    return K.project_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def project_rename(spark, sf):
    return K.project_rename(table(spark, sf, "customer"), "c_custkey", balance="c_acctbal", segment="c_mktsegment")


_BY_TYPE = "SELECT user_id, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL"


@query(
    f"WITH u AS ({_BY_TYPE}) SELECT a.user_id, a.n AS n_click, b.n AS n_view, a.peak AS peak_click, b.peak AS peak_view "
    "FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'"
)
def self_join_variants(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return K.self_join_variants(u, "event_type", "click", "view", ["user_id"], ["n", "peak"], ("click", "view"))


@query(
    "SELECT s.n_nationkey AS bc_id, (s.n_nationkey + 1) % 25 AS rgc_id, a.n AS n_1, b.n AS n_2 FROM nation s "
    "JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON a.k = s.n_nationkey "
    "JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON b.k = (s.n_nationkey + 1) % 25"
)
def pair_two_inputs(spark, sf):
    out = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    pairs = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("bc_id"), ((F.col("n_nationkey") + 1) % 25).alias("rgc_id")
    )
    return K.pair_two_inputs(pairs, out, "c_nationkey", ("bc_id", "rgc_id"), ["n"])


@query(
    "WITH c AS (SELECT source, toxic, max(n_chars) AS longest FROM documents JOIN labels USING (doc_id) GROUP BY ALL) "
    "SELECT a.source, a.longest AS longest_with, b.longest AS longest_without FROM c a JOIN c b ON a.source = b.source AND a.toxic = 1 AND b.toxic = 0"
)
def with_without_pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    per = d.groupBy("source", "toxic").agg(F.max("n_chars").alias("longest"))
    return K.with_without_pairs(per, "toxic", ["source"], "longest")


@query(
    "SELECT c_custkey, p.preprocess_id, p.window_length FROM customer, "
    "(VALUES (1, 60.0::DOUBLE), (2, 0.0::DOUBLE), (3, 5.0::DOUBLE)) p(preprocess_id, window_length)"
)
def cross_params(spark, sf):
    params = [{"preprocess_id": i, "window_length": w} for i, w in ((1, 60.0), (2, 0.0), (3, 5.0))]
    return K.cross_params(table(spark, sf, "customer").select("c_custkey"), params)


@query(
    "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders "
    "WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"
)
def populate(spark, sf):
    orders = table(spark, sf, "orders")
    done = orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct()

    def make(src):
        return src.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return K.populate(orders, done, ["o_custkey"], make)


@query(
    "WITH t AS (SELECT o_custkey, min(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
    "r AS (SELECT o_custkey, min(o_orderdate) AS seen FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) "
    "SELECT * FROM t UNION ALL SELECT * FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM t)"
)
def insert_skip_duplicates(spark, sf):
    o = table(spark, sf, "orders")
    known = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("seen"))
    new = o.filter("o_orderstatus != 'F'").select("o_custkey", F.col("o_orderdate").alias("seen"))
    return K.insert_skip_duplicates(known, new, ["o_custkey"])


@query(
    "WITH s AS (SELECT l_suppkey AS s_suppkey, max(l_tax) AS tax, max(l_extendedprice) AS disc FROM lineitem GROUP BY 1), "
    "n AS (SELECT l_suppkey AS s_suppkey, max(l_tax) AS tax, max(l_extendedprice) AS disc FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "
    "SELECT s.s_suppkey FROM s JOIN n USING (s_suppkey) WHERE s.tax IS DISTINCT FROM n.tax OR s.disc IS DISTINCT FROM n.disc "
    "UNION ALL SELECT -1"
)
def insert_or_check(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    made = [F.max("l_tax").alias("tax"), F.max("l_extendedprice").alias("disc")]
    stored = l.groupBy("s_suppkey").agg(*made)
    offered = l.filter("l_returnflag = 'R'").groupBy("s_suppkey").agg(*made)
    # The row of -1 keeps the result non-empty when nothing differs.
    ok = l.sparkSession.sql("SELECT -1L AS s_suppkey")
    return K.insert_conflicts(stored, offered, ["s_suppkey"], ["tax", "disc"]).unionByName(ok)


@query(
    "SELECT c_custkey, coalesce(o.seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN "
    "(SELECT o_custkey, min(o_orderpriority) AS seg FROM orders GROUP BY 1) o ON o_custkey = c_custkey"
)
def update_rows(spark, sf):
    up = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return K.update_rows(c, up, ["c_custkey"], ["c_mktsegment"])


@query(
    "WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), "
    "o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)) "
    "SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) "
    "UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o "
    "UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN "
    "(SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))"
)
def delete_cascade(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    links = {"orders": ("customer", ["c_custkey"]), "lineitem": ("orders", ["o_orderkey"])}
    left = K.delete_cascade({"customer": c, "orders": o, "lineitem": l}, links, "customer", c.filter("c_acctbal < 0"), ["c_custkey"])
    first = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "o_orderkey"}
    sums = {n: d.agg(F.count("*").alias("n"), F.sum(first[n]).alias("key_sum")) for n, d in left.items()}
    return K.union_all(sums, "name")


@query("SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def check_foreign_keys(spark, sf):
    parent = table(spark, sf, "orders").filter("o_orderstatus != 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    return K.check_foreign_keys(table(spark, sf, "lineitem"), parent, ["l_orderkey"])


@query(
    "SELECT 'customer' AS origin, c_nationkey AS nationkey, c_acctbal AS balance FROM customer "
    "UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier"
)
def union_all(spark, sf):
    c = K.project_rename(table(spark, sf, "customer"), nationkey="c_nationkey", balance="c_acctbal")
    s = K.project_rename(table(spark, sf, "supplier"), nationkey="s_nationkey", balance="s_acctbal")
    return K.union_all({"customer": c, "supplier": s}, "origin")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_difference(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return K.key_difference(a, table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query(
    "WITH t AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS part FROM orders), h AS (SELECT k, count(*) AS n FROM t GROUP BY 1) "
    "SELECT count(*) FILTER (WHERE n > 1) AS n_shared, count(*) FILTER (WHERE n IS NULL) AS n_missing, "
    "count(*) FILTER (WHERE c_custkey IS NULL) AS n_foreign FROM h FULL JOIN customer ON k = c_custkey"
)
def assert_disjoint_cover(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    parts = {s: o.filter(F.col("o_orderstatus") == s) for s in "FOP"}
    return K.assert_disjoint_cover(parts, table(spark, sf, "customer"), ["c_custkey"])


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf):
    return K.distinct_rows(table(spark, sf, "documents"), ["lang", "source"])


@query(
    "SELECT c_custkey, round(c_acctbal - f.m, 6) AS diff, m IS NOT NULL AS has_partner FROM customer LEFT JOIN "
    "(SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON o_custkey = c_custkey"
)
def left_align(spark, sf):
    f = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = K.left_align(c, f, ["c_custkey"], diff=F.round(F.col("c_acctbal") - F.col("m"), 6), has_partner=F.col("m").isNotNull())
    return out.select("c_custkey", "diff", "has_partner")


@query(
    "SELECT doc_id, coalesce(quality, -1) AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'"
)
def update_from(spark, sf):
    docs = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    return K.update_from(docs, table(spark, sf, "labels"), ["doc_id"], {"quality": -1, "toxic": None})


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label FROM documents")
def mark_membership(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return K.mark_membership(docs, table(spark, sf, "labels"), ["doc_id"], "has_label")


@query(
    "SELECT coalesce(o_custkey, c_custkey) AS c_custkey, c_mktsegment, n_orders FROM customer FULL JOIN "
    "(SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def merge_keys(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return K.merge_keys(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), n, ["c_custkey"])


@query(
    "SELECT token, count(*) AS n_rows, min(p_partkey) AS first_p_partkey FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) "
    "GROUP BY 1 HAVING count(*) > 1"
)
def alias_conflicts(spark, sf):
    return K.alias_conflicts(table(spark, sf, "part"), "p_partkey", "p_name", " ")


@query("SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_returnflag = 'R'")
def drop_constant_columns(spark, sf):
    l = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    return K.drop_constant_columns(l, ["l_returnflag"])


@query(
    "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) <= 1e-8::DOUBLE + 0.5::DOUBLE * abs(min(o_totalprice)) AS is_unique FROM orders GROUP BY 1"
)
def check_unique(spark, sf):
    return K.check_unique(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", rtol=0.5)


@query(
    "SELECT user_id, count(*) AS n, max(i) AS last_i, round(max(t), 6) AS last_t FROM samples GROUP BY 1", use="samples", name="sample_index"
)
def sample_index(spark, sf):
    return samples(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("i").alias("last_i"), F.round(F.max("t"), 6).alias("last_t")
    )
