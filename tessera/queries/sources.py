"""Queries for sources, sinks and file names. Text files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files as N
from ..sources import text as X
from .fixtures import table
from .registry import query


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@query("SELECT o_custkey AS exp_num, o_orderdate::DATE AS date, o_orderkey AS field, round(o_totalprice, 2) AS vd, (o_orderkey % 97)::DOUBLE AS tn FROM orders WHERE o_orderstatus = 'F'")
def read_position_table(spark, sf):
    o, path = table(spark, sf, "orders"), scratch_path(spark, "positions")
    csv = o.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("Exp Num"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("o_orderkey").alias("field_name"),
        F.col("o_totalprice").alias("VD"), (F.col("o_orderkey") % 97).alias("TN"),
    )
    X.write_table(csv, path)
    keys = o.select(F.col("o_custkey").alias("exp_num"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("field"))
    cols = {"exp_num": "Exp Num", "date": "day", "field": "field_name", "vd": "VD", "tn": "TN"}
    return _r(X.read_position_table(spark, path, cols, keys, ["exp_num", "date", "field"]), 2, "vd")


@query("SELECT o_orderdate::DATE AS date, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS setup1, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS setup2 FROM orders GROUP BY 1")
def read_dated_settings(spark, sf):
    path = scratch_path(spark, "settings")
    s = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("setup1"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("setup2")
    )
    s.write.option("header", True).option("sep", ";").csv(path)
    return X.read_dated_settings(spark, path, ["setup1", "setup2"])


def _headers(spark, sf):
    """One header file per nation, from its suppliers."""
    path = scratch_path(spark, "headers")
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("k"))
    k = F.col("k")
    eye = F.when(k % 3 == 0, "left").when(k % 3 == 1, "right").otherwise("")
    orient = F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "111").when(k % 4 == 2, "").otherwise((k % 360).cast("string"))
    disc = F.when(k % 3 == 0, F.concat(F.lit("("), k.cast("string"), F.lit("; "), (k + 1).cast("string"), F.lit(")"))).when(k % 3 == 1, F.concat((k + 1).cast("string"), F.lit(",2,3"))).otherwise("")
    text = F.concat_ws(
        "\n", F.lit("# made from suppliers"), F.lit("[General]"), F.concat(F.lit("string_Eye="), eye), F.concat(F.lit("string_setupID = "), (k % 3 + 1).cast("string")),
        F.lit(""), F.lit("[Prep]"), F.concat(F.lit("float_prepWMOrient="), orient), F.concat(F.lit("string_prepWMOpticDiscPos="), disc),
        F.concat(F.lit("string_pharmDrug="), F.when(k % 5 == 0, "TTX").otherwise("")),
    )
    s.select(F.col("s_nationkey").alias("exp"), text.alias("value")).repartition("exp").write.partitionBy("exp").text(path)
    return path


_SUP = "sp AS (SELECT s_nationkey AS exp, max(s_suppkey) AS k FROM supplier GROUP BY 1)"
_EYE = "CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE '' END"
_DISC = "CASE k % 3 WHEN 0 THEN '(' || k || '; ' || (k + 1) || ')' WHEN 1 THEN (k + 1) || ',2,3' ELSE '' END"
_ORI = "CASE k % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '111' WHEN 2 THEN '' ELSE (k % 360)::VARCHAR END"


@query(
    f"WITH {_SUP} SELECT exp, 'General' AS section, 'eye' AS key, {_EYE} AS value FROM sp UNION ALL SELECT exp, 'General', 'setupid', (k % 3 + 1)::VARCHAR FROM sp UNION ALL SELECT exp, 'Prep', 'prepwmorient', {_ORI} FROM sp "
    f"UNION ALL SELECT exp, 'Prep', 'prepwmopticdiscpos', {_DISC} FROM sp UNION ALL SELECT exp, 'Prep', 'pharmdrug', CASE k % 5 WHEN 0 THEN 'TTX' ELSE '' END FROM sp"
)
def read_ini(spark, sf):
    kv = X.read_ini(spark, _headers(spark, sf))
    return kv.select(F.regexp_extract("file", "exp=([0-9]+)", 1).cast("int").alias("exp"), "section", "key", "value")


@query(
    f"WITH {_SUP} SELECT exp, CASE WHEN {_EYE} = '' THEN 'unknown' ELSE {_EYE} END AS eye, (k % 3 + 1)::VARCHAR AS setupid, CASE k % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE CASE WHEN k % 360 = 111 THEN -1 ELSE k % 360 END END::INTEGER AS prepwmorient, "
    "CASE k % 3 WHEN 0 THEN k WHEN 1 THEN k + 1 ELSE 0 END::DOUBLE AS odx, CASE k % 3 WHEN 0 THEN k + 1 WHEN 1 THEN 2 ELSE 0 END::DOUBLE AS ody, CASE k % 3 WHEN 1 THEN 3 ELSE 0 END::DOUBLE AS odz, (k % 3 < 2)::INTEGER AS od_ini_flag, "
    "'mouse' AS animspecies, CASE k % 5 WHEN 0 THEN 'ttx' ELSE 'none' END AS drug, (k % 5 = 0)::INTEGER AS pharmaflag FROM sp"
)
def normalize_header(spark, sf):
    kv = X.read_ini(spark, _headers(spark, sf)).withColumn("exp", F.regexp_extract("file", "exp=([0-9]+)", 1).cast("int"))
    return X.normalize_header(kv, ["exp"])


@query(
    "WITH kv AS (SELECT o_custkey AS folder, o_orderkey AS file, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'setup', (o_custkey % 3)::VARCHAR FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'rare', 'x' FROM orders WHERE o_orderpriority = '1-URGENT'), "
    "f AS (SELECT folder, count(DISTINCT file) AS n FROM kv GROUP BY 1), p AS (SELECT folder, key, count(DISTINCT value) AS v, count(DISTINCT file) AS c FROM kv GROUP BY 1, 2) "
    "SELECT folder, any_value(n) AS n_files, count(*) FILTER (WHERE v > 1 OR c < n) AS n_different FROM p JOIN f USING (folder) GROUP BY 1"
)
def check_same_headers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("file"), "o_orderstatus", "o_orderpriority")
    kv = o.select("folder", "file", F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"))
    kv = kv.unionByName(o.select("folder", "file", F.lit("setup").alias("key"), (F.col("folder") % 3).cast("string").alias("value")))
    kv = kv.unionByName(o.filter("o_orderpriority = '1-URGENT'").select("folder", "file", F.lit("rare").alias("key"), F.lit("x").alias("value")))
    return X.check_same_headers(kv, "folder", "file")


def _swc(spark, sf):
    path = scratch_path(spark, "trees")
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    n = p.select(
        (k % 10).alias("cell"), F.expr("p_partkey div 10").alias("n"), F.when(k < 10, 1).otherwise(3).alias("type"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"),
        F.lit(0.5).alias("z"), F.lit(1.0).alias("radius"), F.when(k < 10, -1).otherwise(F.expr("p_partkey div 20")).cast("long").alias("parent"),
    )
    X.write_swc(n, "cell", path, "made from parts")
    return path


@query("SELECT (p_partkey % 10)::INTEGER AS cell, p_partkey // 10 AS n, CASE WHEN p_partkey < 10 THEN 1 ELSE 3 END AS type, p_retailprice AS x, p_size::DOUBLE AS y, 0.5::DOUBLE AS z, 1.0::DOUBLE AS radius, CASE WHEN p_partkey < 10 THEN -1 ELSE p_partkey // 20 END AS parent FROM part")
def read_swc(spark, sf):
    d = X.read_swc(spark, _swc(spark, sf))
    return d.withColumn("cell", F.regexp_extract("file", "cell=([0-9]+)", 1).cast("int")).drop("file")


@query("SELECT (p_partkey % 10)::INTEGER AS cell, count(*) + 1 AS n_lines FROM part GROUP BY 1")
def write_swc(spark, sf):
    return spark.read.text(_swc(spark, sf)).groupBy("cell").agg(F.count("*").alias("n_lines"))


@query("SELECT c_custkey, c_name FROM customer")
def write_table(spark, sf):
    path = scratch_path(spark, "keys")
    X.write_table(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    return spark.read.option("header", True).schema("c_custkey bigint, c_name string").csv(path)


@query("SELECT DISTINCT 'exp=' || s_nationkey AS folder FROM supplier")
def list_files(spark, sf):
    d = N.list_files(spark, _headers(spark, sf), ".txt", ignore_hidden=True)
    return d.select(F.element_at(F.split("folder", "/"), -1).alias("folder"))


_FILES = (
    "fl AS (SELECT o_orderkey AS k, o_custkey AS exp, '/data/' || o_custkey || '/Pre/SMP_M' || o_orderkey % 3 || '_' || CASE o_custkey % 2 WHEN 0 THEN 'LR' ELSE 'RR' END || '_' || CASE o_orderkey % 7 WHEN 5 THEN 'OD' || o_orderkey % 2 WHEN 6 THEN 'Outline' ELSE 'GCL' || o_orderkey % 7 END "
    "|| '_' || ['chirp', 'gChirp', 'noise', 'HRstack'][(o_orderkey % 4 + 1)::INTEGER] || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_control' ELSE '_drug' END || '.h5' AS file FROM orders)"
)


def _files(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    field = F.when(k % 7 == 5, F.concat(F.lit("OD"), (k % 2).cast("string"))).when(k % 7 == 6, "Outline").otherwise(F.concat(F.lit("GCL"), (k % 7).cast("string")))
    stim = F.element_at(F.array(*[F.lit(s) for s in ("chirp", "gChirp", "noise", "HRstack")]), (k % 4 + 1).cast("int"))
    cond = F.when(k % 3 == 0, "").when(k % 3 == 1, "_control").otherwise("_drug")
    file = F.concat(F.lit("/data/"), c.cast("string"), F.lit("/Pre/SMP_M"), (k % 3).cast("string"), F.lit("_"), F.when(c % 2 == 0, "LR").otherwise("RR"), F.lit("_"), field, F.lit("_"), stim, cond, F.lit(".h5"))
    return table(spark, sf, "orders").select(k.alias("k"), c.alias("exp"), file.alias("file"))


_PARTS = "pt AS (SELECT *, string_split(regexp_replace(string_split(file, '/')[-1], '[.][^.]*$', ''), '_') AS p FROM fl)"


@query(f"WITH {_FILES}, {_PARTS} SELECT k, p[2] AS animal, p[3] AS region, p[4] AS field, p[5] AS stimulus, coalesce(p[6], 'control') AS cond1, p[7] AS extra FROM pt")
def parse_filename(spark, sf):
    locs = {"animal": 1, "region": 2, "field": 3, "stimulus": 4, "cond1": 5, "extra": 6}
    return _files(spark, sf).select("k", *[c.alias(n) for n, c in N.parse_filename(F.col("file"), locs, {"cond1": "control"}).items()])


def _parsed(spark, sf):
    f = _files(spark, sf)
    return f.withColumns(N.parse_filename(F.col("file"), {"region": 2, "field": 3}))


@query(f"WITH {_FILES}, {_PARTS} SELECT exp, p[4] AS field, count(*) AS n_files, min(file) AS first_file, min(p[3]) AS region FROM pt GROUP BY 1, 2")
def files_by_field(spark, sf):
    return N.files_by_field(_parsed(spark, sf), "exp", ["field"])


@query(f"WITH {_FILES}, {_PARTS} SELECT k, exp, file, p[3] AS region, p[4] AS field FROM pt WHERE p[4] LIKE 'GCL%'")
def drop_reference_files(spark, sf):
    return N.drop_reference_files(_parsed(spark, sf), ["od", "outline"], ["exp", "field"]).select("k", "exp", "file", "region", "field")


@query(f"WITH {_FILES}, {_PARTS} SELECT k, lower(p[5]) IN ('chirp', 'noise') AS whole, contains(lower(p[5]), 'chirp') OR contains(lower(p[5]), 'noise') AS part, len(list_filter(p, lambda t: lower(t) IN ('chirp', 'noise'))) > 0 AS anywhere FROM pt")
def match_alias(spark, sf):
    f, a = F.col("file"), F.lit("Chirp_noise")
    return _files(spark, sf).select("k", N.match_alias(f, a, 4).alias("whole"), N.match_alias(f, a, 4, "contains").alias("part"), N.match_alias(f, a).alias("anywhere"))


@query(
    f"WITH {_FILES}, {_PARTS}, pn AS (SELECT exp, p[4] AS field, file, CASE lower(p[5]) WHEN 'hrstack' THEN 3 WHEN 'noise' THEN 1 WHEN 'chirp' THEN 0 ELSE 2 END + CASE WHEN contains(file, '_control') THEN 0 ELSE 100 END AS penalty FROM pt) "
    "SELECT exp, field, min(penalty)::INTEGER AS penalty, arg_min(file, (penalty, file)) AS file FROM pn GROUP BY 1, 2"
)
def preferred_file(spark, sf):
    return N.preferred_file(_parsed(spark, sf), ["exp", "field"], "file", ["chirp", "noise"], ["HRstack"])


@query(
    f"WITH {_FILES}, {_PARTS} SELECT k, exp, file, p[5] AS stim, coalesce(p[6], 'control') AS cond1, CASE lower(p[5]) WHEN 'noise' THEN 'dn' ELSE 'ch' END AS stim_name FROM pt WHERE lower(p[5]) IN ('chirp', 'gchirp', 'noise')"
)
def presentation_files(spark, sf):
    stims = spark.sql("SELECT * FROM VALUES ('ch', 'chirp_gchirp'), ('dn', 'noise_densenoise') t(stim_name, alias)")
    return N.presentation_files(_files(spark, sf), stims, 4, 5)


@query(
    f"WITH {_FILES} SELECT k, file AS pre, replace(replace(file, '/Pre/', '/Masks/'), '.h5', '_ROIs.pkl') AS mask_file FROM fl"
)
def rewrite_path(spark, sf):
    raw = F.when(F.col("k") % 2 == 0, F.regexp_replace(F.regexp_replace("file", "/Pre/SMP_", "/Raw/"), r"\.h5$", ".smp")).otherwise(F.col("file"))
    f = _files(spark, sf).withColumn("pre", N.to_pre_path(raw))
    return f.select("k", "pre", N.to_mask_path(F.col("pre"), "Masks", "SMP_").alias("mask_file"))


@query(
    "WITH a AS (SELECT lpad(c_custkey::VARCHAR, 8, '0') AS id, 'stimuli/stim_' || lpad(c_custkey::VARCHAR, 8, '0') || '.pkl' AS file_a FROM customer WHERE c_acctbal > 0), "
    "b AS (SELECT lpad(c_custkey::VARCHAR, 8, '0') AS id, 'target_pos/target_' || lpad(c_custkey::VARCHAR, 8, '0') || '.pkl' AS file_b FROM customer WHERE c_mktsegment <> 'BUILDING') "
    "SELECT coalesce(a.id, b.id) AS id, file_a, file_b, CASE WHEN file_b IS NULL THEN 'a_only' WHEN file_a IS NULL THEN 'b_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.id = b.id"
)
def matched_files(spark, sf):
    c = table(spark, sf, "customer")
    num = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    a = c.filter("c_acctbal > 0").select(F.concat(F.lit("stimuli/stim_"), num, F.lit(".pkl")).alias("file"))
    b = c.filter("c_mktsegment != 'BUILDING'").select(F.concat(F.lit("target_pos/target_"), num, F.lit(".pkl")).alias("file"))
    return N.matched_files(a, b, 8)


@query(
    "SELECT o_orderkey, md5('[{\"k\":\"priority\",\"v\":\"' || o_orderpriority || '\"},{\"k\":\"status\",\"v\":\"' || o_orderstatus || '\"}]') AS id FROM orders"
)
def content_hash(spark, sf):
    s, p = (F.lit("status"), F.col("o_orderstatus")), (F.lit("priority"), F.col("o_orderpriority"))
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(*s, *p)).otherwise(F.create_map(*p, *s))
    return table(spark, sf, "orders").select("o_orderkey", N.content_hash(m).alias("id"))


@query(
    "SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_stimuli, count(DISTINCT l_linenumber) AS n_samples, count(DISTINCT l_returnflag) * count(DISTINCT l_linenumber) = count(*) AS complete, "
    "count(DISTINCT l_linestatus) = 1 AS one_l_linestatus, count(DISTINCT l_suppkey % 5) = 1 AS one_size FROM lineitem GROUP BY 1"
)
def raw_dataset_checks(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("size", F.col("l_suppkey") % 5)
    return N.raw_dataset_checks(l, ["l_suppkey"], "l_returnflag", "l_linenumber", ["l_linestatus", "size"])


@query("SELECT l_returnflag AS conf, l_linestatus AS noise, (l_linenumber % 2)::INTEGER AS cell, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 0) GROUP BY ALL")
def export_datasets(spark, sf):
    path = scratch_path(spark, "datasets")
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("conf"), F.col("l_linestatus").alias("noise"), (F.col("l_linenumber") % 2).alias("cell"), "l_quantity")
    by = ["conf", "noise", "cell"]
    there = l.filter("conf = 'A' and noise = 'F' and cell = 0").select(*by).distinct()
    N.export_datasets(l, by, path, there)
    return spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n"))
