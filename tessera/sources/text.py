"""Text sources and sinks: CSV tables, INI headers, tree nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_position_table(spark: SparkSession, path: str, colmap: dict[str, str], keys: DataFrame, on: list[str]) -> DataFrame:
    """Positions from a CSV with configurable column names, matched to keys; two rows per key are an error.

    ``colmap`` maps our names to the names in the file; ``date`` is written as ``yyyyMMdd``.
    """
    raw = spark.read.option("header", True).csv(path)
    t = raw.select(*[F.col(f"`{c}`").alias(n) for n, c in colmap.items()])
    if "date" in colmap:
        t = t.withColumn("date", F.to_date("date", "yyyyMMdd"))
    values = [c for c in colmap if c not in on]
    types = dict(keys.dtypes)
    t = t.select(*[F.col(k).cast(types[k]).alias(k) for k in on], *[F.col(v).cast("double").alias(v) for v in values])
    one = t.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values])
    bad = F.raise_error(F.lit("several rows for one key in the position table")).cast("double")
    one = one.select(*on, *[F.when(F.col("_n") > 1, bad).otherwise(F.col(v)).alias(v) for v in values])
    return keys.join(one, on)


def read_dated_settings(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Sparse settings by date; empty cells are null."""
    schema = ", ".join(["date date", *[f"{c} double" for c in columns]])
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """INI files as ``(file, section, key, value)``; keys lower case without their prefix up to ``_``.

    Header files are small: one row per file keeps the order of the lines.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    text = F.trim("text")
    head = F.regexp_extract(text, r"^\[(.*)\]$", 1)
    d = lines.withColumn("_h", F.when(head != "", head))
    # A file is one row above, so its lines are few.
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("file", F.last("_h", ignorenulls=True).over(so_far).alias("section"), text.alias("text"))
    d = d.filter(~F.col("text").startswith("[") & ~F.col("text").startswith("#") & ~F.col("text").startswith(";"))
    kv = r"^([^=:]+?)\s*[=:]\s*(.*)$"
    d = d.filter(F.col("text").rlike(kv))
    key = F.regexp_replace(F.lower(F.regexp_extract("text", kv, 1)), "^[^_]*_", "")
    return d.select("file", "section", key.alias("key"), F.regexp_extract("text", kv, 2).alias("value"))


# Header fields and their defaults.
HEADER_FIELDS = ["eye", "setupid", "prepwmorient", "prepwmopticdiscpos", "animspecies", "pharmdrug"]


def normalize_header(kv: DataFrame, by: list[str]) -> DataFrame:
    """One row per header with defaults, lower case, orientation codes and the optic disc position."""
    h = kv.groupBy(*by).pivot("key", HEADER_FIELDS).agg(F.first("value"))
    get = {f: F.coalesce(F.col(f), F.lit("")) for f in HEADER_FIELDS}
    o = get["prepwmorient"]
    orient = F.when(o == "", 0).when((F.lower(o) == "unknown") | (o.try_cast("int") == 111), -1).otherwise(o.try_cast("int"))
    body = F.regexp_replace(get["prepwmopticdiscpos"], r"^[() ]+|[() ]+$", "")
    parts = F.split(body, F.when(body.contains(";"), F.lit(";")).otherwise(F.lit(",")))
    x, y, z = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    ok = (F.size(parts) >= 2) & ((F.length(x) > 0) | (F.length(y) > 0))
    drug = F.lower(get["pharmdrug"])
    none = drug.isin("", "none")
    return h.select(
        *by, F.when(get["eye"] == "", "unknown").otherwise(get["eye"]).alias("eye"), get["setupid"].alias("setupid"), orient.alias("prepwmorient"),
        F.when(ok, x.try_cast("double")).otherwise(0.0).alias("odx"), F.when(ok, y.try_cast("double")).otherwise(0.0).alias("ody"),
        F.when(ok, F.coalesce(z.try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("odz"), ok.cast("int").alias("od_ini_flag"),
        F.when(get["animspecies"] == "", "mouse").otherwise(F.lower(get["animspecies"])).alias("animspecies"),
        F.when(none, "none").otherwise(drug).alias("drug"), (~none).cast("int").alias("pharmaflag"),
    )


def check_same_headers(kv: DataFrame, folder: str, file: str) -> DataFrame:
    """Per folder: number of header files and of keys on which they differ (missing counts as different)."""
    files = kv.groupBy(folder).agg(F.count_distinct(file).alias("n_files"))
    per = kv.groupBy(folder, "key").agg(F.count_distinct("value").alias("_v"), F.count_distinct(file).alias("_f")).join(files, folder)
    return per.groupBy(folder, "n_files").agg(F.count_if((F.col("_v") > 1) | (F.col("_f") < F.col("n_files"))).alias("n_different"))


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of tree files: ``file, n, type, x, y, z, radius, parent``; ``#`` starts a comment."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    d = raw.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("_t")).filter("_t != '' and not startswith(_t, '#')")
    p = F.split("_t", r"\s+")
    cols = [("n", "long"), ("type", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent", "long")]
    return d.select("file", *[F.get(p, i).cast(t).alias(c) for i, (c, t) in enumerate(cols)])


def write_swc(nodes: DataFrame, cell: str, path: str, comment: str | None = None) -> None:
    """Nodes as text, one folder per cell, in the order of their numbers, below an optional comment."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n", "type", "x", "y", "z", "radius", "parent")])
    d = nodes.select(cell, F.col("n").alias("_o"), line.alias("value"))
    if comment:
        head = nodes.select(cell).distinct().select(cell, F.lit(-1).cast("long").alias("_o"), F.lit(f"# {comment}").alias("value"))
        d = head.unionByName(d)
    d.repartitionByRange(cell, "_o").sortWithinPartitions(cell, "_o").select(cell, "value").write.partitionBy(cell).text(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.option("header", True) if fmt == "csv" else df.write
    w.format(fmt).save(path)
