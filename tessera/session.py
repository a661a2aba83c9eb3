"""Session settings and durable cuts of long lineages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "tessera") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(spark))
    return f"{sc.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written once as Parquet below the shared scratch folder and read back.

    Unlike a checkpoint the planner knows size and columns of what it reads: it prunes columns, and
    broadcasts the table in a join only below its own limit.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Nodes of a plan that are worth running once only; scans, filters and projections are not.
_COSTLY = re.compile(r"^[\s:+\-|]*(?:Join|Aggregate|Window|Generate|Sort|Repartition|RebalancePartitions|Deduplicate|Distinct|MapInPandas|MapInArrow|FlatMapGroups|ArrowEvalPython|BatchEvalPython)", re.MULTILINE)


def once(df: DataFrame) -> DataFrame:
    """``df`` for more than one reader: written if its plan joins, groups, sorts or calls Python, else as it is.

    Without this every step that reads its input twice doubles the scans of all steps before it.
    """
    if df.isStreaming or "void" in df.schema.simpleString():
        return df
    return written(df) if _COSTLY.search(df._jdf.queryExecution().optimizedPlan().toString()) else df
