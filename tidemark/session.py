"""Settings that the operators need from a session, and what they share: lineage cuts and row numbers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver imports it from."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    share_code(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "tidemark-checkpoints").as_uri()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that steps after it neither repeat it nor lose it with an
    executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a URI, which goes when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return store.makeQualified(path).toString().replace("file:/", "file:///", 1) if store.getScheme() == "file" else store.makeQualified(path).toString()


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with a column that numbers its rows in order, from ``first`` on, without bringing them to one task.

    Rows are range-sorted and kept; the numbers before each task's rows, one row a task, are then joined to them.
    """
    at = "_at"
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    before, total = [], first
    for r in counts:
        before.append((r["p"], total))
        total += r["n"]
    table = df.sparkSession.createDataFrame(before, "_p bigint, _before bigint")
    out = rows.withColumn("_p", part).join(F.broadcast(table), "_p")
    return out.withColumn(name, F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_before", at)
