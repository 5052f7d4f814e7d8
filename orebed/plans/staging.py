"""Tables that iterative plans write between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table (keys, neighbours, labels) that travels to all tasks instead of a shuffle of what it joins.
LIGHT_ROWS = 1_000_000


#: Spark's setting by which the shuffles of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a folder of this machine is made and set in local mode; a cluster
    has no such folder, so there the call raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="orebed-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, executors may be lost, and its shuffles are removed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/orebed/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def light(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and broadcast where it is small."""
    found = staged(df, name)
    return F.broadcast(found) if found.count() <= LIGHT_ROWS else found


def discard(df: DataFrame) -> None:
    """Remove the table of a ``staged`` round that no later plan reads."""
    delete(df.sparkSession, df.staged_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its filesystem: one without a scheme means the cluster's default, not the executor's disk."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
