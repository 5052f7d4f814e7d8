"""What the corpus operators share: shared-folder tables, Python shipping, fixed small maths."""

from __future__ import annotations

import math
import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import orebed
from orebed.plans.staging import discard, shared_dir, staged

__all__ = ["buckets", "chi2_quantile", "discard", "free_name", "ready", "scratch", "shared_dir", "staged", "table", "unsigned_hash"]

#: Bytes and rows of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 500


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session: functions of this package travel by value (executors need no copy of the
    repository), and Arrow batches are bounded in bytes, whatever the texts' lengths."""
    cloudpickle.register_pickle_by_value(orebed)
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/orebed/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def chi2_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty approximation of the chi-squared quantile."""
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return d * (1 - 2 / (9 * d) + lo * math.sqrt(2 / (9 * d))) ** 3


def buckets(n: int, each: int) -> int:
    """How many groups of about ``each`` rows ``n`` rows make."""
    return max(1, -(-n // each))


def unsigned_hash(*cols: Column) -> Column:
    """A non-negative 63-bit hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
