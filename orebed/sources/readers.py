"""Readers of the logical tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REVIEW = "date string, user_id string, business_id string, stars double"
BUSINESS = "business_id string, city string"
USER_BUSINESS = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"
PAIR = "business_id_1 string, business_id_2 string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, compat_header: bool = False, min_partitions: int | None = None) -> DataFrame:
    """CSV with a header line.  ``compat_header`` also drops later lines equal to the column names.  ``min_partitions``
    is a hint to the scan, which splits its files into at least so many parts where they are large enough; nothing is shuffled."""
    if min_partitions:
        spark.conf.set("spark.sql.files.minPartitionNum", str(min_partitions))
    df = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    if compat_header:
        first = df.columns[0]
        df = df.filter(df[first].isNull() | (df[first] != first))
    return df


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, REVIEW)


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, BUSINESS)


def user_business(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, USER_BUSINESS, **options)


def ratings(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, RATING, **options)


def truth_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAIR)
