"""The star-schema test tables as the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, user_id, business_id, stars: an order line is a review of its supplier."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), (F.col("l_quantity") / 10).alias("stars"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, city: a supplier's nation."""
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("city"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id (order), business_id (brand): who bought what, with repeats."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("user_id"), F.col("p_brand").alias("business_id"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id, stars, is_test: a customer's mean rating of a supplier; a fifth is test."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = both.repartition("o_custkey")  # a user's rows together, also for what is counted by user later
    found = both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id")).agg((F.avg("l_quantity") / 10).alias("stars"), F.min("l_orderkey").alias("o"))
    return found.select("user_id", "business_id", "stars", (F.col("o") % 5 == 0).alias("is_test"))


def split(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test."""
    return rated.filter("not is_test").drop("is_test"), rated.filter("is_test").drop("is_test")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id (document), user_id (token): distinct lower-cased words between blanks."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("business_id"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("user_id"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id (hour): distinct hours in which a user acted."""
    events = load(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("business_id"))
    return events.distinct()
