"""Counts, top-k, averages after a join, and partition sizes of review tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.functions.scalars import in_year


def review_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count(F.lit(1)).alias("n_review"))


def review_count_year(reviews: DataFrame, year: int) -> DataFrame:
    return reviews.agg(F.count_if(in_year(F.col("date"), year)).alias("n_review"))


def distinct_count(reviews: DataFrame, key: str, name: str) -> DataFrame:
    return reviews.agg(F.countDistinct(key).alias(name))


def top_k(reviews: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with most rows: count falling, key rising."""
    counts = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_review"))
    return counts.orderBy(F.desc("n_review"), key).limit(k)


def pair_list(top: DataFrame, key: str) -> DataFrame:
    """A top-k table as one string [["id",n],...]."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n_review")).alias("n"), F.col(key).alias("k"))))
    text = F.transform(rows, lambda r: F.concat(F.lit('["'), r["k"].cast("string"), F.lit('",'), (-r["n"]).cast("string"), F.lit("]")))
    return top.agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("top"))


def review_report(reviews: DataFrame, year: int, k: int = 10) -> DataFrame:
    """One row: n_review, n_review_year, n_user, top_user, n_business, top_business."""
    counts = reviews.agg(
        F.count(F.lit(1)).alias("n_review"),
        F.count_if(in_year(F.col("date"), year)).alias("n_review_year"),
        F.countDistinct("user_id").alias("n_user"),
        F.countDistinct("business_id").alias("n_business"),
    )
    users = pair_list(top_k(reviews, "user_id", k), "user_id").withColumnRenamed("top", "top_user")
    shops = pair_list(top_k(reviews, "business_id", k), "business_id").withColumnRenamed("top", "top_business")
    return counts.crossJoin(users).crossJoin(shops)  # three tables of one row each


def average_by_city(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """city, stars: mean over reviews of known businesses; mean falling, city rising."""
    joined = reviews.select("business_id", "stars").join(businesses.select("business_id", "city"), "business_id")
    return joined.groupBy("city").agg(F.avg("stars").alias("stars")).orderBy(F.desc("stars"), "city")


def partition_sizes(df: DataFrame) -> DataFrame:
    """partition, n_items for each partition that has rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_items"))


def partition_report(reviews: DataFrame, n_partition: int, key: str = "business_id", k: int = 10) -> dict:
    """Sizes and the time of a top-k count, for the table's own partitions and for ``n_partition`` by key."""
    out = {}
    for name, df in (("default", reviews), ("customized", reviews.repartition(n_partition, key))):
        sizes = [r["n_items"] for r in partition_sizes(df).orderBy("partition").collect()]
        began = time.time()
        top_k(df, key, k).collect()
        out[name] = {"n_partition": len(sizes), "n_items": sizes, "exe_time": time.time() - began}
    out["explanation"] = "Rows of one key meet in one partition already, so counting by key needs no further exchange."
    return out


def first_rows_report(sorted_rows: DataFrame, k: int = 10) -> dict:
    """Seconds to take the first k rows of a sorted table after collecting all of it (m1) and by a limit (m2)."""
    began = time.time()
    sorted_rows.collect()[:k]
    middle = time.time()
    sorted_rows.limit(k).collect()
    return {"m1": middle - began, "m2": time.time() - middle, "explanation": "A limit sends k rows of each partition to the driver, not the table."}
