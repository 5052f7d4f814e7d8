"""Baskets and pairs of items that share baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.operators.meetings import pairs
from orebed.plans.staging import staged


def baskets(rows: DataFrame, case: int = 1) -> DataFrame:
    """Distinct (basket, item): users' businesses (case 1) or businesses' users (case 2)."""
    if case not in (1, 2):
        raise ValueError(f"case is 1 or 2, not {case!r}")
    key, item = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    return rows.select(F.col(key).alias("basket"), F.col(item).alias("item")).distinct()


def larger_than(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows of the baskets with more than ``threshold`` items."""
    large = rows.groupBy("basket").count().filter(F.col("count") > threshold).select("basket")
    return rows.join(large, "basket", "left_semi")


def as_lists(rows: DataFrame) -> DataFrame:
    """basket, items (sorted array)."""
    return rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def item_domain(rows: DataFrame) -> DataFrame:
    return rows.select("item").distinct()


def co_occurrence(rows: DataFrame, least: int) -> DataFrame:
    """src < dst and weight: pairs of items in ``least`` baskets or more, each pair once.  ``rows`` are distinct (basket, item)."""
    rows = staged(rows.select(F.col("item").alias("a"), F.col("basket").alias("over")), "baskets")
    return pairs(rows, least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))
