"""Command line: the nine jobs with their positional parameters.

    python -m orebed.cli stats REVIEWS OUT [--year 2018]
    python -m orebed.cli partitions REVIEWS OUT N
    python -m orebed.cli cities REVIEWS BUSINESSES OUT_A OUT_B
    python -m orebed.cli itemsets CASE SUPPORT IN OUT
    python -m orebed.cli large-itemsets THRESHOLD SUPPORT IN OUT
    python -m orebed.cli similar IN OUT [--truth PAIRS]
    python -m orebed.cli predict TRAIN TEST CASE OUT
    python -m orebed.cli labels THRESHOLD IN OUT
    python -m orebed.cli communities THRESHOLD IN OUT_BETWEENNESS OUT_COMMUNITIES

All take --shuffle-partitions N.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.operators import baskets as B
from orebed.operators import graph as G
from orebed.operators import itemsets as I
from orebed.operators import lsh as L
from orebed.operators import recommend as R
from orebed.operators import statistics as S
from orebed.plans.staging import staged
from orebed.sources import readers, sinks


def _dump(report: dict, path: str) -> None:
    with open(path, "w") as out:
        json.dump(report, out, indent=2)


def stats(spark: SparkSession, a) -> None:
    row = S.review_report(readers.reviews(spark, a.reviews), a.year).first()
    _dump(
        {
            "n_review": row["n_review"], f"n_review_{a.year}": row["n_review_year"], "n_user": row["n_user"],
            "top10_user": json.loads(row["top_user"]), "n_business": row["n_business"], "top10_business": json.loads(row["top_business"]),
        },
        a.out,
    )


def partitions(spark: SparkSession, a) -> None:
    _dump(S.partition_report(readers.reviews(spark, a.reviews), a.n), a.out)


def cities(spark: SparkSession, a) -> None:
    found = S.average_by_city(readers.reviews(spark, a.reviews), readers.businesses(spark, a.businesses))
    sinks.write_text(sinks.plain_lines(found), a.out_a)
    for row in found.limit(10).collect():
        print(f"{row['city']},{row['stars']:0.1f}")
    _dump(S.first_rows_report(found), a.out_b)


def _numbered(rows: DataFrame) -> DataFrame:
    """Baskets numbered from 0, so that their partition does not depend on their names."""
    ids = L.dense_index(rows, "basket")
    return rows.join(ids, "basket").select(F.col("index").alias("basket"), "item")


def _itemsets(rows: DataFrame, support: int, out: str) -> None:
    rows = _numbered(rows)
    wanted = I.partition_candidates(rows, support)
    with open(out, "w") as file:
        file.write(sinks.itemset_text(wanted, I.count_candidates(rows, wanted, support)))


def itemsets(spark: SparkSession, a) -> None:
    _itemsets(B.baskets(readers.user_business(spark, a.source), a.case), a.support, a.out)


def large_itemsets(spark: SparkSession, a) -> None:
    rows = B.baskets(readers.user_business(spark, a.source), 1)
    _itemsets(B.larger_than(rows, a.threshold), a.support, a.out)


def similar(spark: SparkSession, a) -> None:
    count, bands = L.PRESETS["pairs"]
    found = staged(L.similar_pairs(readers.user_business(spark, a.source).distinct(), 0.5, count, bands), "similar")
    named = found.orderBy("a", "b").select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity")
    sinks.write_file(sinks.plain_lines(named, header_separator=", "), a.out)
    if a.truth:
        low, high = F.least("business_id_1", "business_id_2"), F.greatest("business_id_1", "business_id_2")
        truth = readers.truth_pairs(spark, a.truth).select(low.alias("a"), high.alias("b")).distinct()
        print(L.precision_recall(found, truth).first().asDict())


def predict(spark: SparkSession, a) -> None:
    train, test = readers.ratings(spark, a.train), readers.ratings(spark, a.test)
    sinks.write_file(sinks.plain_lines(R.predict(train, test, a.case), header_separator=", "), a.out)


def _edges(spark: SparkSession, a) -> DataFrame:
    return B.co_occurrence(B.baskets(readers.user_business(spark, a.source), 2), a.threshold)


def labels(spark: SparkSession, a) -> None:
    sinks.write_text(sinks.community_report(G.communities(G.label_propagation(_edges(spark, a)))), a.out)


def communities(spark: SparkSession, a) -> None:
    edges = _edges(spark, a)
    sinks.write_text(sinks.betweenness_report(G.edge_betweenness(edges)), a.out_betweenness)
    found = G.girvan_newman(edges)
    sinks.write_text(sinks.community_report(G.communities(found, "community")), a.out_communities)
    size = F.count(F.lit(1)).over(Window.partitionBy("community"))
    print(found.select("community", "modularity", size.alias("size")).distinct().agg(F.first("modularity").alias("modularity"), F.count(F.lit(1)).alias("communities")).first().asDict())


JOBS = {
    "stats": (stats, ["reviews", "out"]), "partitions": (partitions, ["reviews", "out", "n:int"]), "cities": (cities, ["reviews", "businesses", "out_a", "out_b"]),
    "itemsets": (itemsets, ["case:int", "support:int", "source", "out"]), "large-itemsets": (large_itemsets, ["threshold:int", "support:int", "source", "out"]),
    "similar": (similar, ["source", "out"]), "predict": (predict, ["train", "test", "case:int", "out"]), "labels": (labels, ["threshold:int", "source", "out"]),
    "communities": (communities, ["threshold:int", "source", "out_betweenness", "out_communities"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orebed")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, (_, parameters) in JOBS.items():
        job = jobs.add_parser(name)
        for p in parameters:
            key, _, kind = p.partition(":")
            job.add_argument(key, type=int if kind else str)
        job.add_argument("--shuffle-partitions", type=int)
        if name == "stats":
            job.add_argument("--year", type=int, default=2018)
        if name == "similar":
            job.add_argument("--truth")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"orebed {a.job}").getOrCreate()
    if a.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.shuffle_partitions))
    JOBS[a.job][0](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
