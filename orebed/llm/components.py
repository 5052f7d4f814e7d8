"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) undirected links of longs -> (node, root): root is the smallest node reachable.

    Nodes without a link to another node are not returned.  Self links and repeated links are
    ignored; rows with a null end are ignored; an empty table gives an empty table.  Each round is
    two aggregations and two joins (hubs are split by the adaptive skew join) and is written to
    the shared folder.  No row goes to the driver but a count and a checksum.  Should ``rounds``
    not suffice the function raises instead of returning a partial result.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = links.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct()
    edges = staged(edges, "links")
    state = _digest(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: neighbours above u join the least of u's neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        )
        # small star: neighbours below u, and u, join the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        old, edges = edges, staged(small, "links")
        discard(old)
        before, state = state, _digest(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
