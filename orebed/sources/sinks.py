"""Report and file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.plans.staging import delete


def quoted_tuple(items: Column) -> Column:
    """``('a')`` or ``('a', 'b')``."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """(size, line): all itemsets of one size in one line, in order.  ``itemsets`` has items (array)."""
    rows = itemsets.select(F.size("items").alias("size"), "items")
    lines = rows.groupBy("size").agg(F.array_sort(F.collect_list("items")).alias("sets"))
    return lines.select("size", F.array_join(F.transform("sets", quoted_tuple), ",").alias("line"))


def itemset_text(candidates: DataFrame, frequent: DataFrame) -> str:
    """The text of the candidates and frequent itemsets report (small: one line for each size)."""
    part = lambda df: "\n\n".join(r["line"] for r in itemset_report(df).orderBy("size").collect())
    return f"Candidates:\n{part(candidates)}\n\nFrequent Itemsets:\n{part(frequent)}\n"


def community_report(communities: DataFrame) -> DataFrame:
    """(size, line) of communities (members array): ``'u1', 'u2'`` by size, then members."""
    line = F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'"))
    return communities.select(F.size("members").alias("size"), "members", line.alias("line")).orderBy("size", "members").drop("members")


def betweenness_report(edges: DataFrame) -> DataFrame:
    """``('a', 'b'), 1.5`` by falling value, then edge."""
    line = F.concat(quoted_tuple(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))), F.lit(", "), F.col("betweenness").cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """A folder with one text file of the column ``line``, in the order of the column ``at`` or else of the rows of ``lines``."""
    if "at" not in lines.columns:
        lines = lines.select("line", F.monotonically_increasing_id().alias("at"))
    lines.repartition(1).sortWithinPartitions("at").select("line").write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str) -> None:
    """As ``write_text``, but ``path`` is the file itself, on whatever filesystem it names."""
    spark = lines.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    write_text(lines, folder)
    where = spark._jvm.org.apache.hadoop.fs.Path
    files = where(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(where(folder)) if f.getPath().getName().startswith("part-"))
    files.delete(where(path), True)
    files.rename(part, where(path))
    delete(spark, folder)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def plain_lines(df: DataFrame, separator: str = ",", header_separator: str | None = None) -> DataFrame:
    """line, at: a header line (at -1), then the rows in their order, values joined without any quoting."""
    head = (header_separator or separator).join(df.columns)
    line = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    rows = df.select(line.alias("line"), F.monotonically_increasing_id().alias("at"))
    return df.sparkSession.createDataFrame([(head, -1)], "line string, at long").union(rows)
