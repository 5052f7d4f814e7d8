"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Every document of a source is repeated a Poisson number of times whose mean is the repetition rate
that takes the source to its target weight.  The number inverts the Poisson distribution at a
uniform value read from a hash of the document's id and a seed, so it is the same on every run and machine.
A rate beyond ``PART_RATE`` is the sum of equal parts, each inverted at a hash of its own: the distribution table of a source stays
small whatever its rate, and the work for a document follows the number of its copies.
The copies are dealt by a hash of id and copy, which shuffles the mix globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

SEED = "mix"
#: Largest rate that is inverted at once.
PART_RATE = 256
#: Steps of the binary search in a part's distribution table, which has fewer than 512 entries.
HALVES = (256, 128, 64, 32, 16, 8, 4, 2, 1)
#: Parts or copies of one array: larger numbers go through arrays of arrays.
STRIDE = 4096
#: Bytes of rates that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Hexadecimal digits of MD5 that make a uniform value: 52 bits fill a double exactly.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the MD5 of the parts: (52-bit integer + 1/2) / 2^52."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << (4 * DIGITS))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(of, rate, parts, cdf): mean repetitions of each source, the parts they are drawn in, and the Poisson distribution function of a part.

    ``weights`` are relative; a source that is not named gets weight 0.  None gives every source the same
    weight, a null source among them.  ``total`` is the expected number of rows of the mix (None: as many
    as the input).  The distribution function runs to the part's rate plus 12 deviations plus 40, beyond
    which less than 2^-53 is left.  Counts of whole sources are pre-aggregated before the shuffle.
    """
    counts = staged(docs.groupBy(F.col(source_col).alias("of")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        named = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weighed = counts.withColumn("w", F.coalesce(F.element_at(named, F.col("of").cast("string")), F.lit(0.0)))
    sums = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()  # two numbers
    whole = F.lit(total) if total is not None else F.lit(sums["n"])
    rate = F.col("w") / F.lit(sums["w"]) * whole / F.col("n") if sums["w"] else F.lit(0.0)
    found = weighed.select("of", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("long"))
    found = found.withColumn("part", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("part") + 12 * F.sqrt("part") + 40).cast("int"))
    term = lambda a, k: a["t"] + F.log("part") - F.log(k.cast("double"))
    log_term = lambda a, k: F.struct(term(a, k).alias("t"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + F.exp(term(a, k)))).alias("c"))
    first = F.struct((-F.col("part")).alias("t"), F.array(F.exp(-F.col("part"))).alias("c"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(steps, first, log_term)["c"]).otherwise(F.array(F.lit(1.0)))
    return found.select("of", "rate", "parts", cdf.alias("cdf"))


def _strides(low: Column, high: Column) -> Column:
    """Numbers of the strides that hold ``low`` to ``high`` (both from 0, inclusive)."""
    return F.sequence(F.floor(low / STRIDE), F.floor(high / STRIDE))


def _stride(k: Column, high: Column) -> Column:
    """The members up to ``high`` of stride ``k``."""
    return F.sequence(k * STRIDE, F.least(high, k * STRIDE + STRIDE - 1))


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """All columns of ``docs``, a row for each copy, with copy (from 1), copies and mix_key; not yet shuffled.

    Rows with equal ids (or null ids) draw the same number, so repeated rows are repeated alike.  Added columns that clash
    with names of ``docs`` replace them.  Texts are not read.  An empty table returns no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy", "copies", "mix_key") and c not in (id_col, source_col)])
    table = staged(rates(docs, source_col, weights, total), "rates")
    of, cdf, parts, block = (free_name(docs, n) for n in ("of", "cdf", "parts", "block"))
    side = table.select(F.col("of").alias(of), F.col("cdf").alias(cdf), F.col("parts").alias(parts))
    held = table.agg(F.sum(8 * F.size("cdf") + F.coalesce(F.length(F.col("of").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    side = F.broadcast(side) if held <= BROADCAST_BYTES else side
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = docs.join(side, F.col(source_col).eqNullSafe(F.col(of)), "left")
    # how many entries of the table are below u: entries never fall
    below = lambda u: F.aggregate(F.array(*map(F.lit, HALVES)), F.lit(0), lambda n, step: F.when(F.get(cdf, n + step - 1) < u, n + step).otherwise(n)).cast("long")
    other = lambda j: below(uniform(F.concat(F.lit(seed + "/"), j.cast("string")), key))
    last = F.col(parts) - 1
    inner = lambda total, k: total + F.aggregate(_stride(k, last), F.lit(0).cast("long"), lambda n, j: n + F.when(j > 0, other(j)).otherwise(F.lit(0)))
    rest = F.when(last > 0, F.aggregate(_strides(F.lit(0), last), F.lit(0).cast("long"), inner)).otherwise(F.lit(0).cast("long"))
    counted = drawn.withColumn("copies", below(uniform(F.lit(seed), key)) + rest).drop(of, cdf, parts).filter("copies > 0")
    blocks = counted.withColumn(block, F.explode(_strides(F.lit(0), F.col("copies") - 1)))
    exploded = blocks.withColumn("copy", F.explode(_stride(F.col(block), F.col("copies") - 1))).drop(block).withColumn("copy", F.col("copy") + 1)
    return exploded.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed + ":order"), key, F.col("copy").cast("string"))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``replicate`` and the global shuffle: rows in order of mix_key, over range partitions."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return replicate(docs, **options).repartitionByRange(parts, "mix_key").sortWithinPartitions("mix_key")


def mix_sql(columns: str, weights: dict[str, float] | None = None, seed: str = SEED) -> str:
    """DuckDB statement for ``mix`` over the view documents (rows without their order)."""
    weight = "1.0" if weights is None else "CASE source " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in weights.items()) + " ELSE 0.0 END"
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, CAST({weight} AS DOUBLE) AS w FROM counts),
whole AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT CAST(sum(n) AS BIGINT) FROM weighed) / n AS rate FROM weighed),
rates AS (SELECT *, greatest(1, CAST(ceil(rate / {PART_RATE}) AS BIGINT)) AS parts, rate / greatest(1, ceil(rate / {PART_RATE})) AS part FROM whole),
cdf AS (
  SELECT source, part, 0 AS k, -part AS t, exp(-part) AS c FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, part, k + 1, t + ln(part) - ln(k + 1), c + exp(t + ln(part) - ln(k + 1)) FROM cdf
  WHERE k + 1 <= ceil(part + 12 * sqrt(part) + 40)
),
numbered AS (SELECT *, row_number() OVER () AS row_no FROM documents),
dealt AS (
  SELECT d.row_no, d.source, unnest(range(0, r.parts)) AS j, coalesce(CAST(d.doc_id AS VARCHAR), 'null') AS key
  FROM numbered d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
),
drawn AS (
  SELECT row_no, source, (CAST('0x' || substr(md5('{seed}' || CASE WHEN j > 0 THEN '/' || j ELSE '' END || ':' || key), 1, {DIGITS}) AS BIGINT) + 0.5) / {float(1 << (4 * DIGITS))!r} AS u
  FROM dealt
),
counted AS (
  SELECT row_no, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u)) AS BIGINT) AS copies
  FROM drawn d GROUP BY row_no
)
SELECT {columns}, copies, copy, md5('{seed}:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM numbered JOIN counted USING (row_no) WHERE copies > 0)
"""
