"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import classifier, embeddings, html, mixing, packing, pii, quality, secrets, simhash, spans, warc
from .common import table


def op1_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance")
    )


def op2_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read(warc.write(pages), payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_packing(spark, sf_dir):
    pieces = packing.cut(table(spark, sf_dir, "documents"))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(pieces)


def op5_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_classifier(spark, sf_dir):
    found = classifier.classify(table(spark, sf_dir, "documents"))
    return found.withColumns({"posterior": F.round("posterior", 6), "score": F.round("score", 6)})


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_secrets(spark, sf_dir):
    return spans.digest(secrets.scan(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op10_pii(spark, sf_dir):
    return spans.digest(pii.scan(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


# ---- the parts of these results that SQL can say, through the same operators over the same whole tables


def quality_counts(spark, sf_dir):
    return op1_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def warc_records(spark, sf_dir):
    return op3_warc(spark, sf_dir).select("page_id", "payload_bytes", "record_type", F.coalesce("refers_to", "page_id").alias("original"))


def secret_counts(spark, sf_dir):
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def pii_counts(spark, sf_dir):
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = r"[^\x20\x09-\x0D]+"
QUALITY_COUNTS = f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
),
places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM places),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORDS}') GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted"""
WARC_RECORDS = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  first AS original FROM p"""
ASSIGNED = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""


def _matches(pattern: str, test: str, group: int = 0) -> str:
    """How many leftmost matches of a pattern pass a test of m."""
    return f"CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda m: {test})) AS BIGINT)"


SECRET_COUNTS = f"""SELECT doc_id, {_matches(ASSIGNED, "length(m) >= 6", 2)} AS n_assign,
  {_matches("AKIA[A-Z0-9]+", "length(m) >= 20")} AS n_access, {_matches("[0-9a-f]+", "length(m) >= 24")} AS n_hex FROM documents"""
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: list_extract([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9], CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) + 1 + 10 * CAST((i - 1) % 2 AS INTEGER)))) % 10 = 0"
PII_COUNTS = f"""SELECT doc_id, {_matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")} AS n_email,
  {_matches(r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_max(list_transform(string_split(m, '.'), lambda q: TRY_CAST(q AS HUGEINT))) <= 255")} AS n_ip,
  {_matches(r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}")} AS n_card,
  {_matches(r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15")} AS n_phone FROM documents"""

OPERATORS = {f.__name__: f for f in (op1_quality, op2_html, op3_warc, op4_packing, op5_embeddings, op6_classifier, op7_mixing, op8_simhash, op9_secrets, op10_pii)}
QUERIES = OPERATORS | {f.__name__: f for f in (quality_counts, warc_records, secret_counts, pii_counts)}
SQL = {"op7_mixing": mixing.mix_sql("doc_id, text, lang, source, n_chars"), "quality_counts": QUALITY_COUNTS, "warc_records": WARC_RECORDS, "secret_counts": SECRET_COUNTS, "pii_counts": PII_COUNTS}
