"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on each document.  The votes of all documents are counted by
pattern, of which there are at most 3^8 however many documents there are, and
expectation-maximisation over the counted patterns estimates each heuristic's accuracy and the posterior label of each pattern.
The posterior labels of a bounded sample train a logistic scorer over hashed features of the whole
text, which then scores every document.  Each text is read once: its statistics and hashed features are written,
and what follows reads these.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged, unsigned_hash
from .quality import STATS, statistics

LABELLERS = ("symbols", "dup_lines", "repeats", "upper", "length", "word_len", "distinct", "marked")
#: Documents, by a hash, that train the scorer, and bytes of their features: the bounds of the sample.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
#: Hashed features: 2^BITS weights; a feature's number is two bytes.
BITS = 15
THRESHOLD = 0.25
EPOCHS, RATE, DECAY = 30, 0.3, 1e-5


def votes() -> Column:
    """One character for each of LABELLERS: g (good), b (bad) or n (no vote), from the STATS."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        found = F.when(bad, F.lit("b"))
        return (found if good is None else found.when(good, F.lit("g"))).otherwise(F.lit("n"))

    length = F.col("word_chars") / words
    return F.concat(
        vote(F.col("n_symbols") > 0.05 * chars),
        vote(F.col("n_dup_lines") > 0.3 * lines),
        vote(F.col("n_repeat_words") > 0.4 * words),
        vote(F.col("n_upper") > 0.3 * chars),
        vote(F.col("n_words") < 20, F.col("n_words") >= 60),
        vote((length < 2.5) | (length > 14), (length > 3.5) & (length < 9)),
        vote(F.col("n_distinct") < 0.2 * F.least(words, F.lit(500)), F.col("n_distinct") > 0.4 * F.least(words, F.lit(500))),
        vote(F.col("n_symbols") > 0.2 * words),
    )


def label_model(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, the heuristics' vote probabilities (class, labeller, vote), and the share of good.

    Votes are independent given the class; a heuristic that sees nothing wrong may abstain.  Every
    heuristic starts with bad votes far likelier on bad documents and keeps being more often right
    than wrong, so the classes can't swap.  No patterns give no posteriors."""
    patterns = sorted(counts)
    m = len(LABELLERS)
    table = np.zeros((2, m, 3))  # class bad, good; vote b, g, n
    table[0], table[1] = [0.35, 0.3, 0.35], [0.02, 0.49, 0.49]
    if not patterns:
        return {}, table, 0.5
    n = np.array([counts[p] for p in patterns], float)
    code = np.array([["bgn".index(c) for c in p] for p in patterns])
    one_hot = np.eye(3)[code]
    share = 0.7
    for _ in range(rounds):
        log = np.einsum("pjv,cjv->pc", one_hot, np.log(table)) + np.log([1 - share, share])
        post = np.exp(log - np.logaddexp.reduce(log, axis=1)[:, None])
        mass = post * n[:, None]
        share = float(np.clip(mass[:, 1].sum() / n.sum(), 0.01, 0.99))
        table = np.einsum("pc,pjv->cjv", mass, one_hot) + 0.5
        table /= table.sum(2, keepdims=True)
        for j in range(m):  # at least as likely right as wrong in each class
            for c, right, wrong in ((0, 0, 1), (1, 1, 0)):
                if table[c, j, wrong] > table[1 - c, j, wrong]:
                    both = (table[0, j, wrong] + table[1, j, wrong]) / 2
                    table[:, j, wrong] = both
                    table /= table.sum(2, keepdims=True)
    return dict(zip(patterns, post[:, 1].tolist(), strict=True)), table, share


MASK = (1 << BITS) - 1
STAT_IDS = np.array([zlib.crc32(b"stat%d" % i) & MASK for i in range(8)])
SALTS = zlib.crc32(b"first"), zlib.crc32(b"last")


def hashed(text: str | None, cache: dict) -> tuple[bytes, bytes, bytes]:
    """Features of a whole text: the numbers of its distinct words, which weigh the same, and the numbers and weights of the
    shares of its words' first and last bytes (little-endian 16-bit numbers, 32-bit floats)."""
    words = (text or "").lower().encode().split()
    if len(cache) > 300_000:
        cache.clear()
    ids = set()
    for w in set(words):
        k = cache.get(w)
        if k is None:
            k = zlib.crc32(w) & MASK
            if len(w) <= 64:
                cache[w] = k
        ids.add(k)
    parts, weights = [], []
    for base, at in zip(SALTS, (0, -1), strict=True):
        if words:
            times = np.bincount(np.frombuffer(bytes([w[at] for w in words]), np.uint8), minlength=256)
            some = np.flatnonzero(times)
            parts.append(((some * 2654435761 + base) >> 4) & MASK)
            weights.append(2 * np.sqrt(times[some] / len(words)))
    none = np.empty(0)
    return np.array(sorted(ids), "<u2").tobytes(), np.concatenate([none, *parts]).astype("<u2").tobytes(), np.concatenate([none, *weights]).astype("<f4").tobytes()


def unpacked(words: bytes, parts: bytes, weights: bytes, stats: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text from what ``hashed`` wrote and its STATS."""
    ids = np.frombuffer(words, "<u2")
    named = dict(zip(STATS, stats, strict=True))
    n = max(named["n_words"], 1)
    shares = [
        named["n_symbols"] / max(named["word_chars"], 1), named["n_dup_lines"] / max(named["n_lines"], 1), named["n_repeat_words"] / n,
        named["n_upper"] / max(named["word_chars"], 1), named["n_distinct"] / max(min(named["n_words"], 500), 1), min(named["n_words"], 200) / 200, min(named["word_chars"] / n, 20) / 20, 1.0,
    ]
    values = np.concatenate([np.full(len(ids), 1 / np.sqrt(max(len(ids), 1))), np.frombuffer(weights, "<f4"), 3 * np.array(shares)])
    return np.concatenate([ids, np.frombuffer(parts, "<u2"), STAT_IDS]).astype(np.int64), values


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by full-batch Adagrad."""
    w = np.zeros(1 << BITS)
    if not rows:
        return w
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    total = np.full(len(w), 1e-8)
    for _ in range(EPOCHS * 4):
        p = 1 / (1 + np.exp(-np.bincount(doc, val * w[idx], len(rows))))
        g = np.bincount(idx, val * (p - targets)[doc], len(w)) / len(rows) + DECAY * w
        total += g * g
        w -= RATE * g / np.sqrt(total)
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, votes, posterior, score, kept for each row of ``docs``.

    A null text is an empty text.  Ids may be null or repeat; each row returns, and equal rows get equal
    scores.  All documents count for the label model; the scorer trains on about ``train_rows`` documents chosen by a
    hash of the whole row (at most twice as many, and in the hash's order as many as TRAIN_BYTES of features hold, one at least).  Other
    columns are not read.  An empty table returns no rows.
    """
    spark = ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), unsigned_hash(F.col(id_col), F.col(text_col)).alias("draw"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    packs = ("word_ids", "part_ids", "part_weights")

    def read(batches):
        cache: dict = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            stats = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(STATS))
            packed = [hashed(t, cache) for t in texts]
            columns = [pa.array([p[i] for p in packed], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, stats.T), *columns], names=["doc_id", "draw", *STATS, *packs])

    wide = picked.mapInArrow(read, f"doc_id {kind}, draw long" + "".join(f", {c} long" for c in STATS) + "".join(f", {c} binary" for c in packs))
    rows = staged(wide.withColumn("votes", votes()), "features")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}  # at most 3^8 rows
    posterior, _, _ = label_model(counts)
    total = sum(counts.values())
    limit = int(2**63 * min(1.0, train_rows / max(total, 1)) * 0.999999)
    room = Window.orderBy("draw", "doc_id", "votes").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("word_ids") + F.length("part_ids") + F.length("part_weights")
    # the window runs over sizes alone, of at most twice ``train_rows`` documents; rows with equal draws are equal or as good
    sizes = rows.filter(F.col("draw") < limit).select("draw", "doc_id", "votes", size.alias("size")).orderBy("draw").limit(2 * train_rows)
    last = sizes.withColumn("before", F.coalesce(F.sum("size").over(room), F.lit(0))).filter(F.col("before") < TRAIN_BYTES).agg(F.max("draw").alias("d")).first()["d"]
    drawn = [] if last is None else rows.filter(F.col("draw") <= last).select("votes", *packs, *STATS).limit(2 * train_rows).collect()
    found = [unpacked(*(r[c] for c in packs), tuple(r[c] for c in STATS)) for r in drawn]
    weights = spark.sparkContext.broadcast(train(found, np.array([posterior[r["votes"]] for r in drawn])))

    def score(batches):
        w = weights.value
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            out = []
            for words, parts, values, *stats in zip(*columns, strict=True):
                ids, vals = unpacked(words, parts, values, tuple(stats))
                out.append(float(1 / (1 + np.exp(-(vals @ w[ids])))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "votes", "score"])

    scored = rows.select("doc_id", "votes", *packs, *STATS).mapInArrow(score, f"doc_id {kind}, votes string, score double")
    chosen = F.lit(None).cast("double")
    if posterior:
        pairs = [x for k, v in sorted(posterior.items()) for x in (F.lit(k), F.lit(v))]
        chosen = F.element_at(F.create_map(*pairs), F.col("votes"))
    return scored.select("doc_id", "votes", chosen.alias("posterior"), "score", (F.col("score") >= threshold).alias("kept"))
