"""Quality rules: base limits, then minimum-covariance-determinant outliers by language and source.

Each document gives a vector of transformed statistics.  For the whole table, each language and each (language, source)
the location and scatter of the ``COVER`` of the vectors with the least determinant are sought from several starts
by concentration steps over all documents, until no determinant falls any more: distances under the last
estimate are binned on a fine logarithmic scale, moments are summed per group and bin, and the lowest bins, the last
one in part, that hold the wanted share give the next estimate.  So one step for all groups and starts is one partial
aggregation with a bounded number of rows for each group, however many documents the group holds.  The estimate of a
source leans on its language's, and that on the whole table's, the more the fewer rows it has, so that a group of one row has one too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chi2_quantile, discard, free_name, ready, staged

FEATURES = ("word_len", "distinct", "length", "symbols", "dup_lines", "repeats", "upper")
#: Least standard deviation of each feature: below it a spread is not told from zero.  Those of the shares of lines and of
#: windows are what a share of ten lines, or of the twenty windows of sixty words, moves by chance: 1 / (2 sqrt(n)).
FLOOR = (0.05, 0.05, 0.30, 0.05, 0.16, 0.11, 0.05)
COVER = 0.75
#: Starts of each group: medians and quartiles, all rows' moments, and the half that is nearest under the first.
STARTS = ("quartiles", "moments", "half")
#: Concentration goes on while a determinant falls by this share at least, for at most so many steps.
FALL, STEPS = 1e-3, 40
#: Rows that the wider group's estimate counts for beside a group's own.
PRIOR_ROWS = 100
#: Share of clean documents, were they normal, beyond the cutoff.
TAIL = 1e-5
#: Bins of squared distance: 8 to a doubling, from 2^-8 to 2^24.
BINS = 256
#: Estimates that are broadcast, of 1 kB each at most; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
MIN_WORDS = 50
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Positions covered by three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    order = (pair[:-1] * distinct + ids[2:]) if distinct < 1 << 21 else pair[:-1] * (len(ids) + 1) + np.unique(ids, return_inverse=True)[1][2:]
    _, at, times = np.unique(order, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATS; null is an empty text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines, earlier, n_lines, dup = text.split("\n"), set(), 0, 0
    for line in lines:
        if line and line.strip(SPACE):
            n_lines += 1
            if line in earlier:
                dup += 1
            else:
                earlier.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    upper = len(data) - len(data.translate(None, UPPER))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(ids, len(seen)), n_lines, len(seen), upper


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the STATS of the text of every row."""

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, rows.T)], names=[*keep, *STATS])

    ready(docs.sparkSession)
    picked = docs.select(*keep, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, kinds + "".join(f", {c} long" for c in STATS))


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))


def vector() -> list[Column]:
    """FEATURES from STATS: logarithms of sizes, arc sines of shares."""
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        F.log(F.col("n_distinct") + 1.0),
        F.log(F.col("n_words") + 1.0),
        _share("n_symbols", "word_chars"),
        _share("n_dup_lines", "n_lines"),
        _share("n_repeat_words", "n_words"),
        _share("n_upper", "word_chars"),
    ]


X = [f"x{i}" for i in range(len(FEATURES))]
UPPER_CELLS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def squared_distance() -> Column:
    """Mahalanobis distance of the columns x from the columns m and p of ``with_estimates`` (row by row)."""
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    total = None
    for i, j in UPPER_CELLS:
        term = off[i] * off[j] * F.col(f"p{i}_{j}") * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def lowest(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, cover: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of the lowest bins (rows, sums and upper cross sums of each, nearest first) that hold
    ``cover`` of the rows; the last bin counts for the part that is needed."""
    d = len(FEATURES)
    wanted = cover * n.sum()
    share = np.clip((wanted - np.cumsum(n) + n) / n, 0, 1)
    mu = share @ s1 / wanted
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = share @ s2 / wanted - np.outer(mu, mu)[np.triu_indices(d)]
    return mu, cov + np.triu(cov, 1).T


def regular(cov: np.ndarray, cover: float) -> np.ndarray:
    """The scatter, made consistent for the nearest share ``cover`` of a normal law, on top of the floors."""
    d = len(FEATURES)
    inside = _chi2_cdf(chi2_quantile(cover, d), d + 2) if cover < 1 else cover
    return cov * cover / max(inside, 1e-6) + np.diag(np.square(FLOOR))


def _chi2_cdf(x: float, d: int) -> float:
    return 0.5 * math.erfc(-(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))) / math.sqrt(2))


def lean(estimates: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of the last of ``estimates`` (rows, location, scatter; widest group first), each leaning
    on the one before as if that were ``prior`` rows."""
    _, mu, cov = estimates[0]
    for n, own_mu, own_cov in estimates[1:]:
        mu = (n * own_mu + prior * mu) / (n + prior)
        cov = (n * own_cov + prior * cov) / (n + prior)
    return mu, cov


def _solve(cover: float, first: bool):
    """One group and start: its bins to the next estimate."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        g, start = int(group["g"].iloc[0]), int(group["start"].iloc[0])
        part = cover if not (first and STARTS[start] == "half") else 0.5
        mu, cov = lowest(group["n"].to_numpy(float), np.stack(group["s1"].to_numpy()), np.stack(group["s2"].to_numpy()), part)
        cov = regular(cov, part)
        det = float(np.linalg.slogdet(cov)[1]) if part == cover else math.inf
        return pd.DataFrame({"g": [g], "start": [start], "mu": [mu.tolist()], "cov": [cov.ravel().tolist()], "prec": [np.linalg.inv(cov).ravel().tolist()], "det": [det]})

    return run


def _begin(batches):
    """Groups with their quartiles and moments -> one row for each start."""
    d = len(FEATURES)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            q = np.array(row["q"], float)
            near = np.diag(np.maximum(np.square(FLOOR), np.square((q[:, 2] - q[:, 0]) / 1.349)))
            n = float(row["n"])
            mean, full = lowest(np.array([n]), np.array([row["s1"]]), np.array([row["s2"]]), 1.0)
            for start, (mu, cov) in enumerate(((q[:, 1], near), (mean, full + np.diag(np.square(FLOOR))), (q[:, 1], near))):
                out.append({"g": row["g"], "start": start, "mu": mu.tolist(), "cov": cov.ravel().tolist(), "prec": np.linalg.inv(cov).ravel().tolist(), "det": math.inf, "done": False})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("g", pa.int64()), ("start", pa.int32()), *((c, pa.list_(pa.float64())) for c in ("mu", "cov", "prec")), ("det", pa.float64()), ("done", pa.bool_())]))


def _finish(prior: float):
    def run(batches):
        d = len(FEATURES)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chain = [(e["n"], np.array(e["mu"]), np.array(e["cov"]).reshape(d, d)) for e in sorted(row["chain"], key=lambda e: e["level"])]
                mu, cov = lean(chain, prior)
                out.append({"lang": row["lang"], "source": row["source"], "mu": mu.tolist(), "prec": np.linalg.inv(cov).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("mu", pa.list_(pa.float64())), ("prec", pa.list_(pa.float64()))]))

    return run


def fit(vectors: DataFrame, cover: float = COVER, steps: int = STEPS, prior: float = PRIOR_ROWS) -> DataFrame:
    """(lang, source, x0 to x6) -> estimates (lang, source, mu, prec), one row for each (lang, source)."""
    none = F.lit(None).cast("string")
    levels = [(F.lit(0), none, none), (F.lit(1), F.col("lang"), none), (F.lit(2), F.col("lang"), F.col("source"))]
    group = F.explode(F.array(*[F.struct(a.alias("level"), b.alias("in_lang"), c.alias("in_source")) for a, b, c in levels])).alias("of")
    own = F.array(*[F.sum(x) for x in X])
    cross = F.array(*[F.sum(F.col(X[i]) * F.col(X[j])) for i, j in UPPER_CELLS])
    quart = F.array(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000) for x in X])
    groups = vectors.select(*X, group).groupBy("of").agg(F.count(F.lit(1)).alias("n"), quart.alias("q"), own.alias("s1"), cross.alias("s2"))
    groups = staged(groups.select("of.*", "n", "q", "s1", "s2", F.monotonically_increasing_id().alias("g")), "groups")
    pairs = groups.filter("level = 2").select(F.col("in_lang").alias("lang"), F.col("in_source").alias("source"))
    sought = pairs.select("lang", "source", group).select("lang", "source", *[F.col(f"of.{c}").alias(f"of_{c}") for c in ("level", "in_lang", "in_source")])
    on = [F.col(f"of_{c}").eqNullSafe(F.col(c)) for c in ("level", "in_lang", "in_source")]
    members = staged(sought.join(groups, on).select("lang", "source", "level", "g", "n"), "members")

    numbers = "mu array<double>, cov array<double>, prec array<double>, det double"
    now = staged(groups.select("g", "n", "q", "s1", "s2").mapInArrow(_begin, f"g long, start int, {numbers}, done boolean"), "mcd")
    for step in range(steps):
        side = members.select("lang", "source", "g").join(now.filter("not done").select("g", "start", "mu", "prec"), "g")
        dist = with_estimates(vectors, side, "inner")
        binned = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(8 * F.log2(squared_distance() + 1e-9)) + 64)).cast("int")
        bins = dist.groupBy("g", "start", binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"), own.alias("s1"), cross.alias("s2"))
        new = bins.groupBy("g", "start").applyInPandas(_solve(cover, step == 0), f"g long, start int, {numbers}")
        names = ("mu", "cov", "prec", "det")
        new = new.select("g", "start", *[F.col(c).alias(f"new_{c}") for c in names])
        falls = F.col("new_det") < F.col("det") - FALL if step > 1 else F.col("new_det").isNotNull()
        pick = [F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names]
        old, now = now, staged(now.join(new, ["g", "start"], "left").select("g", "start", *pick, (~F.coalesce(falls, F.lit(False))).alias("done")), "mcd")
        discard(old)
        if now.filter("not done").isEmpty():
            break
    least = now.groupBy("g").agg(F.min(F.struct("det", "start", "mu", "cov")).alias("best"))
    chain = F.collect_list(F.struct("level", "n", "best.mu", "best.cov")).alias("chain")  # three of them
    chains = members.join(least, "g").groupBy("lang", "source").agg(chain)
    return staged(chains.mapInArrow(_finish(prior), "lang string, source string, mu array<double>, prec array<double>"), "mcd")


def with_estimates(rows: DataFrame, estimates: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with each estimate of their (lang, source), a column for each number; null keys are groups of their own."""
    keys, d = ("lang", "source"), len(FEATURES)
    mu, prec = [F.get("mu", F.lit(i)).alias(f"m{i}") for i in range(d)], [F.get("prec", F.lit(i * d + j)).alias(f"p{i}_{j}") for i, j in UPPER_CELLS]
    side = estimates.withColumnsRenamed({k: f"of_{k}" for k in keys}).select("*", *mu, *prec).drop("mu", "prec")
    if estimates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    on = [rows[k].eqNullSafe(side[f"of_{k}"]) for k in keys]
    return rows.join(side, on, how).drop(*[f"of_{k}" for k in keys])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, STATS, base_failed, distance (squared Mahalanobis), kept.

    A null or empty text has zero counts and fails the base rules, as does any text of fewer than 50
    words or with over half of its words in repeated windows.  A null language or source is a value
    like any other.  Documents that fail the base rules are not part of the estimates and have no distance; every
    other has one, however small its group.  Equal rows get equal verdicts.  An empty table returns no rows.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    stats = text_statistics(picked, ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = staged(stats.withColumn("base_failed", failed).withColumns(dict(zip(X, vector(), strict=True))), "stats")
    found = fit(rows.filter("not base_failed").select("lang", "source", *X))
    near = with_estimates(rows, found)
    distance = F.when(~F.col("base_failed"), squared_distance())
    limit = chi2_quantile(1 - tail, len(FEATURES))
    return near.select("doc_id", *STATS, "base_failed", distance.alias("distance"), F.coalesce(~F.col("base_failed") & (distance <= limit), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, all columns as they are.

    The verdict is found by id; where an id is null or repeats, a row goes if any row of that id is
    rejected.  Null ids are compared as a value.
    """
    verdicts = judge(docs, id_col, text_col, lang_col, source_col, tail)
    gone = free_name(docs, "gone")
    lost = staged(verdicts.filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "rejected")
    return docs.join(lost, docs[id_col].eqNullSafe(lost[gone]), "left_anti")
