"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact check.

A 64-bit fingerprint is mapped to 32 counts of set bits, one for each two-bit segment.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
it is a lower bound.  The 32 axes are dealt to B blocks.  A pair within distance 4 differs in at
most four blocks, so it agrees in at least B - 4: each choice of B - 4 blocks is a grid whose cell
is the counts on the axes of those blocks, and every pair within the range meets in a cell of some
grid.  Cells are searched with the lower bound first and the exact distance after it.  B follows
the number of distinct fingerprints, so that the expected size of a cell stays constant; any B
gives the same links.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets, free_name, ready, staged
from .components import components

MAX_DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Words hashed at once; a longer text goes through in pieces.
CHUNK_WORDS = 200_000
#: Members of a cell that one task compares; a larger cell is cut into chunks, compared pair by pair.
CELL_ROWS = 8192
#: Collision entropy in bits of one two-bit segment's count, -log2(1/16 + 1/4 + 1/16).
AXIS_BITS = 1.415


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 bytes: words between ASCII white space, A-Z in lower case, XXH64 shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK_WORDS):
        part = words[at : min(at + CHUNK_WORDS, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long; null and empty texts get 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def segment_counts(fp: Column) -> Column:
    """Set bits of each two-bit segment, 0, 1, 2 written as 00, 01, 11: one code for each count, and
    the Manhattan distance of two vectors is the number of bits in which the codes differ."""
    five = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(five), F.shiftrightunsigned(fp, 1).bitwiseAND(five)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def block_masks(blocks: int) -> list[int]:
    """Bit masks of the grids: every choice of ``blocks - MAX_DISTANCE`` blocks of the 32 axes."""
    axes = [[i for i in range(32) if i % blocks == b] for b in range(blocks)]
    chosen = combinations(range(blocks), blocks - MAX_DISTANCE)
    return [sum(3 << (2 * i) for b in c for i in axes[b]) for c in chosen]


def block_count(distinct: int) -> int:
    """Least number of blocks for which a cell holds about eight unrelated fingerprints or fewer."""
    for blocks in range(MAX_DISTANCE + 1, 13):
        if distinct <= 8 * 2 ** (AXIS_BITS * 32 * (blocks - MAX_DISTANCE) / blocks):
            return blocks
    return 12


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unary(fp):
    """``segment_counts`` of an array."""
    five = np.uint64(0x5555555555555555)
    low, high = fp & five, (fp >> np.uint64(1)) & five
    return (low | high) | ((low & high) << np.uint64(1))


class _Forest:
    """Union-find over positions; ``join`` tells whether two trees were merged."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def cell_links(cell: np.ndarray, fps: np.ndarray, limit: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints within ``limit`` in each cell (``cell`` is sorted).

    All pairs of a cell are compared; of the pairs found only those that join two trees are
    returned, so a cell of n gives at most n - 1 rows.
    """
    out: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    unary = _unary(fps)
    forest = _Forest()
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cell)) - 1  # members of the cell after each row
    small = np.repeat(sizes <= 256, sizes)
    at, step = np.flatnonzero(small & (left > 0)), 1
    while len(at):
        hit = at[np.bitwise_count(unary[at] ^ unary[at + step]) <= limit]
        hit = hit[np.bitwise_count(fps[hit] ^ fps[hit + step]) <= limit]
        out += [(int(fps[i]), int(fps[i + step])) for i in hit.tolist() if forest.join(i, i + step)]
        step += 1
        at = at[left[at] >= step]
    for s, n in zip(starts[sizes > 256].tolist(), sizes[sizes > 256].tolist(), strict=True):
        own, flat, label = fps[s : s + n], unary[s : s + n], np.arange(n)
        for i in range(n - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(flat[i + 1 :] ^ flat[i]) <= limit)
            near = near[np.bitwise_count(own[near] ^ own[i]) <= limit]
            near = near[label[near] != label[i]]
            while len(near):
                j = near[0]
                out.append((int(own[i]), int(own[j])))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return out


def _search(batches):
    """Rows (key, fp) sorted by key: links of each key's fingerprints.  Only one key is held over."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(k, f):
        found = np.array(cell_links(k, f), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    for batch in batches:
        k = np.r_[held_k, batch.column(0).to_numpy(zero_copy_only=False)]
        f = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if len(k) < 50_000 and len(k) and k[0] != k[-1] or not len(k):
            held_k, held_f = k, f
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield links(k[:cut], f[:cut])
        held_k, held_f = k[cut:], f[cut:]
    if len(held_k):
        yield links(held_k, held_f)


def near_links(fps: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) links that span every class within the distance."""
    spark = ready(fps.sparkSession)
    n = fps.count()
    masks = block_masks(block_count(n))
    count = segment_counts(F.col("fp"))
    cells = fps.select(
        "fp",
        F.explode(F.array(*[F.xxhash64(F.lit(t), count.bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])).alias("key"),
    )
    sizes = cells.groupBy("key").count().filter(F.col("count") > CELL_ROWS)
    hot = staged(sizes.select("key", F.ceil(F.col("count") / CELL_ROWS).alias("parts")), "cells")
    if not hot.isEmpty():
        # a cell of c chunks becomes the pairs of its chunks; each member goes to c of them
        own = F.pmod(F.xxhash64("fp", F.lit(7)), "parts")
        pair = lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
        cells = cells.join(hot, "key", "left").select(
            "fp",
            F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), pair))).alias("key"),
        )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets(n * len(masks), 2_000_000))
    dealt = cells.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable by links of at most four bits.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows with a null id
    are linked too; a class of null ids alone has a null component.  Repeated rows each return.
    Other columns, whatever their names, are not read.  An empty table returns no rows.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(near_links(least.select("fp")))
    linked = staged(roots.withColumnRenamed("node", "fp"), "roots")
    every = linked.select("fp", "root").union(linked.select(F.col("root").alias("fp"), "root").distinct())
    member = every.join(least, "fp")
    top = member.groupBy("root").agg(F.min("least").alias("component"))
    member = member.join(top, "root").select("fp", "component")
    classes = staged(least.join(member, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "classes")
    # a join alone in its plan, so that the adaptive skew join can split a fingerprint that many documents share
    return rows.join(classes, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Repeated rows of one id are one document: of them one row stays.  Of a class without any id
    nothing can be told apart, and its rows stay.
    """
    found = staged(near_duplicates(docs, id_col, text_col), "simhash")
    gone = free_name(docs, "gone")
    lost = found.filter("id <> component").select(F.col("id").alias(gone)).distinct()
    kept = docs.join(lost, docs[id_col] == lost[gone], "left_anti")
    once = found.filter("id is not null").agg(F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    if once["n"] == once["d"]:
        return kept
    none = kept.filter(F.col(id_col).isNull())
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(none)
