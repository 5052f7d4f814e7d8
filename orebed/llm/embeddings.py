"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors of a label are one node.  Each node goes to the shards of its ``OVERLAP`` nearest pivots, and shards whose
pivots lie together make a region, which gets each of its nodes once.  In each shard every member gets a robust-pruned neighbour list;
the lists of a node over all its shards, of whatever region, are united to one flat graph.  Each region is then searched on that
graph, across its shards: for every member a greedy best-first search starts at the shards' medoids and at the member's own
list, and goes on expanding as long as it finds nodes in the (widened) range.  Links found are verified by cosine in double
precision.  A pair that shares several regions counts in the least of them, so counts are sums and no pairs leave
a region, only spanning links.  A region with too many members is cut into chunks, and every pair of chunks is built and searched.  Recall is
audited against brute force on a bounded set of hash-drawn queries, by classes of degree; while one class is below the wanted
recall, the search is repeated with twice the overlap and beam, and if it still is in the last round, the call raises.
Vectors travel in their own type; double precision is made where they are compared.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, ready, staged, unsigned_hash
from .components import components

log = logging.getLogger(__name__)

THRESHOLD = 0.98
#: Members a shard should have, shards a region should have, the most members that a region may have before it is cut.
SHARD_ROWS, REGION_SHARDS, CHUNK_ROWS = 250, 2, 3000
#: The most pivots in all, and the most bytes of them that are broadcast.
PIVOTS, PIVOT_BYTES = 50_000, 64 << 20
OVERLAP = 3
#: Neighbours kept by robust pruning, nearest members and spread members considered, slack factor of the pruning.
DEGREE, NEAREST, SPREAD, ALPHA = 16, 48, 16, 1.2
#: Links to members drawn from a node's whole range where that holds more than NEAREST: they join the parts of a dense range.
SHORTCUTS = 4
BEAM = 12
#: Nodes down to this cosine are expanded, so that the range's rim is passed.
WIDE = 0.95
#: Nodes drawn for the audit, the recall that every class of degree must reach, shards a vector in the last round.
AUDIT_QUERIES, LEAST_RECALL, MOST_OVERLAP = 4096, 0.99, 64


def unit(rows) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(vecs) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def robust_prune(x: np.ndarray, at: np.ndarray, pools: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``pools`` (nodes, -1 for none) those kept as neighbours of the node in ``at``: nearest first, and
    each one kept drops the nodes that are ``alpha`` times nearer to it than to that node.  Returns ordered pools and a mask."""
    near = x[pools]
    far = 2 - 2 * np.einsum("mpd,md->mp", near, x[at])
    far[pools < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    pools, far = np.take_along_axis(pools, order, 1), np.take_along_axis(far, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = alpha * (2 - 2 * near @ near.transpose(0, 2, 1))
    alive = np.isfinite(far)
    kept = np.zeros(alive.shape, bool)
    room = np.full(len(at), degree)
    for i in range(pools.shape[1]):
        own = alive[:, i] & (room > 0)
        kept[:, i] = own
        room -= own
        alive &= ~own[:, None] | (between[:, i] > far)
    return pools, kept


def _grouped(a: np.ndarray, b: np.ndarray, n: int) -> list[np.ndarray]:
    """Edges (a, b) as a list of distinct neighbours of each of ``n`` nodes."""
    flat = np.unique(a * n + b)
    return np.split(flat % n, np.searchsorted(flat // n, np.arange(1, n)))


def build(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Robust-pruned neighbour lists of a shard's members, made mutual."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    y = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    spread = rng.choice(n, min(n, SPREAD), replace=False)
    take = min(NEAREST, n - 1)
    a_all, b_all, extra_a, extra_b = [], [], [], []
    for s in range(0, n, 256):
        near = y[s : s + 256] @ y.T
        rows = np.arange(len(near))
        at = rows + s
        near[rows, at] = -2
        for i in np.flatnonzero((near >= WIDE).sum(1) > take).tolist():
            some = rng.choice(np.flatnonzero(near[i] >= WIDE), SHORTCUTS)
            extra_a += [np.full(SHORTCUTS, s + i), some]
            extra_b += [some, np.full(SHORTCUTS, s + i)]
        top = np.argpartition(near, n - take, axis=1)[:, n - take :] if take < n else np.tile(np.arange(n), (len(near), 1))
        least = np.take_along_axis(near, top, 1).min(1)
        others = np.where(near[:, spread] >= least[:, None], -1, spread)  # those in ``top`` already, or the node itself
        others[spread == at[:, None]] = -1
        pools, kept = robust_prune(y, at, np.concatenate([np.where(top == at[:, None], -1, top), others], 1))
        i, j = np.nonzero(kept)
        a_all += [at[i], pools[i, j]]
        b_all += [pools[i, j], at[i]]
    lists = _grouped(np.concatenate(a_all), np.concatenate(b_all), n)
    long = np.array([i for i, own in enumerate(lists) if len(own) > 2 * DEGREE], np.int64)
    for s in range(0, len(long), 256):
        at = long[s : s + 256]
        pools = np.full((len(at), max(len(lists[i]) for i in at)), -1)
        for k, i in enumerate(at):
            pools[k, : len(lists[i])] = lists[i]
        pools, kept = robust_prune(y, at, pools, 2 * DEGREE)
        for k, i in enumerate(at):
            lists[i] = pools[k][kept[k]]
    if extra_a:
        more = _grouped(np.concatenate(extra_a), np.concatenate(extra_b), n)
        lists = [np.union1d(own, new) if len(new) else own for own, new in zip(lists, more, strict=True)]
    return lists


def medoid(x: np.ndarray) -> int:
    """The member with the largest mean cosine to all."""
    return int(np.argmax(x @ x.mean(0)))


def search(x: np.ndarray, lists: list, starts: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (query, member) of all members with a verified cosine of at least ``threshold``; ``starts``: the medoids."""
    n = len(x)
    width = max([1, *map(len, lists)])
    graph = np.full((n, width), -1, np.int64)
    for i, own in enumerate(lists):
        graph[i, : len(own)] = own
    y = x.astype(np.float32)
    wide = min(WIDE, threshold) - 1e-6
    seen = np.zeros((n, n), bool)
    np.fill_diagonal(seen, True)
    q_all, v_all = [], []

    place = np.empty(n * n, np.int32)

    def visit(q, v):
        """Score the unseen of the pairs (q, v), each once."""
        keep = v >= 0
        flat = q[keep] * n + v[keep]
        flat = flat[~seen.ravel()[flat]]
        turn = np.arange(len(flat), dtype=np.int32)
        place[flat] = turn
        flat = flat[place[flat] == turn]
        q, v = flat // n, flat % n
        seen[q, v] = True
        score = np.empty(len(q), np.float32)
        for s in range(0, len(q), 1 << 16):
            score[s : s + (1 << 16)] = np.einsum("ij,ij->i", y[q[s : s + (1 << 16)]], y[v[s : s + (1 << 16)]])
        return q, v, score

    every = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    scores = np.full((n, beam), -2, np.float32)
    done = np.ones((n, beam), bool)
    first_q = np.concatenate([np.repeat(every, len(starts)), np.repeat(every, width)])
    q, v, s = visit(first_q, np.concatenate([np.tile(starts, n), graph.ravel()]))
    while len(q):
        hit = s >= wide
        q_all.append(q[hit])
        v_all.append(v[hit])
        # merge what was scored into the beams
        order = np.lexsort((-s, q))
        q, v, s = q[order], v[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        own = rank < beam
        add_ids = np.full((n, beam), -1, np.int64)
        add_scores = np.full((n, beam), -2, np.float32)
        add_ids[q[own], rank[own]] = v[own]
        add_scores[q[own], rank[own]] = s[own]
        ids, scores = np.concatenate([ids, add_ids], 1), np.concatenate([scores, add_scores], 1)
        done = np.concatenate([done, add_ids < 0], 1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        ids, scores, done = (np.take_along_axis(a, best, 1) for a in (ids, scores, done))
        # expand the best open node of each beam
        rank = np.argmax(~done, axis=1)
        rows = np.flatnonzero(~done[every, rank])
        if not len(rows):
            break
        node = ids[rows, rank[rows]]
        done[rows, rank[rows]] = True
        q, v, s = visit(np.repeat(rows, width), graph[node].ravel())
        while not len(q):  # nothing new around these: the next open nodes
            rank = np.argmax(~done, axis=1)
            rows = np.flatnonzero(~done[every, rank])
            if not len(rows):
                break
            node = ids[rows, rank[rows]]
            done[rows, rank[rows]] = True
            q, v, s = visit(np.repeat(rows, width), graph[node].ravel())
    # range expansion: everything around the nodes in range, as long as there is something new in range
    front_q, front_v = (np.concatenate([np.empty(0, np.int64), *a]) for a in (q_all, v_all))
    found_q, found_v = [front_q], [front_v]
    while len(front_q):
        next_q, next_v = [], []
        for at in range(0, len(front_q), 1 << 15):
            part_q, part_v = front_q[at : at + (1 << 15)], front_v[at : at + (1 << 15)]
            q, v, s = visit(np.repeat(part_q, width), graph[part_v].ravel())
            next_q.append(q[s >= wide])
            next_v.append(v[s >= wide])
        front_q, front_v = np.concatenate(next_q), np.concatenate(next_v)
        found_q.append(front_q)
        found_v.append(front_v)
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    q, v = np.concatenate([q, v]), np.concatenate([v, q])  # a link found from one end counts for both
    flat = np.unique(q * n + v)
    q, v = flat // n, flat % n
    exact = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[q[s : s + (1 << 16)]], x[v[s : s + (1 << 16)]]) for s in range(0, len(q), 1 << 16))])
    return q[exact >= threshold], v[exact >= threshold]


def _spanning(q: np.ndarray, v: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    ahead = q < v
    for i, j in zip(q[ahead].tolist(), v[ahead].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _by_group(batch) -> dict[str, np.ndarray]:
    """Row numbers of each value of the second column."""
    groups = np.array(batch.column(1).to_pylist(), object)
    return {g: np.flatnonzero(groups == g) for g in set(groups.tolist())}


def _regions(own: np.ndarray) -> np.ndarray:
    """The region of each pivot: that of the nearest of every REGION_SHARDS-th pivot."""
    centres = own[:: max(1, REGION_SHARDS)]
    return np.concatenate([np.argmax(own[s : s + 1024] @ centres.T, axis=1) for s in range(0, len(own), 1024)])


def _assign(pivots, overlap: int, schema: pa.Schema):
    """Rows (node, part_of, vec, n) -> SHARDED, one for each region of a node."""

    def run(batches):
        for batch in batches:
            at, regions, every, shards = [], [], [], []
            for g, rows in _by_group(batch).items():
                own, region_of = pivots.value.get(g, (None, None))
                if own is None or len(own) < 2:
                    near, of = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1), np.int64)
                else:
                    score = unit(matrix(batch.column(2).take(pa.array(rows)))).astype(np.float32) @ own.T
                    take = min(overlap, len(own))
                    near = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    of = region_of[near]
                names = {r: xxhash.xxh64_intdigest(f"{g}|{r}") >> 1 for r in np.unique(of).tolist()}
                for i, some, places in zip(rows.tolist(), near.tolist(), of.tolist(), strict=True):
                    named = sorted({names[r] for r in places})
                    for r in set(places):
                        at.append(i)
                        regions.append(names[r])
                        every.append(named)
                        shards.append([k for k, p in zip(some, places, strict=True) if p == r])
            if at:
                some = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), batch.column(0).take(some), batch.column(3).take(some), pa.array(every, pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int64())), batch.column(2).take(some)], schema=schema)

    return run


def _sharded(nodes: DataFrame, pivots, overlap: int) -> DataFrame:
    """Members of all regions, large ones cut into pairs of chunks: key, part_a, part_b, part, region, node, n, regions, shards, vec."""
    kind = nodes.schema["vec"].dataType
    schema = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("regions", pa.list_(pa.int64())), ("shards", pa.list_(pa.int64())), ("vec", pa.list_(pa.float32() if kind.elementType.simpleString() == "float" else pa.float64()))])
    rows = nodes.select("node", "part_of", "vec", "n").mapInArrow(_assign(pivots, overlap, schema), f"region long, node long, n long, regions array<long>, shards array<long>, vec {kind.simpleString()}")
    rows = staged(rows, "members")
    large = rows.groupBy("region").count().filter(F.col("count") > CHUNK_ROWS)
    large = staged(large.select("region", F.ceil(F.col("count") / CHUNK_ROWS * 2).alias("parts")), "large")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        return rows.select(F.col("region").alias("key"), zero.alias("part_a"), zero.alias("part_b"), zero.alias("part"), "*")
    joined = rows.join(large, "region", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    joined = joined.withColumn("part", F.pmod(unsigned_hash(F.lit(3), F.col("node")), F.col("parts")))
    other = F.explode(F.sequence(zero, F.col("parts") - 1)).alias("other")
    pairs = joined.select("*", other).withColumn("part_a", F.least("part", "other")).withColumn("part_b", F.greatest("part", "other"))
    return pairs.select(unsigned_hash(F.col("region"), F.col("part_a"), F.col("part_b")).alias("key"), "part_a", "part_b", "part", "region", "node", "n", "regions", "shards", "vec")


def _shards(rows: pa.Table) -> list[np.ndarray]:
    """Row numbers of each shard of a region, in order."""
    lists = rows.column("shards").combine_chunks()
    shard, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    order = np.lexsort((at, shard))
    shard, at = shard[order], at[order]
    return np.split(at, np.flatnonzero(np.diff(shard)) + 1)


def _lists(rows: pa.Table) -> pa.Table:
    """Neighbour lists (node, nears) of the members of one region, united over its shards."""
    rows = rows.sort_by([("node", "ascending")])
    nodes, x = rows.column("node").to_numpy(), unit(matrix(rows.column("vec")))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for own in _shards(rows):
        lists = build(x[own])
        a.append(np.repeat(own, [len(some) for some in lists]))
        b.append(own[np.concatenate(lists).astype(np.int64)])
    lists = _grouped(np.concatenate(a), np.concatenate(b), len(nodes))
    ends = np.cumsum([0, *map(len, lists)])
    return pa.table({"node": pa.array(nodes, pa.int64()), "nears": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes[np.concatenate(lists)], pa.int64()))})


def _found(threshold: float, beam: int):
    """Search of one region on the united graph: (node, links, pairs) counts with and without copies, and spanning links (a, b)."""

    def run(rows: pa.Table, graph: pa.Table) -> pa.Table:
        rows, graph = rows.sort_by([("node", "ascending")]), graph.sort_by([("node", "ascending")])
        nodes, part, weight = (rows.column(c).to_numpy() for c in ("node", "part", "n"))
        near = graph.column("nears").combine_chunks()
        a, b = np.repeat(np.searchsorted(nodes, graph.column("node").to_numpy()), near.value_lengths().to_numpy()), near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(nodes, b), len(nodes) - 1)
        here = nodes[at] == b
        x = unit(matrix(rows.column("vec")))
        starts = np.unique([own[medoid(x[own])] for own in _shards(rows)])
        q, v = search(x, _grouped(a[here], at[here], len(nodes)), starts, threshold, beam)
        if rows.column("part_a")[0].as_py() != rows.column("part_b")[0].as_py():
            cross = part[q] != part[v]
            q, v = q[cross], v[cross]
        regions = rows.column("regions").to_pylist()
        widest = max(map(len, regions))
        own = np.array([s + [-1] * (widest - len(s)) for s in regions], np.int64)
        this = rows.column("region")[0].as_py()
        least = np.full(len(q), np.iinfo(np.int64).max)
        for i in range(widest):
            for j in range(widest):
                same = (own[q, i] == own[v, j]) & (own[q, i] >= 0)
                least = np.where(same, np.minimum(least, own[q, i]), least)
        mine = least == this
        links, pairs = np.zeros(len(nodes), np.int64), np.bincount(q[mine], minlength=len(nodes))
        np.add.at(links, q[mine], weight[v[mine]])
        span = _spanning(q, v, len(nodes))
        some = np.flatnonzero(links)
        a = [None] * len(some) + [int(nodes[i]) for i, _ in span]
        b = [None] * len(some) + [int(nodes[j]) for _, j in span]
        ids = [int(nodes[i]) for i in some] + [None] * len(span)
        counts = [int(links[i]) for i in some] + [None] * len(span)
        others = [int(pairs[i]) for i in some] + [None] * len(span)
        kinds = pa.int64()
        return pa.table({"node": pa.array(ids, kinds), "links": pa.array(counts, kinds), "pairs": pa.array(others, kinds), "a": pa.array(a, kinds), "b": pa.array(b, kinds)})

    return run


def _recalls(nodes: DataFrame, counts: DataFrame, threshold: float) -> dict[int, tuple[int, float]]:
    """By class of true degree (1, 2 to 3, 4 to 7, ... named by the least): nodes asked and the mean of their recall.

    The nodes are drawn by a hash alone, whatever was found, and each counts once; degrees and
    recall count nodes, not copies.  The truth is brute force against all nodes."""
    total = nodes.count()
    chosen = nodes.filter(unsigned_hash(F.lit(11), F.col("node")) <= min(2**63 - 1, int(2**63 * min(1.0, AUDIT_QUERIES / max(total, 1)))))
    held: dict[str, tuple] = {}
    asked = chosen.select("node", "part_of", "vec").toArrow()
    for g, at in _by_group(asked).items():
        some = asked.take(pa.array(at))
        held[g] = some.column(0).to_pylist(), unit(matrix(some.column(2)))
    if not held:
        return {}
    queries = nodes.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out: dict[int, int] = {}
            for g, at in _by_group(batch).items():
                if g not in queries.value:
                    continue
                asked, x = queries.value[g]
                near = unit(matrix(batch.column(2).take(pa.array(at)))) @ x.T >= threshold
                near &= ids[at][:, None] != np.array(asked)[None]
                degree = near.sum(0)
                for j in np.flatnonzero(degree).tolist():
                    out[asked[j]] = out.get(asked[j], 0) + int(degree[j])
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["node", "truth"])

    brute = nodes.select("node", "part_of", "vec").mapInArrow(run, "node long, truth long")
    truth = brute.groupBy("node").agg(F.sum("truth").alias("truth"))
    share = F.least("truth", F.coalesce("pairs", F.lit(0))) / F.col("truth")
    degrees = truth.join(counts, "node", "left").groupBy(F.floor(F.log2("truth") + 1e-9).alias("power")).agg(F.count("truth").alias("asked"), F.avg(share).alias("recall"))
    return {1 << row["power"]: (row["asked"], row["recall"]) for row in degrees.orderBy("power").collect()}


def _audit(nodes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The least mean recall of the classes of degree; 1 where no node asked has a link."""
    found = _recalls(nodes, counts, threshold)
    log.info("recall by degree: %s", "; ".join(f"{d}+: {r:.4f} of {n} nodes" for d, (n, r) in found.items()))
    return min((r for _, r in found.values()), default=1.0)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, least_recall: float = LEAST_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or a null
    id, and vectors of different lengths link with nothing; a row with a null id has a null component and is kept.  Equal
    vectors of a label are linked with each other.  Rows that repeat an id each return, and count as links of each
    other where their vectors link.  Other columns are not read.  An empty table returns no rows.  RuntimeError
    if the audited recall stays below ``least_recall``.
    """
    spark = ready(table.sparkSession)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    # two hashes stand for a vector and its label where rows meet their node again: no vector travels there
    rows = rows.withColumns({"usable": usable, "one": F.xxhash64("label", "vec"), "two": F.xxhash64(F.lit("other"), F.col("vec"), F.col("label"))})
    nodes = rows.filter("usable").groupBy("one", "two").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("part_of", F.concat_ws("|", F.size("vec").cast("string"), "label"))
    nodes = staged(nodes, "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("widest")).first()
    total = size["n"]
    ratio = min(1 / SHARD_ROWS, min(PIVOTS, PIVOT_BYTES / (4 * max(size["widest"] or 1, 1))) / max(total, 1))
    centres = nodes.filter(F.col("one").bitwiseAND(F.lit(2**63 - 1)) < int(2**63 * ratio)).select("node", "part_of", "vec").orderBy("one", "two").toArrow()
    held = {g: unit(matrix(centres.take(pa.array(at)).column(2))).astype(np.float32) for g, at in _by_group(centres).items()}
    pivots = spark.sparkContext.broadcast({g: (own, _regions(own)) for g, own in held.items()})
    overlap, beam = OVERLAP, BEAM
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets(total * OVERLAP, 50_000))
    while True:
        members = _sharded(nodes, pivots, overlap)
        lists = members.repartition(parts, "key").groupBy("key").applyInArrow(_lists, "node long, nears array<long>")
        graph = staged(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nears"))).alias("nears")), "graph")
        keyed = members.select(F.col("key").alias("of_key"), F.col("node").alias("node")).join(graph, "node")
        found = members.groupBy("key").cogroup(keyed.groupBy("of_key")).applyInArrow(_found(threshold, beam), "node long, links long, pairs long, a long, b long")
        found = staged(found, "found")
        counts = staged(found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), "counts")
        recall = _audit(nodes, counts, threshold)
        if recall >= least_recall:
            break
        if overlap >= MOST_OVERLAP:
            raise RuntimeError(f"recall {recall:.4f} in the worst class of degree is below {least_recall} with {overlap} shards a vector")
        overlap, beam = 2 * overlap, 2 * beam
    roots = components(found.filter("a is not null").select("a", "b"))
    every = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    member = nodes.select("node", "least").join(every, "node")
    top = member.groupBy("root").agg(F.min("least").alias("component"))
    component = member.join(top, "root").select("node", "component")
    classes = nodes.select("one", "two", "node", "least", "n").join(counts, "node", "left").join(component, "node", "left")
    classes = classes.select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    linked = rows.filter("usable").select("id", "one", "two").join(classes, ["one", "two"]).select("id", "links", "component")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
