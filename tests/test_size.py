"""What queries write for shuffles stays near their input: pairs are found where they meet, and do not travel before they are counted."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.operators import meetings as M
from orebed.operators import recommend as R
from orebed.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def written(spark) -> int:
    """Bytes that the session has written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def moved(spark, name: str, folder: str = SF) -> int:
    before = written(spark)
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return written(spark) - before


def size(*tables: str) -> int:
    return sum(os.path.getsize(f"{SF}/{t}.parquet") for t in tables)


def shares(rows, support):
    """a < b: numbers of common places, by plain Python."""
    own = {}
    for a, place, *_ in rows:
        own.setdefault(a, set()).add(place)
    found = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b}
    return {k: n for k, n in found.items() if n >= support}


@pytest.mark.parametrize("way", ["counted", "sorted", "multiplied"])
@pytest.mark.parametrize("block", [30, 1000])
def test_meetings(spark, monkeypatch, way, block):
    """Each way of counting, in one block and in many, equals plain Python; text and number keys, and null ones."""
    if block == 30:
        monkeypatch.setattr(M, "CHUNK", 20)
    monkeypatch.setattr(M, "FLOP_S", 0 if way == "multiplied" else 1)
    rng = np.random.default_rng(3)
    many = 60 if way != "sorted" else 4000
    rows = sorted({(f"k{a}", int(p)) for a, p in zip(rng.integers(0, 30, 220), rng.integers(0, many, 220), strict=True)} | {(f"é{a}", p) for a in range(3) for p in range(4)})
    table = spark.createDataFrame([*rows, (None, 1), ("k1", None)], "a string, over long")
    for support in (1, 3):
        found = {(r["a"], r["b"]): r["n"] for r in M.pairs(table, support, block).collect()}
        assert found == shares(rows, support)
    assert M.pairs(table.filter("a is null"), 1, block).count() == 0


CF = ["user_similarity_top3", "predict_user_cf", "rmse_user_cf", "predict_item_cf", "item_similarity_top2", "rmse_item_cf", "error_histogram_item_cf"]


@pytest.mark.parametrize("name", CF)
def test_ratings_move_once(spark, name):
    assert moved(spark, name) < 1.5 * size("lineitem", "orders")


@pytest.mark.parametrize("name", ["rmse_user_cf", "rmse_item_cf", "error_histogram_item_cf"])
def test_errors_move_no_more_than_predictions(spark, name):
    """The test's stars go along with its rows: they are not joined again to what was predicted for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        assert moved(spark, name) < 1.03 * moved(spark, "predict_" + name.rsplit("_", 2)[1] + "_cf") + 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_of_written_tables_go(spark):
    """A written table's shuffles are removed when it has been written, not when the driver collects its garbage."""
    import time

    from orebed.plans.staging import staged

    kept = lambda: {f.getName() for f in iter_files(spark) if f.getName().endswith(".data")}
    before = kept()
    rows = spark.range(200_000).repartition(3, "id")
    found = staged(rows, "rows")
    for _ in range(50):
        if not (left := kept() - before):
            break
        time.sleep(0.2)
    assert not left
    assert found.count() == 200_000


def iter_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_no_variance_gives_no_similarity(spark, monkeypatch):
    """Equal ratings have no variance at all, whatever the rounding of their mean."""
    monkeypatch.setattr(R, "BROADCAST_RATINGS", 0)
    rows = [(u, i, 0.1 + 0.2 if u == 0 else 0.1 * i * u) for u in range(3) for i in range(3, 10)]
    train = spark.createDataFrame(rows, "user_id long, business_id long, stars double")
    found = {(r["a"], r["b"]): r["sim"] for r in R.similarities(train, "user_id", "business_id", 7).collect()}
    assert found == {(0, 1): 0.0, (0, 2): 0.0, (1, 2): 1.0}
    assert "Exchange" not in R.similarities(train, "user_id", "business_id", 7)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """300 users, each in 36 of the same 40 hours: all pairs of them are edges."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    hour = "timestamp_seconds(1704067200 + 3600 * (id % 40))"
    spark.range(12_000).filter("(id div 40 + id % 40) % 10 <> 0").selectExpr("id div 40 AS user_id", f"{hour} AS ts").write.parquet(f"{folder}/events.parquet")
    return folder


#: Most bytes of shuffles; the distinct visits are some 158,000 of them.
GRAPH = {"co_occurrence_edges": 250_000, "degrees": 250_000, "graph_vertices": 250_000, "connected_components": 250_000, "bfs_levels": 250_000, "modularity_of_components": 250_000, "label_propagation": 250_000, "community_report": 250_000}


@pytest.mark.parametrize("name", GRAPH)
def test_edges_do_not_travel(spark, crowd, name):
    """300 users have 44,850 edges, of which at most lists of neighbours are shuffled."""
    assert moved(spark, name, crowd) < GRAPH[name]


def test_components_of_contracted_edges(spark, monkeypatch):
    """Tasks keep trees of their edges, also of many small batches, and of text."""
    from orebed.operators import graph as G

    monkeypatch.setattr(G, "CONTRACT_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        pairs = [(f"v{i}", f"v{i + 1}") for i in range(30) if i % 10] + [("v5", "v3"), ("v1", "v1"), ("x", "x")]
        edges = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
        found = {r["vertex"]: r["component"] for r in G.connected_components(edges).collect()}
        assert G.contracted(edges).count() <= 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = [f"v{i}" for i in range(1, 31)]
    assert found == {v: min(own[i // 10 * 10 : i // 10 * 10 + 10]) for i, v in enumerate(own)}


def test_labels_joined_or_sent(spark):
    """Beyond the limit of vertices the labels are joined: the same labels."""
    from orebed.operators import graph as G

    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in rng.integers(0, 40, (120, 2)).tolist()], "src string, dst string")
    assert {tuple(r) for r in G.label_propagation(edges, 3).collect()} == {tuple(r) for r in G.label_propagation(edges, 3, limit=0).collect()}


def test_lists_of_numbers_as_bytes():
    """Gaps of any size, negative numbers, the ends of the range; also of a slice."""
    from orebed.functions.packed import packed, unpacked

    rng = np.random.default_rng(5)
    end = 2**63 - 1
    lists = [np.array(x) for x in ([0], [-1], [-end - 1, end], [-end - 1, -1, 0, end - 1], [127, 128, 255, 383, 16_767, 2**40])]
    lists += [np.unique(rng.integers(-most, most, n)) for most in (100, 10**6, end) for n in (1, 40)]
    sizes = [len(x) for x in lists]
    whole = packed(np.concatenate(lists), np.cumsum([0, *sizes[:-1]]))
    for part in (slice(0, len(lists)), slice(2, 5), slice(3, 3)):
        values, counts = unpacked(whole[part])
        assert values.tolist() == [int(v) for x in lists[part] for v in x] and counts.tolist() == sizes[part]


@pytest.mark.parametrize("kind, at", [("int", 0), ("long", -17), ("long", 2**62), ("string", 0)])
def test_labels_of_numbers(spark, monkeypatch, kind, at):
    """Neighbours as bytes, in many small lists: the labels are those of plain Python, whether they are sent or joined."""
    from orebed.operators import graph as G

    monkeypatch.setattr(G, "CONTRACT_ROWS", 7)
    monkeypatch.setattr(G, "VOTES", 5)
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2)) if a < b}
    name = (lambda v: v + at * (1 if v % 2 else -1)) if kind != "string" else (lambda v: f"v{v:02}")
    pairs = {tuple(sorted(map(name, p))) for p in pairs}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {v: v for v in near}
    for _ in range(3):
        votes = {v: [label[w] for w in near[v]] for v in near}
        label = {v: min(x, key=lambda c: (-x.count(c), c)) for v, x in votes.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        edges = spark.createDataFrame(sorted(pairs), f"src {kind}, dst {kind}")
        twice = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst")).unionByName(edges.selectExpr("src", "src AS dst"))
        for rows, once in ((edges, True), (twice, False)):
            for limit in (0, 1000):
                found = G.label_propagation(rows, 3, once=once, limit=limit)
                assert found.dtypes == [("vertex", {"long": "bigint"}.get(kind, kind)), ("label", {"long": "bigint"}.get(kind, kind))]
                assert {r["vertex"]: r["label"] for r in found.collect()} == label
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_take_a_byte(spark, tmp_path):
    """Lists of neighbours are shuffled with some byte for an edge's end: less than 3 for an edge, not 6."""
    from orebed.operators import graph as G

    spark.range(600 * 600).selectExpr("id div 600 AS src", "id % 600 AS dst").filter("src < dst and xxhash64(src, dst) % 3 = 0").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    before = written(spark)
    G.label_propagation(edges, 1, once=True)
    assert written(spark) - before < 3 * edges.count()


def test_report_of_edges_in_blocks(spark, monkeypatch, tmp_path):
    """community_report of 157,083 edges found in many blocks: beside the visits little more than a byte for an edge is shuffled."""
    monkeypatch.setattr(M, "LEAST_ROWS", 3000)
    rows = spark.range(64 * 600).filter("xxhash64(id div 64, id % 64) < 0")
    rows.selectExpr("id div 64 AS user_id", "timestamp_seconds(1704067200 + 3600 * (id % 64)) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert moved(spark, "community_report", str(tmp_path)) - moved(spark, "co_occurrence_edges", str(tmp_path)) < 1.6 * 157_083


@pytest.mark.parametrize("name", ["edge_betweenness", "max_betweenness"])
def test_betweenness_of_many_edges(spark, monkeypatch, name):
    """A million directed edges are still searched in tasks; every edge of a complete graph is the one shortest path of its ends."""
    from orebed.operators import graph as G

    monkeypatch.setattr(G, "betweenness_by_joins", None)
    n = 1010
    edges = spark.range(n * n).selectExpr(f"id div {n} AS src", f"id % {n} AS dst").filter("src < dst")
    scored = G.edge_betweenness(edges)
    if name == "max_betweenness":
        assert [tuple(r) for r in G.best_edge(scored).collect()] == [(0, 1, 1.0)]
    else:
        assert scored.agg(F.count("src"), F.min("betweenness"), F.max("betweenness")).first()[:] == (n * (n - 1) // 2, 1.0, 1.0)


@pytest.mark.parametrize("dense", [0, 1000])
def test_credits_by_levels(monkeypatch, dense):
    """Vertex by vertex or in slices, and for several roots at once: as the plain search has it."""
    from orebed.operators import graph as G

    monkeypatch.setattr(G, "DENSE", dense)
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (60, 2)) if a < b}
    both = np.array(sorted(pairs | {(b, a) for a, b in pairs}))
    own, src = np.unique(both[:, 0], return_inverse=True)
    near, first = np.searchsorted(own, both[:, 1]), np.searchsorted(src, np.arange(len(own) + 1))
    credit = sum(G.credits_of(src, near, first, np.arange(len(own))[k::4]) for k in range(4))
    want = G.edge_credits(G._adjacency(both.tolist()), own.tolist())
    assert (credit + credit[np.lexsort((src, near))]).tolist() == pytest.approx([want[min(e), max(e)] for e in both.tolist()])


@pytest.mark.parametrize("name, most", [("jaccard_pairs_exact", 3), ("lsh_precision_recall", 5)])
def test_likely_pairs_do_not_travel(spark, name, most):
    """Only lists of members are shuffled, not the pairs that are met."""
    assert moved(spark, name) < most * size("documents")


@pytest.mark.parametrize("ordered", [0, 5, 500])
def test_prefixes_in_any_order(spark, monkeypatch, ordered):
    """Frequencies known of no member, of some and of all; sets of one member to thirty."""
    from orebed.operators import lsh as L

    monkeypatch.setattr(L, "ORDERED", ordered)
    rng = np.random.default_rng(8)
    own = {s: set(rng.integers(0, 12 if s % 2 else 40, 1 + s % 30).tolist()) for s in range(60)}
    rows = spark.createDataFrame([(s, m) for s, ms in own.items() for m in ms], "business_id long, user_id int")
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    found = {(r["a"], r["b"]): r["similarity"] for r in L.exact_pairs(rows, 0.5).collect()}
    assert found == pytest.approx({k: v for k, v in want.items() if v >= 0.5})


def test_lists_are_made_once(spark):
    """The bands and the exact pairs read the same lists of members."""
    assert moved(spark, "lsh_precision_recall") < 3.5 * size("documents")


def test_candidates_do_not_travel(spark):
    """Candidates of the bands are compared where they meet: neither they nor lists of members are joined or shuffled for it."""
    found = QUERIES["lsh_pairs"](spark, SF)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 188


@pytest.mark.parametrize("key", ["int", "string"])
@pytest.mark.parametrize("small", [False, True])
def test_bands_meet_in_blocks(spark, monkeypatch, key, small):
    """Copies, near copies, sets whose rows lie apart, in one block and in many: the bands' candidates that reach the threshold."""
    from orebed.operators import lsh as L

    if small:
        monkeypatch.setattr(L, "BLOCK_MEMBERS", 100)
        monkeypatch.setattr(L, "CHUNK", 20)
        monkeypatch.setattr(L, "GATHERED", 7)
    rng = np.random.default_rng(9)
    base = [set(rng.integers(0, 60, 1 + 3 * s).tolist()) for s in range(12)]
    own = {s: base[s % 12] ^ ({int(rng.integers(0, 60))} if s % 3 else set()) or {1} for s in range(60)} | {60: set(range(5000)), 61: set(range(2, 5000)), 62: set(range(3000))}
    pairs = [(s, m) for s, ms in own.items() for m in ms]
    rng.shuffle(pairs)
    rows = spark.createDataFrame([*((int(s), int(m)) for s, m in pairs), (None, 1), (5, None)], "s int, m int").selectExpr(f"cast(s AS {key}) AS business_id", "m AS user_id").repartition(3)
    name = (lambda s: s) if key == "int" else str
    bands = {tuple(r) for r in L.candidate_pairs(L.minima(rows.filter("business_id is not null and user_id is not null"), count=9), 9, 3).collect()}
    want = {(name(a), name(b)): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if (name(a), name(b)) in bands}
    found = L.similar_pairs(rows, 0.5, 9, 3).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in found} == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    assert len(found) == len({(r["a"], r["b"]) for r in found}) > 100


def test_edges_reach_the_driver_as_columns(spark, monkeypatch):
    """max_betweenness: no Python object is made for each edge on the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from orebed.operators import graph as G

    monkeypatch.setattr(DataFrame, "toPandas", None)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert tuple(G.best_edge(G.edge_betweenness(edges)).first()) == ("a", "b", 2.0)


@pytest.fixture
def counted_large(monkeypatch):
    """Edges that count as more than a million; as they are, two triangles with an edge between them and a pair."""
    from orebed.operators import graph as G
    from orebed.plans import queries as Q

    def staged(df, name="round", made=G.staged):
        out = made(df, name)
        if name == "edges":
            out.count = lambda: 1_000_002
        return out

    monkeypatch.setattr(G, "staged", staged)
    knot = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (7, 8)]
    monkeypatch.setattr(Q, "_edges", lambda spark, _: spark.createDataFrame(knot, "src long, dst long"))


def test_girvan_newman_communities_of_many_edges(spark, counted_large):
    """No number of edges is too many."""
    found = QUERIES["girvan_newman_communities"](spark, "").collect()
    assert {r["vertex"]: r["community"] for r in found} == dict.fromkeys(range(1, 7), 1) | {7: 7, 8: 7}


def test_girvan_newman_split_of_many_edges(spark, counted_large):
    """What holds of the split is said of any number of edges."""
    found = QUERIES["girvan_newman_split"](spark, "").first()
    assert found.asDict() == {"n_vertices": 8, "value_holds": True, "n_connected": 8, "not_below": True}


def test_removals_by_arrays(monkeypatch):
    """A sequence is the same, edge by edge, whether parts are searched by arrays or not; also of text."""
    from orebed.operators import graph as G

    rng = np.random.default_rng(11)
    pairs = np.unique(np.sort(np.array([p for p in rng.integers(100, 130, (90, 2)) if p[0] != p[1]]), axis=1), axis=0)
    want = list(G.removals(pairs[:, 0], pairs[:, 1], 200))
    assert sorted((a, b) for _, a, b, _ in want) == sorted(map(tuple, pairs.tolist()))
    monkeypatch.setattr(G, "FEW_CELLS", 0)
    for dense in (1, 1000):
        monkeypatch.setattr(G, "DENSE", dense)
        found = list(G.removals(pairs[::-1, 0], pairs[::-1, 1], 200))
        assert [f[1:3] for f in found] == [w[1:3] for w in want]
        assert np.allclose([(f[0], f[3]) for f in found], [(w[0], w[3]) for w in want])
    text = pairs.astype(str).astype(object)
    assert [tuple(map(int, f[1:3])) for f in G.removals(text[:, 0], text[:, 1], 200)] == [w[1:3] for w in want]


def test_girvan_newman_merges_components(spark):
    """Equal components in turns, text, a component's rows over several batches: the order of the global loop."""
    from orebed.operators import graph as G

    shape = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (4, 6)]
    pairs = [(f"{'cab'[i]}{x}", f"{'cab'[i]}{y}") for i in range(3) for x, y in shape] + [("x", "y")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        removed = G._removed(edges, G.connected_components(edges), 2 * len(pairs)).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    live, order = set(pairs), []
    while live:
        near = G._adjacency([*live, *[(b, a) for a, b in live]])
        credit = G.edge_credits(near, near)
        order.append(min((-round(c / 2, 9), e) for e, c in credit.items())[1])
        live.discard(order[-1])
    assert [(r["src"], r["dst"]) for r in removed] == order


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", ["edge_betweenness", "max_betweenness"])
def test_betweenness_of_twins(spark, monkeypatch, name, kind):
    """Beyond the limit one of each twins is searched: copies with edges among them, without, a clique by itself, a star and a loop of four."""
    from orebed.operators import graph as G

    monkeypatch.setattr(G, "betweenness_by_joins", None)
    rng = np.random.default_rng(12)
    base = {(int(a), int(b)) for a, b in rng.integers(0, 9, (16, 2)) if a < b} | {(0, 9), (0, 10), (0, 11)}
    many = [1, 3, 4, 2, 1, 2, 1, 1, 3, 1, 1, 1]
    copies = lambda v: [100 * v + k for k in range(many[v])]
    pairs = {(x, y) for a, b in base for x in copies(a) for y in copies(b)} | {(x, y) for v in (1, 3, 8) for x in copies(v) for y in copies(v) if x < y}
    pairs |= {(x, y) for x in range(5000, 5005) for y in range(x + 1, 5005)} | {(6000, 6001), (6001, 6002), (6002, 6003), (6000, 6003)}
    near = G._adjacency([*pairs, *[(b, a) for a, b in pairs]])
    want = {e: c / 2 for e, c in G.edge_credits(near, near).items()}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long").selectExpr(f"cast(src + 1000 AS {kind}) AS src", f"cast(dst + 1000 AS {kind}) AS dst")
    scored = G.edge_betweenness(edges, limit=len(pairs), once=True)
    if name == "max_betweenness":
        best = min((-round(c, 9), e) for e, c in want.items())[1]
        assert tuple(int(x) - 1000 for x in G.best_edge(scored).first()[:2]) == best
    else:
        rows = scored.collect()
        assert {(int(a) - 1000, int(b) - 1000): c for a, b, c in rows} == pytest.approx(want)
        assert len(rows) == len(want)


def test_twins_by_chance(spark, monkeypatch):
    """Vertices said to be twins that are not: the searches are joins."""
    from orebed.operators import graph as G

    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    monkeypatch.setattr(G, "twins", lambda single: spark.createDataFrame([(1, 1, 2, False), (2, 1, 2, False), (3, 3, 1, False), (4, 4, 2, True), (5, 4, 2, True)], "vertex long, twin long, many long, apart boolean"))
    found = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(edges, limit=1).collect()}
    near = G._adjacency([*pairs, *[(b, a) for a, b in pairs]])
    assert found == pytest.approx({e: c / 2 for e, c in G.edge_credits(near, near).items()})


@pytest.mark.parametrize("name", ["jaccard_pairs_exact", "lsh_precision_recall"])
def test_exact_pairs_are_compared_where_they_meet(spark, name):
    """Lists of members are shuffled by set and by size and their frequencies counted; neither likely pairs nor lists are joined to be compared."""
    from orebed.operators import lsh as L
    from orebed.plans import queries as Q

    count, bands = L.PRESETS["pairs"]
    before = written(spark)
    L.members(Q.A.document_tokens(spark, SF), count=count if name == "lsh_precision_recall" else 0)
    lists = written(spark) - before
    assert moved(spark, name) - 2 * lists < 0.9 * size("documents")
    assert "Join" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["int", "string"])
@pytest.mark.parametrize("small", [False, True])
def test_exact_pairs_in_blocks(spark, monkeypatch, key, small):
    """Copies, near copies, large sets and single members, in one block and in many; whether pairs agree on a band."""
    from orebed.operators import lsh as L

    if small:
        for name, most in (("BLOCK_MEMBERS", 100), ("ORDERED_ROWS", 3), ("LOOKED", 5), ("ORDERED", 30)):
            monkeypatch.setattr(L, name, most)
    rng = np.random.default_rng(13)
    base = [set(rng.integers(0, 60, 1 + 3 * s).tolist()) for s in range(12)]
    own = {s: base[s % 12] ^ ({int(rng.integers(0, 60))} if s % 3 else set()) or {1} for s in range(60)} | {60: set(range(5000)), 61: set(range(2, 5000)), 62: set(range(3000))}
    rows = spark.createDataFrame([(int(s), int(m)) for s, ms in own.items() for m in ms], "s int, m int").selectExpr(f"cast(s AS {key}) AS business_id", "m AS user_id").repartition(3)
    name = (lambda s: s) if key == "int" else str
    bands = {tuple(r) for r in L.candidate_pairs(L.minima(rows, count=9), 9, 3).collect()}
    want = {(name(a), name(b)): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if name(a) < name(b)}
    want = {k: v for k, v in want.items() if v >= 0.5}
    found = L.exact_pairs(rows, 0.5, count=9, bands=3).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in found} == pytest.approx(want)
    assert len(found) == len(want)
    assert {(r["a"], r["b"]) for r in found if r["banded"]} == set(want) & bands
    assert L.recall_of(L.exact_pairs(rows, 0.5, count=9, bands=3)).first()[:3] == (len(set(want) & bands), 0, len(set(want) - bands))
    assert {(r["a"], r["b"]) for r in L.exact_pairs(rows, 0.5).collect()} == set(want)
