"""Golden and property tests on toy inputs (FIXTURES.md)."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orebed.functions.scalars import hash_parameters, is_prime, next_prime
from orebed.operators import baskets as B
from orebed.operators import graph as G
from orebed.operators import itemsets as I
from orebed.operators import lsh as L
from orebed.operators import recommend as R
from orebed.operators import statistics as S
from orebed.sources import readers, sinks

BASKETS = ["abc", "abc", "ab", "acd", "bc", "abd", "ad", "abcd"]
GRAPHS = {
    1: ("a-b a-c b-c b-d d-e d-f d-g e-f f-g", {"b-d": 12, "a-b": 5, "b-c": 5, "d-e": 4.5, "d-g": 4.5, "d-f": 4, "e-f": 1.5, "f-g": 1.5, "a-c": 1}, ["abc", "defg"], 4.666667),
    2: ("a-b b-d b-g d-g d-h g-h", {"a-b": 4, "b-d": 3, "b-g": 3, "d-h": 2, "g-h": 2, "d-g": 1}, ["abdgh"], 1.333333),
    4: ("a-d b-e e-f c-f", {"e-f": 4, "b-e": 3, "c-f": 3, "a-d": 1}, ["ad", "be", "cf"], 2.375),
}
LABELS = {1: {"a": "a", "b": "a", "c": "a", "d": "b", "f": "b", "e": "d", "g": "d"}, 2: dict(a="b", b="a", d="b", g="b", h="a"), 4: dict(a="d", b="c", c="b", d="a", e="b", f="c")}


def rows_of(spark, lists):
    return spark.createDataFrame([(i, x) for i, b in enumerate(lists, 1) for x in b], "basket long, item string")


def edges_of(spark, spec):
    return spark.createDataFrame([tuple(e.split("-")) for e in spec.split()], "src string, dst string")


def sets(df):
    return {"".join(r["items"]): r["support"] for r in df.collect()}


def test_itemsets(spark):
    rows = rows_of(spark, BASKETS)
    assert sets(I.frequent_itemsets(rows, 4)) == dict(a=7, b=6, c=5, d=4, ab=5, ac=4, ad=4, bc=4)
    wanted = I.partition_candidates(rows, 4, parts=2)
    assert {"".join(r[0]) for r in wanted.collect()} == set("a b c d ab ac ad bc bd cd abc abd acd".split())
    assert sets(I.count_candidates(rows, wanted, 4)) == sets(I.frequent_itemsets(rows, 4)) == sets(I.fp_growth(rows, 4))
    text = sinks.itemset_text(wanted, I.frequent_itemsets(rows, 4))
    assert "Frequent Itemsets:\n('a'),('b'),('c'),('d')\n\n('a', 'b'),('a', 'c')" in text


def test_itemsets_are_complete_for_random_baskets(spark):
    rng = random.Random(5)
    lists = ["".join(sorted(rng.sample("abcdefg", rng.randint(1, 5)))) for _ in range(40)]
    rows = rows_of(spark, lists)
    want = {}
    for k in range(1, 6):
        for items in itertools.combinations("abcdefg", k):
            n = sum(set(items) <= set(b) for b in lists)
            if n >= 6:
                want["".join(items)] = n
    assert sets(I.frequent_itemsets(rows, 6)) == want
    assert set(want) <= {"".join(r[0]) for r in I.partition_candidates(rows, 6, parts=3).collect()}


def test_empty_baskets(spark):
    rows = rows_of(spark, [])
    assert I.frequent_itemsets(rows, 2).count() == 0
    assert B.co_occurrence(rows, 1).count() == 0


def test_baskets(spark):
    rows = spark.createDataFrame([("u1", "b1"), ("u1", "b1"), ("u1", "b2"), ("u2", "b1")], "user_id string, business_id string")
    assert {r["basket"]: r["items"] for r in B.as_lists(B.baskets(rows, 1)).collect()} == {"u1": ["b1", "b2"], "u2": ["b1"]}
    assert [r["basket"] for r in B.larger_than(B.baskets(rows, 2), 1).select("basket").distinct().collect()] == ["b1"]
    with pytest.raises(ValueError):
        B.baskets(rows, 3)


def test_similarity(spark):
    rng = random.Random(1)
    base = [rng.sample(range(200), 40) for _ in range(6)]
    table = []
    for s, own in enumerate(base):
        for copy in range(3):
            table += [(10 * s + copy, x if rng.random() > 0.08 * copy else rng.randrange(200)) for x in own]
    rows = spark.createDataFrame(table, "business_id long, user_id long").distinct()
    members = {}
    for s, x in rows.collect():
        members.setdefault(s, set()).add(x)
    want = {(a, b): len(members[a] & members[b]) / len(members[a] | members[b]) for a in members for b in members if a < b}
    want = {k: v for k, v in want.items() if v >= 0.5}
    exact = {(r["a"], r["b"]): r["similarity"] for r in L.exact_pairs(rows, 0.5).collect()}
    assert exact == pytest.approx(want)
    found = {(r["a"], r["b"]) for r in L.similar_pairs(rows, 0.5).collect()}
    assert found <= set(want) and len(found) >= 0.9 * len(want)
    assert {r["user_id"]: r["index"] for r in L.dense_index(rows, "user_id").collect()} == {v: i for i, v in enumerate(sorted({x for _, x in table}))}


def test_hash_parameters():
    for a, b, p, m in hash_parameters(5, 1000, 3):
        assert a >= 1 and p > m > 1000 and is_prime(p) and is_prime(m)
    assert next_prime(0) == 2 and next_prime(7) == 11 and not is_prime(1)


RATED = {"u1": dict(i1=5, i2=3, i3=4), "u2": dict(i1=4, i2=2, i3=3, i4=5), "u3": dict(i1=1, i2=5, i3=2, i4=1), "u4": dict(i1=3, i2=3, i4=4)}
TEST = [("u1", "i4"), ("u4", "i3"), ("u9", "i1"), ("u1", "i9")]


def rated(spark):
    schema = "user_id string, business_id string, stars double"
    train = spark.createDataFrame([(u, i, float(r)) for u, own in RATED.items() for i, r in own.items()], schema)
    return train, spark.createDataFrame([(u, i, 3.0) for u, i in TEST], schema)


def predictions(df):
    return [round({(r[0], r[1]): r[2] for r in df.collect()}[k], 6) for k in TEST]


def test_ratings(spark):
    train, test = rated(spark)
    assert predictions(R.user_based(train, test, R.Preset(2, 3))) == [5.0, 3.131917, 3.214286, 4.0]
    assert predictions(R.item_based(train, test, R.Preset(2, 2))) == [4.498966, 3.510004, 3.214286, 4.0]
    sims = {(r["a"], r["b"]): round(r["sim"], 6) for r in R.similarities(train, "user_id", "business_id", 2).collect()}
    assert sims == {("u1", "u2"): 1.0, ("u1", "u3"): -0.960769, ("u2", "u3"): -0.886593, ("u2", "u4"): 0.755929, ("u3", "u4"): -0.5, ("u1", "u4"): 0.0}
    for case in (1, 4):
        found = {(r[0], r[1]): r[2] for r in R.predict(train, test, case).collect()}
        assert set(found) == set(TEST) and all(0 <= v <= 5 for v in found.values())
        assert found["u9", "i1"] == pytest.approx(3.214286, abs=1e-6) or case == 1
    with pytest.raises(ValueError):
        R.predict(train, test, 9)
    same = test.select("user_id", "business_id", F.lit(2.0).alias("prediction"))
    assert R.rmse(test, same).first()["rmse"] == 1.0
    assert [(r["bin"], r["n"]) for r in R.error_histogram(test, same).collect()] == [(1, 4)]


def test_cross_validation(spark):
    train, _ = rated(spark)
    assert len(R.cross_validate(train, [2], [0.05, 0.1], folds=2, iterations=2)) == 2


@pytest.mark.parametrize("n", GRAPHS)
def test_graphs(spark, n):
    spec, between, split, value = GRAPHS[n]
    edges = edges_of(spark, spec)
    found = {f"{r['src']}-{r['dst']}": r["betweenness"] for r in G.edge_betweenness(edges).collect()}
    assert found == pytest.approx(between)
    best = G.best_edge(G.edge_betweenness(edges)).first()
    assert f"{best['src']}-{best['dst']}" == max(between, key=lambda e: (between[e], [-ord(c) for c in e]))
    groups = {}
    for r in G.girvan_newman(edges).collect():
        groups.setdefault(r["community"], []).append(r["vertex"])
        assert r["modularity"] == pytest.approx(value, abs=1e-6)
    assert sorted("".join(sorted(g)) for g in groups.values()) == split
    assert {r["vertex"]: r["label"] for r in G.label_propagation(edges).collect()} == LABELS[n]


def test_betweenness_by_joins(spark):
    """Beyond the limit no task has the graph: the same values, in one turn and in several."""
    edges = edges_of(spark, GRAPHS[1][0])
    want = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(edges).collect()}
    found = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(edges, limit=1).collect()}
    assert found == pytest.approx(want)
    found = {(r["src"], r["dst"]): r["betweenness"] for r in G.betweenness_by_joins(G.both_ways(edges), roots=3).collect()}
    assert found == pytest.approx(want)
    with pytest.raises(ValueError):
        G.girvan_newman(edges, limit=1)


def test_similarities_by_blocks(spark, monkeypatch):
    """Broadcast lists, and shuffled lists in blocks, give the same correlations."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(f"u{u}", f"i{i}", float(rng.randint(1, 5))) for u in range(25) for i in range(12) if rng.random() < 0.6 or i == 0], "user_id string, business_id string, stars double")
    want = {(r["a"], r["b"]): r["sim"] for r in R.similarities(rows, "user_id", "business_id", 4).collect()}
    some = rows.filter("user_id < 'u15'")
    asked = {(r["a"], r["b"]): r["sim"] for r in R.similarities(rows, "user_id", "business_id", 4, some).collect()}
    monkeypatch.setattr(R, "BROADCAST_RATINGS", 0)
    monkeypatch.setattr(R, "BLOCK_RATINGS", 4)
    assert want and {(r["a"], r["b"]): r["sim"] for r in R.similarities(rows, "user_id", "business_id", 4).collect()} == pytest.approx(want)
    assert asked == {(a, b): v for (a, b), v in want.items() if a < "u15" or b < "u15"}


def test_girvan_newman_equals_the_global_loop(spark):
    rng = random.Random(2)
    for _ in range(2):
        pairs = {tuple(sorted(rng.sample(range(11), 2))) for _ in range(14)}
        original = G._adjacency([*pairs, *[(b, a) for a, b in pairs]])
        m2 = 2 * len(pairs)

        def score(parts):
            total = 0.0
            for part in parts:
                for i, j in itertools.combinations(part, 2):
                    total += (j in original[i]) - len(original[i]) * len(original[j]) / m2
            return total

        live, best, keep = set(pairs), None, None
        while live:
            near = G._adjacency([*live, *[(b, a) for a, b in live]])
            parts = G._parts(near, original)
            if best is None or score(parts) > best + 1e-9:
                best, keep = score(parts), parts
            credit = G.edge_credits(near, near)
            live.discard(min((-round(c / 2, 9), e) for e, c in credit.items())[1])
        found = G.girvan_newman(spark.createDataFrame(list(pairs), "src long, dst long")).collect()
        groups = {}
        for r in found:
            groups.setdefault(r["community"], []).append(r["vertex"])
        assert sorted(map(sorted, groups.values())) == sorted(keep)
        assert found[0]["modularity"] == pytest.approx(best)


def test_betweenness_sums_to_path_lengths(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(15), 2))) for _ in range(25)}
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    total = G.edge_betweenness(edges).agg(F.sum("betweenness")).first()[0]
    lengths = sum(G.bfs(edges, v).agg(F.sum("level")).first()[0] for v in sorted({x for p in pairs for x in p})[:1])
    assert lengths > 0 and total > 0
    near = G._adjacency([*pairs, *[(b, a) for a, b in pairs]])
    far = 0
    for s in near:
        seen, ring, d = {s}, [s], 0
        while ring:
            d += 1
            ring = sorted({w for v in ring for w in near[v]} - seen)
            seen |= set(ring)
            far += d * len(ring)
    assert total == pytest.approx(far / 2)


def test_graph_accessors(spark):
    edges = edges_of(spark, GRAPHS[1][0])
    assert G.twice_edges(edges).first()["m2"] == 18
    assert {r["vertex"]: r["degree"] for r in G.degrees(edges).collect()}["d"] == 4
    assert G.delete_edge(edges, "d", "b").count() == 8
    assert G.modularity(edges, G.connected_components(edges)).first()["modularity"] == pytest.approx(1.388889, abs=1e-6)
    cut = G.connected_components(G.delete_edge(edges, "b", "d"))
    assert {r["vertex"]: r["component"] for r in cut.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("defg", "d")}
    assert G.modularity(edges, cut).first()["modularity"] == pytest.approx(4.666667, abs=1e-6)
    assert [r["line"] for r in sinks.community_report(G.communities(cut, "component")).collect()] == ["'a', 'b', 'c'", "'d', 'e', 'f', 'g'"]
    lines = [r["line"] for r in sinks.betweenness_report(G.edge_betweenness(edges)).collect()]
    assert lines[0] == "('b', 'd'), 12.0"


def test_statistics_and_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"date":"2018-01-02","user_id":"u1","business_id":"b1","stars":4,"x":1}\n{"date":"2017-01-02","user_id":"u2","business_id":"b1","stars":2}\n')
    (tmp_path / "b.json").write_text('{"business_id":"b1","city":"Ulm, DE"}\n')
    reviews, shops = readers.reviews(spark, str(tmp_path / "r.json")), readers.businesses(spark, str(tmp_path / "b.json"))
    row = S.review_report(reviews, 2018).first()
    assert (row["n_review"], row["n_review_year"], row["n_user"], row["top_business"]) == (2, 1, 2, '[["b1",2]]')
    cities = S.average_by_city(reviews, shops)
    assert [tuple(r) for r in cities.collect()] == [("Ulm, DE", 3.0)]
    sinks.write_text(sinks.plain_lines(cities), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text() == "city,stars\nUlm, DE,3.0\n"
    assert [r["line"] for r in sinks.plain_lines(cities, header_separator=", ").collect()] == ["city, stars", "Ulm, DE,3.0"]
    report = S.partition_report(reviews, 3)
    assert sum(report["customized"]["n_items"]) == 2 and set(S.first_rows_report(cities)) == {"m1", "m2", "explanation"}
    (tmp_path / "ub.csv").write_text("user_id,business_id\nu1,b1\nuser_id,business_id\n")
    assert readers.user_business(spark, str(tmp_path / "ub.csv")).count() == 2
    assert readers.user_business(spark, str(tmp_path / "ub.csv"), compat_header=True).count() == 1
    assert readers.user_business(spark, str(tmp_path / "ub.csv"), min_partitions=2).count() == 2
    assert "Exchange" not in readers.user_business(spark, str(tmp_path / "ub.csv"), min_partitions=2)._jdf.queryExecution().executedPlan().toString()


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "r.json").write_text("{not json\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.reviews(spark, str(tmp_path / "r.json")).collect()
