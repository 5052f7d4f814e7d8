"""Registered queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.functions.scalars import hash_parameters
from orebed.operators import baskets as B
from orebed.operators import graph as G
from orebed.operators import itemsets as I
from orebed.operators import lsh as L
from orebed.operators import recommend as R
from orebed.operators import statistics as S
from orebed.plans.staging import staged
from orebed.sources import adapters as A
from orebed.sources import sinks

YEAR = 1998
SHARE = 0.004
PARTS = 4
LARGE = 4
JACCARD = 0.5
ITEM_JACCARD = 0.2
HOURS = 12

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL of the same result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def set_text(items: str = "items"):
    return F.array_join(F.col(items).cast("array<string>"), ",")


# ---- reviews

REVIEWS = """reviews AS (SELECT o_orderdate AS date, o_custkey AS user_id, l_suppkey AS business_id, l_quantity / 10 AS stars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {REVIEWS} SELECT count(*) AS n_review FROM reviews")
def review_count(spark, d):
    return S.review_count(A.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT count(*) AS n_review FROM reviews WHERE year(date) = {YEAR}")
def review_count_year(spark, d):
    return S.review_count_year(A.reviews(spark, d), YEAR)


@query(f"WITH {REVIEWS} SELECT count(DISTINCT user_id) AS n_user FROM reviews")
def distinct_users(spark, d):
    return S.distinct_count(A.reviews(spark, d), "user_id", "n_user")


@query(f"WITH {REVIEWS} SELECT count(DISTINCT business_id) AS n_business FROM reviews")
def distinct_businesses(spark, d):
    return S.distinct_count(A.reviews(spark, d), "business_id", "n_business")


@query(f"WITH {REVIEWS} SELECT user_id, count(*) AS n_review FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_users(spark, d):
    return S.top_k(A.reviews(spark, d), "user_id")


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n_review FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_businesses(spark, d):
    return S.top_k(A.reviews(spark, d), "business_id")


def _top_sql(key: str) -> str:
    return f"""(SELECT '[' || coalesce(string_agg('["' || {key} || '",' || n || ']', ',' ORDER BY n DESC, {key}), '') || ']'
      FROM (SELECT {key}, count(*) AS n FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))"""


@query(f"""WITH {REVIEWS} SELECT count(*) AS n_review, count(*) FILTER (year(date) = {YEAR}) AS n_review_year,
  count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business,
  {_top_sql("user_id")} AS top_user, {_top_sql("business_id")} AS top_business FROM reviews""")
def review_report(spark, d):
    return S.review_report(A.reviews(spark, d), YEAR)


CITY = f"""WITH {REVIEWS}, business AS (SELECT s_suppkey AS business_id, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT city, round(avg(stars), 6) AS stars FROM reviews JOIN business USING (business_id) GROUP BY city"""


@query(CITY)
def avg_stars_by_city(spark, d):
    return S.average_by_city(A.reviews(spark, d), A.businesses(spark, d)).select("city", F.round("stars", 6).alias("stars"))


@query(CITY + " ORDER BY avg(stars) DESC, city LIMIT 10")
def top10_cities(spark, d):
    return S.average_by_city(A.reviews(spark, d), A.businesses(spark, d)).limit(10).select("city", F.round("stars", 6).alias("stars"))


@query()
def partition_report(spark, d):
    return S.partition_sizes(A.reviews(spark, d).repartition(8, "business_id"))


@query(f"WITH {REVIEWS} SELECT count(*) AS n_items FROM reviews")
def partition_total(spark, d):
    return S.partition_sizes(A.reviews(spark, d).repartition(8, "business_id")).agg(F.sum("n_items").alias("n_items"))


# ---- baskets and itemsets

BASKETS = "rows AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark, d):
    return B.baskets(A.purchases(spark, d), 1)


@query(f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM rows GROUP BY basket")
def user_baskets(spark, d):
    return B.as_lists(_baskets(spark, d)).select("basket", set_text().alias("items"))


@query(f"WITH {BASKETS} SELECT item AS basket, string_agg(basket, ',' ORDER BY basket) AS items FROM rows GROUP BY item")
def item_baskets(spark, d):
    return B.as_lists(B.baskets(A.purchases(spark, d), 2)).select("basket", set_text().alias("items"))


LARGER = f"{BASKETS}, big AS (SELECT * FROM rows WHERE basket IN (SELECT basket FROM rows GROUP BY 1 HAVING count(*) > {LARGE}))"


@query(f"WITH {LARGER} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM big GROUP BY basket")
def large_baskets(spark, d):
    return B.as_lists(B.larger_than(_baskets(spark, d), LARGE)).select("basket", set_text().alias("items"))


def _sets_sql(rows: str, part: str = "0", sizes=(1, 2, 3, 4)) -> str:
    """CTE sets(part, k, items, n) of all itemsets up to size 4 with their counts."""
    out = []
    for k in sizes:
        names = [f"r{i}" for i in range(k)]
        joins = f"{rows} r0" + "".join(f" JOIN {rows} r{i} ON r{i}.basket = r0.basket AND r{i}.item > r{i - 1}.item" for i in range(1, k))
        items = " || ',' || ".join(f"{n}.item" for n in names)
        of = part.replace("basket", "r0.basket")
        out.append(f"SELECT {of} AS part, {k} AS k, {items} AS items, count(*) AS n FROM {joins} GROUP BY 1, 2, 3")
    return "sets AS (" + " UNION ALL ".join(out) + ")"


NEEDED = f"ceil((SELECT count(DISTINCT basket) FROM rows) * {SHARE})"
ALL_SETS = f"WITH {BASKETS}, {_sets_sql('rows')} SELECT k AS size, items, n AS support FROM sets WHERE n >= {NEEDED}"


def _frequent(spark, d, largest=None):
    found = I.frequent_itemsets(_baskets(spark, d), share=SHARE, largest=largest)
    return found.select(F.size("items").alias("size"), set_text().alias("items"), "support")


@query(ALL_SETS + " AND k = 1")
def fi_singles(spark, d):
    return _frequent(spark, d, 1)


@query(ALL_SETS + " AND k = 2")
def fi_pairs(spark, d):
    return _frequent(spark, d, 2).filter("size = 2")


@query(ALL_SETS + " AND k = 3")
def fi_triples(spark, d):
    return _frequent(spark, d, 3).filter("size = 3")


@query(ALL_SETS)
def fi_all(spark, d):
    return _frequent(spark, d)


LARGE_SETS = f"WITH {LARGER}, {_sets_sql('big')} SELECT k AS size, items, n AS support FROM sets WHERE n >= ceil((SELECT count(DISTINCT basket) FROM big) * {SHARE} * 2)"


@query(LARGE_SETS)
def fi_large_baskets(spark, d):
    found = I.frequent_itemsets(B.larger_than(_baskets(spark, d), LARGE), share=SHARE * 2)
    return found.select(F.size("items").alias("size"), set_text().alias("items"), "support")


CANDIDATES = f"""WITH {BASKETS}, {_sets_sql("rows", f"basket % {PARTS}")},
sizes AS (SELECT basket % {PARTS} AS part, count(DISTINCT basket) AS np FROM rows GROUP BY 1)
SELECT DISTINCT k AS size, items FROM sets JOIN sizes USING (part)
WHERE n >= greatest(1, floor(CAST({NEEDED} AS BIGINT) * np / (SELECT count(DISTINCT basket) FROM rows)))"""


@query(CANDIDATES)
def son_candidates(spark, d):
    found = I.partition_candidates(_baskets(spark, d), share=SHARE, parts=PARTS)
    return found.select(F.size("items").alias("size"), set_text().alias("items"))


@query(ALL_SETS)
def son_frequent(spark, d):
    rows = _baskets(spark, d)
    wanted = I.partition_candidates(rows, share=SHARE, parts=PARTS)
    needed = rows.agg(F.ceil(F.countDistinct("basket") * SHARE).cast("long")).first()[0]
    return I.count_candidates(rows, wanted, needed).select(F.size("items").alias("size"), set_text().alias("items"), "support")


@query(f"""WITH {BASKETS}, {_sets_sql("rows")}
SELECT k AS size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line
FROM sets WHERE n >= {NEEDED} GROUP BY k""")
def fi_report(spark, d):
    return sinks.itemset_report(I.frequent_itemsets(_baskets(spark, d), share=SHARE))


@query(ALL_SETS)
def fi_fpgrowth(spark, d):
    rows = _baskets(spark, d)
    needed = rows.agg(F.ceil(F.countDistinct("basket") * SHARE).cast("long")).first()[0]
    return I.fp_growth(rows, needed).select(F.size("items").alias("size"), set_text().alias("items"), "support")


# ---- set similarity

TOKENS = "rows AS (SELECT DISTINCT doc_id AS s, unnest(string_split(lower(text), ' ')) AS t FROM documents)"


def _exact_sql(rows: str, threshold: float) -> str:
    return f"""sizes AS (SELECT s, count(*) AS n FROM {rows} GROUP BY 1),
shared AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM {rows} x JOIN {rows} y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2),
exact AS (SELECT a, b, k / (p.n + q.n - k) AS similarity FROM shared JOIN sizes p ON p.s = a JOIN sizes q ON q.s = b
  WHERE k / (p.n + q.n - k) >= {threshold})"""


@query(f"WITH {TOKENS}, {_exact_sql('rows', JACCARD)} SELECT a, b, round(similarity, 6) AS similarity FROM exact")
def jaccard_pairs_exact(spark, d):
    return L.exact_pairs(A.document_tokens(spark, d), JACCARD).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _signature_sql(rows: str, preset: str) -> str:
    count, bands = L.PRESETS[preset]
    values = ", ".join(f"({h}, {a}, {b}, {p}, {m})" for h, (a, b, p, m) in enumerate(hash_parameters(count, L.BINS)))
    return f"""params(h, a, b, p, m) AS (SELECT CAST(c0 AS BIGINT), CAST(c1 AS BIGINT), CAST(c2 AS BIGINT), CAST(c3 AS BIGINT), CAST(c4 AS BIGINT)
  FROM (VALUES {values}) v(c0, c1, c2, c3, c4)),
indexed AS (SELECT s, CAST('0x' || substr(md5(CAST(t AS VARCHAR)), 1, 8) AS BIGINT) AS x FROM {rows}),
signed AS (SELECT s, h, min(((x * a + b) % p) % m) AS mh FROM indexed CROSS JOIN params GROUP BY 1, 2),
buckets AS (SELECT s, h % {bands} AS band, string_agg(h || ':' || mh, ',' ORDER BY h) AS bucket FROM signed GROUP BY 1, 2),
candidates AS (SELECT DISTINCT x.s AS a, y.s AS b FROM buckets x JOIN buckets y ON x.band = y.band AND x.bucket = y.bucket AND x.s < y.s)"""


@query(f'WITH {TOKENS}, {_signature_sql("rows", "pairs")} SELECT s AS "set", CAST(h AS INTEGER) AS h, mh FROM signed')
def minhash_signatures(spark, d):
    return L.signatures(A.document_tokens(spark, d), count=L.PRESETS["pairs"][0])


@query(f"WITH {TOKENS}, {_signature_sql('rows', 'pairs')} SELECT a, b FROM candidates")
def lsh_candidates(spark, d):
    count, bands = L.PRESETS["pairs"]
    return L.candidate_pairs(L.minima(A.document_tokens(spark, d), count=count), count, bands)


def _lsh_pairs(spark, d):
    count, bands = L.PRESETS["pairs"]
    return L.similar_pairs(A.document_tokens(spark, d), JACCARD, count, bands)


VERIFIED = f"{TOKENS}, {_signature_sql('rows', 'pairs')}, {_exact_sql('rows', JACCARD)}, verified AS (SELECT a, b, similarity FROM exact JOIN candidates USING (a, b))"


@query(f"WITH {VERIFIED} SELECT a, b, round(similarity, 6) AS similarity FROM verified")
def lsh_pairs(spark, d):
    return _lsh_pairs(spark, d).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {VERIFIED}, n AS (SELECT (SELECT count(*) FROM verified) AS tp, (SELECT count(*) FROM exact) AS truth)
SELECT tp, CAST(0 AS BIGINT) AS fp, truth - tp AS fn, CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS precision, round(tp / nullif(truth, 0), 6) AS recall FROM n""")
def lsh_precision_recall(spark, d):
    """Verified pairs are never false, so the SQL has fp 0 and precision 1 as constants; hash parameters are those of the code, the values are worked out anew.
    Candidates that reach the threshold are the exact pairs that agree on a band, so these are looked at in the search for all pairs."""
    count, bands = L.PRESETS["pairs"]
    pairs = L.exact_pairs(A.document_tokens(spark, d), JACCARD, count=count, bands=bands)
    return L.recall_of(pairs).withColumn("recall", F.round("recall", 6))


# ---- ratings

RATINGS = """rated AS (SELECT o_custkey AS u, l_suppkey AS i, avg(l_quantity) / 10 AS r, min(l_orderkey) % 5 = 0 AS is_test
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
train AS (SELECT u, i, r FROM rated WHERE NOT is_test), test AS (SELECT u, i, r FROM rated WHERE is_test),
mean AS (SELECT u, avg(r) AS m FROM train GROUP BY 1), whole AS (SELECT avg(r) AS g FROM train)"""
PEARSON = "round(coalesce(covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0), 0), 10)"


def _split(spark, d):
    return A.split(A.ratings(spark, d))


def _split_once(spark, d):
    """As ``_split``, of ratings written once, where they are read several times."""
    return A.split(staged(A.ratings(spark, d), "rated"))


def _sims_sql(of: str, over: str, preset: R.Preset) -> str:
    limit = f"QUALIFY row_number() OVER (PARTITION BY key ORDER BY sim DESC, nbr) <= {preset.top}" if preset.top else ""
    return f"""sims AS (SELECT x.{of} AS a, y.{of} AS b, {PEARSON} AS sim FROM train x JOIN train y ON x.{over} = y.{over} AND x.{of} < y.{of}
  GROUP BY 1, 2 HAVING count(*) >= {preset.support}),
near AS (SELECT * FROM (SELECT a AS key, b AS nbr, sim FROM sims UNION ALL SELECT b, a, sim FROM sims) WHERE sim <> 0 {limit})"""


USER_SIMS = _sims_sql("u", "i", R.PRESETS_PY["user"])
ITEM_SIMS = _sims_sql("i", "u", R.PRESETS_PY["item"])
TAIL = """SELECT t.u AS user_id, t.i AS business_id,
  round(CASE WHEN pred IS NOT NULL THEN greatest(0, least(5, pred)) ELSE coalesce(m, (SELECT g FROM whole)) END + 1e-9, 6) AS prediction
FROM test t LEFT JOIN predicted p ON p.u = t.u AND p.i = t.i LEFT JOIN mean ON mean.u = t.u"""
USER_PREDICTED = """predicted AS (SELECT s.u, s.i, any_value(o.m) + sum(sim * (r - n.m)) / nullif(sum(abs(sim)), 0) AS pred FROM (SELECT t.u, t.i, nbr, sim FROM test t JOIN near ON key = t.u) s
  JOIN train ON train.u = s.nbr AND train.i = s.i JOIN mean n ON n.u = s.nbr JOIN mean o ON o.u = s.u GROUP BY 1, 2)"""
ITEM_PREDICTED = """predicted AS (SELECT s.u, s.i, sum(sim * r) / nullif(sum(abs(sim)), 0) AS pred FROM (SELECT t.u, t.i, nbr, sim FROM test t JOIN near ON key = t.i) s
  JOIN train ON train.i = s.nbr AND train.u = s.u GROUP BY 1, 2)"""
LSH_NEAR = f"""rows AS (SELECT i AS s, u AS t FROM train), {_signature_sql("rows", "recommend")}, {_exact_sql("rows", ITEM_JACCARD)},
sims AS (SELECT c.a, c.b, {PEARSON} AS sim FROM (SELECT a, b FROM exact JOIN candidates USING (a, b)) c JOIN train x ON x.i = c.a JOIN train y ON y.i = c.b AND y.u = x.u GROUP BY 1, 2),
near AS (SELECT a AS key, b AS nbr, sim FROM sims UNION ALL SELECT b, a, sim FROM sims)"""


@query(f"WITH {RATINGS} SELECT u AS user_id, round(m + 1e-9, 6) AS mean FROM mean")
def user_means(spark, d):
    return R.means(_split(spark, d)[0]).select("user_id", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


@query(f"WITH {RATINGS} SELECT round(g, 6) AS mean FROM whole")
def global_mean(spark, d):
    return R.global_mean(_split(spark, d)[0]).select(F.round("mean", 6).alias("mean"))


@query(f"WITH {RATINGS}, {USER_SIMS} SELECT key, nbr, round(sim, 6) AS sim FROM near")
def user_similarity_top3(spark, d):
    p = R.PRESETS_PY["user"]
    return R.neighbours(R.similarities(_split_once(spark, d)[0], "user_id", "business_id", p.support), p.top).select("key", "nbr", F.round("sim", 6).alias("sim"))


@query(f"WITH {RATINGS}, {ITEM_SIMS} SELECT key, nbr, round(sim, 6) AS sim FROM near")
def item_similarity_top2(spark, d):
    p = R.PRESETS_PY["item"]
    return R.neighbours(R.similarities(_split_once(spark, d)[0], "business_id", "user_id", p.support), p.top).select("key", "nbr", F.round("sim", 6).alias("sim"))


def _rounded(predicted, *others):
    """Six decimals; the shift takes exact halves to one side in any engine."""
    return predicted.select("user_id", "business_id", *others, F.round(F.col("prediction") + 1e-9, 6).alias("prediction"))


PREDICT = {
    "user": f"WITH {RATINGS}, {USER_SIMS}, {USER_PREDICTED} {TAIL}",
    "item": f"WITH {RATINGS}, {ITEM_SIMS}, {ITEM_PREDICTED} {TAIL}",
    "lsh": f"WITH {RATINGS}, {LSH_NEAR}, {ITEM_PREDICTED} {TAIL}",
}


@query(PREDICT["user"])
def predict_user_cf(spark, d):
    return _rounded(R.predict(*_split_once(spark, d), case=2))


@query(PREDICT["item"])
def predict_item_cf(spark, d):
    return _rounded(R.predict(*_split_once(spark, d), case=3))


@query(PREDICT["lsh"])
def predict_lsh_cf(spark, d):
    return _rounded(R.predict(*_split(spark, d), case=4))


@query()
def predict_als(spark, d):
    return R.predict(*_split(spark, d), case=1)


@query(f"""WITH {RATINGS} SELECT t.u AS user_id, t.i AS business_id, round(coalesce(m, g) + 1e-9, 6) AS prediction FROM test t CROSS JOIN whole LEFT JOIN mean USING (u)
WHERE t.u NOT IN (SELECT u FROM train) OR t.i NOT IN (SELECT i FROM train)""")
def predict_als_unknown(spark, d):
    """Pairs whose user or item the factorisation has not seen: what they fall back to."""
    train, test = _split(spark, d)
    seen = R.predict(train, test, case=1)
    both = test.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("business_id").distinct(), "business_id", "left_semi")
    return _rounded(seen.join(both.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti"))


@query(f"WITH {RATINGS} SELECT count(*) AS n, true AS in_range FROM test")
def predict_als_bounds(spark, d):
    """Every pair has one prediction, from 0 to 5: the SQL says what must hold, as the factors themselves are beyond SQL."""
    return R.predict(*_split(spark, d), case=1).agg(F.count("prediction").alias("n"), F.every(F.col("prediction").between(0, 5)).alias("in_range"))


def _error_sql(method: str) -> str:
    return PREDICT[method].replace(TAIL, f", scored AS ({TAIL})", 1) + f"""
SELECT {{}} FROM scored JOIN test ON u = user_id AND i = business_id"""


def _with_stars(spark, d, method):
    """Predictions beside the test's stars, which went along, so neither is shuffled to meet the other."""
    return _rounded(method(*_split_once(spark, d), keep=("stars",)), "stars")


@query(_error_sql("item").format("round(sqrt(avg((r - prediction) * (r - prediction))), 4) AS rmse"))
def rmse_item_cf(spark, d):
    return R.rmse(None, _with_stars(spark, d, R.item_based)).select(F.round("rmse", 4).alias("rmse"))


@query(_error_sql("user").format("round(sqrt(avg((r - prediction) * (r - prediction))), 4) AS rmse"))
def rmse_user_cf(spark, d):
    return R.rmse(None, _with_stars(spark, d, R.user_based)).select(F.round("rmse", 4).alias("rmse"))


@query(_error_sql("item").format("CAST(least(floor(abs(r - prediction)), 4) AS INTEGER) AS bin, count(*) AS n") + " GROUP BY 1")
def error_histogram_item_cf(spark, d):
    return R.error_histogram(None, _with_stars(spark, d, R.item_based))


@query(f"""WITH {RATINGS}, x AS (SELECT DISTINCT u FROM train), y AS (SELECT DISTINCT u FROM test)
SELECT (SELECT count(*) FROM (SELECT u FROM x UNION SELECT u FROM y)) AS n_union, (SELECT count(*) FROM (SELECT u FROM x INTERSECT SELECT u FROM y)) AS n_both,
  (SELECT count(*) FROM (SELECT u FROM x EXCEPT SELECT u FROM y)) AS n_train_only, (SELECT count(*) FROM (SELECT u FROM x UNION ALL SELECT u FROM y)) AS n_bag""")
def set_ops_train_test(spark, d):
    train, test = (df.select("user_id").distinct() for df in _split(spark, d))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(train.union(test).distinct(), "n_union")
    for df, name in ((train.intersect(test), "n_both"), (train.subtract(test), "n_train_only"), (train.union(test), "n_bag")):
        out = out.crossJoin(count(df, name))  # rows of one
    return out


@query("""SELECT o_custkey AS user_id, row_number() OVER (ORDER BY o_custkey) - 1 AS index FROM (SELECT DISTINCT o_custkey FROM orders)""")
def user_index(spark, d):
    return L.dense_index(A.load(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id")


# ---- graph

EDGES = f"""visits AS (SELECT DISTINCT user_id AS u, date_trunc('hour', ts) AS h FROM events),
edges AS (SELECT x.u AS src, y.u AS dst, count(*) AS weight FROM visits x JOIN visits y ON x.h = y.h AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {HOURS}),
e AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), v AS (SELECT DISTINCT src AS v FROM e),
deg AS (SELECT src AS v, count(*) AS k FROM e GROUP BY 1)"""
#: The walks end after 24 steps: longer shortest paths than these tables hold would need more.
DIST = """walk(s, v, k) AS (SELECT v, v, 0 FROM v UNION SELECT walk.s, e.dst, k + 1 FROM walk JOIN e ON e.src = walk.v WHERE k < 24),
dist AS (SELECT s, v, min(k) AS d FROM walk GROUP BY 1, 2), comp AS (SELECT v, min(s) AS c FROM dist GROUP BY 1)"""
PATHS = """path(s, v, k) AS (SELECT v, v, 0 FROM v UNION ALL SELECT p.s, e.dst, p.k + 1 FROM path p JOIN e ON e.src = p.v JOIN dist t ON t.s = p.s AND t.v = e.dst AND t.d = p.k + 1),
sigma AS (SELECT s, v, any_value(k) AS d, CAST(count(*) AS DOUBLE) AS n FROM path GROUP BY 1, 2)"""


def _edges(spark, d):
    return B.co_occurrence(B.baskets(A.visits(spark, d), 2), HOURS)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM edges")
def co_occurrence_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {EDGES} SELECT v AS vertex FROM v")
def graph_vertices(spark, d):
    return G.vertices(_edges(spark, d))


@query(f"WITH {EDGES} SELECT v AS vertex, k AS degree FROM deg")
def degrees(spark, d):
    return G.degrees(_edges(spark, d), once=True)


@query(f"WITH RECURSIVE {EDGES}, {DIST} SELECT v AS vertex, c AS component FROM comp")
def connected_components(spark, d):
    return G.connected_components(_edges(spark, d))


def _labels_sql(rounds: int) -> str:
    out = ["l0 AS (SELECT v, v AS label FROM v)"]
    for k in range(1, rounds + 1):
        out.append(f"l{k} AS (SELECT e.src AS v, label FROM e JOIN l{k - 1} ON l{k - 1}.v = e.dst GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, label) = 1)")
    return ", ".join(out)


@query(f"WITH {EDGES}, {_labels_sql(5)} SELECT v AS vertex, label FROM l5")
def label_propagation(spark, d):
    return G.label_propagation(_edges(spark, d), 5, once=True)


@query(f"WITH {EDGES}, {_labels_sql(5)} SELECT count(*) AS size, '''' || string_agg(v, ''', ''' ORDER BY v) || '''' AS line FROM l5 GROUP BY label")
def community_report(spark, d):
    return sinks.community_report(G.communities(G.label_propagation(_edges(spark, d), 5, once=True))).withColumn("size", F.col("size").cast("long"))


@query(f"""WITH RECURSIVE {EDGES}, {DIST}, {PATHS} SELECT v AS vertex, CAST(d AS INTEGER) AS level, n AS paths,
  coalesce((SELECT string_agg(x.v, ',' ORDER BY x.v) FROM sigma x JOIN e ON e.src = x.v AND e.dst = sigma.v WHERE x.s = sigma.s AND x.d + 1 = sigma.d), '') AS parents
FROM sigma WHERE s = (SELECT min(v) FROM v)""")
def bfs_levels(spark, d):
    edges = staged(_edges(spark, d), "edges")
    root = G.vertices(edges).agg(F.min("vertex")).first()[0]
    return G.bfs(edges, root, once=True).withColumn("parents", set_text("parents"))


BETWEEN = f"""WITH RECURSIVE {EDGES}, {DIST}, {PATHS},
credit AS (SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, x.n * y.n / z.n AS c FROM e JOIN sigma x ON x.v = e.src
  JOIN sigma y ON y.s = e.dst JOIN sigma z ON z.s = x.s AND z.v = y.v AND z.d = x.d + 1 + y.d)
SELECT src, dst, round(sum(c) / 2, 6) AS betweenness FROM credit GROUP BY 1, 2"""


@query(BETWEEN)
def edge_betweenness(spark, d):
    return G.edge_betweenness(_edges(spark, d), once=True).select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


@query(f"SELECT src, dst, betweenness FROM ({BETWEEN}) ORDER BY betweenness DESC, src, dst LIMIT 1")
def max_betweenness(spark, d):
    return G.best_edge(G.edge_betweenness(_edges(spark, d), once=True)).select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


@query(f"""WITH RECURSIVE {EDGES}, {DIST}, inside AS (SELECT c, count(*) / 2 AS x FROM e JOIN comp ON comp.v = e.src GROUP BY 1),
sums AS (SELECT c, sum(k) AS s, sum(k * k) AS q FROM deg JOIN comp USING (v) GROUP BY 1)
SELECT round(CAST(sum(x - (s * s - q) / 2 / (SELECT count(*) FROM e)) AS DOUBLE), 6) AS modularity FROM sums JOIN inside USING (c)""")
def modularity_of_components(spark, d):
    edges = staged(_edges(spark, d), "edges")
    return G.modularity(edges, G.connected_components(edges), once=True).select(F.round("modularity", 6).alias("modularity"))


@query()
def girvan_newman_communities(spark, d):
    return G.girvan_newman(_edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, {DIST}, inside AS (SELECT c, count(*) / 2 AS x FROM e JOIN comp ON comp.v = e.src GROUP BY 1),
sums AS (SELECT c, sum(k) AS s, sum(k * k) AS q FROM deg JOIN comp USING (v) GROUP BY 1), whole AS (SELECT sum(x - (s * s - q) / 2 / (SELECT count(*) FROM e)) AS m FROM sums JOIN inside USING (c))
SELECT (SELECT count(*) FROM v) AS n_vertices, true AS value_holds, (SELECT count(*) FROM v) AS n_connected, true AS not_below FROM whole""")
def girvan_newman_split(spark, d):
    """What must hold of the split, as the sequence of removals is beyond SQL: its stated modularity is that of its communities and not below that
    of the components, and each vertex reaches its community's least member within the community."""
    edges = staged(_edges(spark, d), "pairs")
    split = staged(G.girvan_newman(edges), "split")
    value = G.modularity(edges, split, "community", once=True).first()["modularity"]
    whole = G.modularity(edges, G.connected_components(edges), once=True).first()["modularity"]
    of = split.select("vertex", "community")
    inner = edges.join(of.withColumnsRenamed({"vertex": "src", "community": "c"}), "src").join(of.withColumnsRenamed({"vertex": "dst", "community": "c2"}), "dst").filter("c = c2")
    reached = G.connected_components(inner.select("src", "dst")).withColumnRenamed("component", "least")
    checked = split.join(reached, "vertex", "left")
    return checked.agg(
        F.count(F.lit(1)).alias("n_vertices"), F.every(F.abs(F.col("modularity") - value) < 1e-6).alias("value_holds"),
        F.count_if(F.coalesce("least", "vertex") == F.col("community")).alias("n_connected"), F.every(F.col("modularity") >= whole - 1e-6).alias("not_below"),
    )
