"""Metric and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import statistics as st
from siltstone.plans.catalog import query
from siltstone.plans.search import _BM25, _bm25

_HITS = """, tasks AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS query_type FROM benchmark),
 m AS (SELECT item_id, min(CASE WHEN contains(d.text, q.text) THEN rank END) AS r FROM bm JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id) WHERE rank <= 10 GROUP BY item_id),
 h AS (SELECT category, query_type, CASE WHEN coalesce(r <= 1, false) THEN 1.0 ELSE 0.0 END AS h1, CASE WHEN coalesce(r <= 5, false) THEN 1.0 ELSE 0.0 END AS h5, CASE WHEN coalesce(r <= 10, false) THEN 1.0 ELSE 0.0 END AS h10, round(coalesce(1.0 / r, 0.0), 6) AS rr FROM m JOIN tasks USING (item_id))
"""
_RATES = "count(*) AS tasks, round(avg(h1), 4) AS hit_at_1, round(avg(h5), 4) AS hit_at_5, round(avg(h10), 4) AS hit_at_10, round(avg(rr), 4) AS mrr"


def _task_hits(t):
    ranked = _bm25(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")
    kinds = t.benchmark.select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.when(F.length("text") < 200, "short").otherwise("long").alias("query_type"))
    return st.first_match(ranked, ["item_id"], F.contains("text", "q")).select("item_id", *st.hits()).join(kinds, "item_id")


@query(_BM25 + _HITS + f"SELECT category, {_RATES} FROM h GROUP BY category")
def hit_mrr_summary(t):
    return st.hit_summary(_task_hits(t), ["category"])


@query(_BM25 + _HITS + f"SELECT category, query_type, {_RATES} FROM h GROUP BY GROUPING SETS ((category), (query_type), (category, query_type), ())")
def grouping_sets_summary(t):
    """All three reports in one pass over the task rows."""
    rate = lambda c, n: F.round(F.avg(F.col(c).cast("double")), 4).alias(n)
    sets = [[F.col("category")], [F.col("query_type")], [F.col("category"), F.col("query_type")], []]
    return _task_hits(t).groupingSets(sets, "category", "query_type").agg(F.count(F.lit(1)).alias("tasks"), *[rate(f"hit_at_{k}", f"hit_at_{k}") for k in (1, 5, 10)], rate("rr", "mrr")).select("category", "query_type", "tasks", "hit_at_1", "hit_at_5", "hit_at_10", "mrr")


@query(_BM25 + """, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)
 SELECT item_id, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10 FROM rel LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) USING (item_id, doc_id) GROUP BY item_id""")
def recall_at_k(t):
    from siltstone.operators.splits import containment

    relevant = containment(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), t.documents.select(F.col("doc_id").alias("id"), "text")).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))
    return st.recall_at(_bm25(t), relevant, "item_id", "doc_id", [1, 10])


@query("""WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS p, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS e FROM orders GROUP BY o_custkey),
 s AS (SELECT o_custkey, coalesce(len(p), 0) AS np, coalesce(len(e), 0) AS ne, coalesce(len(list_intersect(p, e)), 0) AS b FROM a)
SELECT o_custkey, round(CASE WHEN np = 0 THEN 0 ELSE b / np END, 6) AS "precision", round(CASE WHEN ne = 0 THEN 0 ELSE b / ne END, 6) AS recall, round(CASE WHEN np + ne = 0 THEN 0 ELSE 2.0 * b / (np + ne) END, 6) AS f1, b > 0 AS hit FROM s""")
def set_f1(t):
    """Priorities of a customer's finished orders as a prediction of those of its open ones."""
    one = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = t.orders.groupBy("o_custkey").agg(one("F").alias("p"), one("O").alias("e"))
    return rows.select("o_custkey", *st.set_metrics(F.col("p"), F.col("e")))


_COUNTS = """WITH l AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS term FROM part), n AS (SELECT count(*) AS population FROM l), t AS (SELECT term, count(*) AS successes FROM l GROUP BY term),
 g AS (SELECT p_brand, count(*) AS draws FROM l GROUP BY p_brand), o AS (SELECT p_brand, term, count(*) AS observed FROM l GROUP BY 1, 2), c AS (SELECT * FROM o JOIN t USING (term) JOIN g USING (p_brand), n)"""
_HYPER = (
    _COUNTS
    + """, lf AS (SELECT k, lgamma(k + 1.0) AS f FROM (SELECT unnest(range(0, (SELECT max(population) + 1 FROM c))) AS k)),
 x AS (SELECT p_brand, term, observed, exp(a.f - b.f - d.f + e.f - f1.f - g1.f - (h.f - i.f - j.f)) AS pr FROM c, unnest(range(observed, least(successes, draws) + 1)) AS u(k) JOIN lf a ON a.k = successes JOIN lf b ON b.k = u.k JOIN lf d ON d.k = successes - u.k
  JOIN lf e ON e.k = population - successes JOIN lf f1 ON f1.k = draws - u.k JOIN lf g1 ON g1.k = population - successes - (draws - u.k) JOIN lf h ON h.k = population JOIN lf i ON i.k = draws JOIN lf j ON j.k = population - draws),
 hp AS (SELECT p_brand, term, any_value(observed) AS observed, least(1.0, sum(pr)) AS p FROM x GROUP BY 1, 2)"""
)


def _enrichment(t):
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("term"))
    c = rows.groupBy("p_brand", "term").agg(F.count(F.lit(1)).alias("observed"))
    c = c.join(rows.groupBy("term").agg(F.count(F.lit(1)).alias("successes")), "term").join(rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("draws")), "p_brand")
    return c.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("population"))))


@query(_HYPER + " SELECT p_brand, term, observed, round(p, 6) AS p FROM hp")
def hypergeom_enrichment(t):
    """Size classes among the brands' parts."""
    return st.hypergeometric(_enrichment(t), ["p_brand", "term"]).select("p_brand", "term", "observed", F.round("p", 6).alias("p"))


@query(_HYPER + """, r AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), p_brand, term) AS r, count(*) OVER () AS m FROM hp)
 SELECT p_brand, term, round(least(1.0, min(round(p, 9) * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(t):
    p = st.hypergeometric(_enrichment(t), ["p_brand", "term"]).withColumn("p", F.round("p", 9))
    return st.benjamini_hochberg(p, order=["p_brand", "term"]).select("p_brand", "term", F.round("q", 6).alias("q"))


@query(_COUNTS + " SELECT p_brand, term, round((observed + 0.5) * (population - successes - draws + observed + 0.5) / ((draws - observed + 0.5) * (successes - observed + 0.5)), 6) AS odds_ratio, round((observed / draws) / (successes / population), 6) AS enrichment FROM c")
def odds_ratio_assoc(t):
    c = _enrichment(t)
    o, s, d, n = (F.col(x) for x in ("observed", "successes", "draws", "population"))
    return c.select("p_brand", "term", F.round(st.odds_ratio(o, d - o, s - o, n - s - d + o), 6).alias("odds_ratio"), F.round(st.enrichment(o / d, s / n), 6).alias("enrichment"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1)
SELECT source, lang, n, size, round(n / size, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) JOIN s USING (source) WHERE r = 1""")
def dominant_label_purity(t):
    return st.purity(t.documents.select("source", "lang"), "source", "lang")


@query("""WITH r AS (SELECT l_returnflag AS g, CAST(l_discount * 100 AS INTEGER) // 3 AS x, CAST(l_tax * 100 AS INTEGER) // 3 AS y FROM lineitem),
 c AS (SELECT g, x, y, count(*) AS n FROM r GROUP BY 1, 2, 3), o AS (SELECT g, sum(power((x - y) / 4.0, 2) * n) AS ob, sum(n) AS t, sum(CASE WHEN x = y THEN n ELSE 0 END) AS same FROM c GROUP BY g),
 a AS (SELECT g, x, sum(n) AS n FROM c GROUP BY 1, 2), b AS (SELECT g, y, sum(n) AS n FROM c GROUP BY 1, 2), e AS (SELECT g, sum(power((x - y) / 4.0, 2) * a.n * b.n) AS ex FROM a JOIN b USING (g) GROUP BY g)
SELECT g AS l_returnflag, CAST(t AS BIGINT) AS ratings, round(same / t, 6) AS agreement, round(CASE WHEN ex = 0 THEN 1 ELSE 1 - ob * t / ex END, 6) AS kappa FROM o JOIN e USING (g)""")
def weighted_kappa(t):
    """Discount and tax classes as two raters."""
    rows = t.lineitem.select("l_returnflag", F.floor(F.round(F.col("l_discount") * 100).cast("int") / 3).cast("int").alias("a"), F.floor(F.round(F.col("l_tax") * 100).cast("int") / 3).cast("int").alias("b"))
    return st.weighted_kappa(rows, "a", "b", 0, 4, ["l_returnflag"])


@query("""SELECT event_type, count(value) AS n, round(min(value), 6) AS min_value, round(quantile_cont(value, 0.5), 6) AS median_value, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95_value, round(max(value), 6) AS max_value FROM events GROUP BY event_type""")
def latency_percentiles(t):
    return st.latency(t.events, ["event_type"], "value")


@query("""WITH m AS (SELECT event_type AS part, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1), k AS (SELECT list_sort(list(part)) AS ks FROM m)
SELECT 'all' AS profile, round(sum(median), 6) AS total FROM m UNION ALL SELECT 'first_two', round(sum(median), 6) FROM m, k WHERE part IN (ks[1], ks[2]) UNION ALL SELECT 'missing', NULL""")
def composite_latency(t):
    m = t.events.groupBy(F.col("event_type").alias("part")).agg(F.percentile("value", 0.5).alias("median"))
    kinds = sorted(r["part"] for r in t.events.select(F.col("event_type").alias("part")).distinct().collect())  # a handful of routes
    return st.composite(m, {"all": kinds, "first_two": kinds[:2], "missing": [*kinds[:1], "no such route"]})


@query("""SELECT lang, count(*) AS docs, round(avg(list_sum), 6) AS mean_tokens, round(quantile_cont(list_sum, 0.5), 6) AS median_tokens, round(sum(n_chars) / sum(list_sum), 6) AS chars_per_token FROM
 (SELECT lang, n_chars, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS list_sum FROM documents) GROUP BY lang""")
def tokenizer_coverage(t):
    from siltstone.functions.text import tokens

    rows = t.documents.select("lang", "n_chars", F.size(tokens(F.col("text"))).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.percentile("n", 0.5), 6).alias("median_tokens"), F.round(F.sum("n_chars") / F.sum("n"), 6).alias("chars_per_token"))


@query("""WITH n AS (SELECT *, ntile(10) OVER (ORDER BY n_chars, doc_id) AS s FROM documents), p AS (SELECT s, doc_id, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS place FROM n),
 r AS (SELECT replicate, s, lang, row_number() OVER (PARTITION BY replicate, s ORDER BY sha256('1:' || replicate || ':' || doc_id), doc_id) AS place FROM n, range(1, 3) AS x(replicate))
SELECT CAST(replicate AS INTEGER) AS replicate, doc_id, lang FROM r JOIN p USING (s, place)""")
def length_permutation(t):
    return st.stratified_permutation(t.documents, "doc_id", "n_chars", "lang", 10, 2)


@query()
def bootstrap_ci(t):
    """Bootstrap intervals of the mean event value (no SQL: seeded resampling)."""
    return st.bootstrap(t.events, "event_type", "value")


@query("""SELECT o_custkey, array_to_string(list_sort(list(CAST(substr(o_orderpriority, 1, 1) AS INTEGER))), ',') AS ranks FROM orders GROUP BY o_custkey HAVING list_sort(list(CAST(substr(o_orderpriority, 1, 1) AS INTEGER))) <> [1, 2, 3, 4, 5]""")
def rank_permutation(t):
    """Customers whose order priorities aren't 1 to 5, each once."""
    rows = t.orders.select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("r"))
    return st.rank_permutation(rows, ["o_custkey"], "r", 5).select("o_custkey", F.array_join("ranks", ",").alias("ranks"))
