"""Text search, vector search and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import fusion, text_search, vectors
from siltstone.plans.catalog import query

_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY doc_id, token),
s AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM d),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT item_id, token, 1 + ln(count(*)) AS qw FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark) GROUP BY item_id, token),
r AS (SELECT item_id, doc_id, round(sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score
  FROM q JOIN p USING (token) JOIN df USING (token), s GROUP BY item_id, doc_id),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
"""


def _bm25(t, k=10):
    return text_search.bm25(t.documents, "doc_id", F.col("text"), t.benchmark, "item_id", F.col("text"), k)


@query(_BM25 + "SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(t):
    """BM25 of all documents for every benchmark text."""
    return _bm25(t)


@query(f"""SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT token, count(*) AS df FROM
 (SELECT unnest(list_distinct({_TOKENS.format("text")})) AS token FROM documents) GROUP BY token), (SELECT count(*) AS n FROM documents)""")
def token_df_idf(t):
    return text_search.document_frequency(t.documents, "doc_id", F.col("text")).select("token", "df", F.round("idf", 6).alias("idf"))


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%Bolt%' OR p_type ILIKE '%promo%' OR p_name ILIKE '%promo%' OR p_type ILIKE '%Bolt%' ORDER BY p_partkey LIMIT 50""")
def like_fallback(t):
    return text_search.like_search(t.part, ["Bolt", "promo"], ["p_name", "p_type"], ["p_partkey"], 50).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""SELECT n_nationkey, n_name, CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY tier, n_nationkey) AS rank FROM
 (SELECT *, CASE WHEN upper(n_name) = 'NATION_1' THEN 0 ELSE 1 END AS tier FROM nation WHERE n_name ILIKE '%nation_1%')) WHERE rank <= 10""")
def exact_symbol_first(t):
    return text_search.exact_first(t.nation, "n_name", "n_name", "nation_1", "n_nationkey", 10).select("n_nationkey", "n_name", "tier", "rank")


@query(_BM25 + ", best AS (SELECT item_id, max(score) AS m FROM bm GROUP BY item_id) SELECT item_id, doc_id, round(score / m, 6) AS score FROM bm JOIN best USING (item_id) WHERE rank <= 10")
def normalized_ranking(t):
    return text_search.normalized_scores(_bm25(t), "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


_KNN = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score, a.label AS query_label, b.label FROM v a JOIN v b ON a.id <> b.id),
knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs)
"""


def _knn(t, k=5):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.knn(v.withColumnRenamed("id", "query_id"), v, k)


def _labelled(t, df):
    lab = t.embeddings.select("vec_id", "label")
    return df.join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id").join(lab.select(F.col("vec_id").alias("id"), "label"), "id")


@query(_KNN + "SELECT query_id, id, score, rank FROM knn WHERE rank <= 5")
def cosine_topk(t):
    """The five nearest of every vector, exactly."""
    return _knn(t)


@query(_KNN + "SELECT least(query_id, id) AS u, greatest(query_id, id) AS v, max(score) AS weight FROM knn WHERE rank <= 5 AND score >= 0.1 GROUP BY 1, 2")
def knn_graph_edges(t):
    from siltstone.operators.graphs import undirected

    return undirected(_knn(t).where("score >= 0.1"), "query_id", "id", "score")


@query(_KNN + """SELECT query_label, count(*) AS neighbours, round(avg(CASE WHEN label = query_label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_5,
 round(avg(CASE WHEN rank = 1 THEN CASE WHEN label = query_label THEN 1.0 ELSE 0.0 END END), 6) AS precision_at_1 FROM knn WHERE rank <= 5 GROUP BY query_label""")
def knn_label_precision(t):
    same = F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0)
    return _labelled(t, _knn(t)).groupBy("query_label").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.avg(same), 6).alias("precision_at_5"), F.round(F.avg(F.when(F.col("rank") == 1, same)), 6).alias("precision_at_1"))


@query(_KNN + """, pooled AS (SELECT query_id, label, max(score) AS score, count(*) AS votes FROM knn WHERE rank <= 20 GROUP BY query_id, label),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS rank FROM pooled) SELECT query_id, label, score, votes, rank FROM r WHERE rank <= 3""")
def window_parent_pool(t):
    """Hits pooled to their parents (labels) by the best one."""
    hits = _labelled(t, _knn(t, 20)).select("query_id", "label", "score")
    return vectors.parent_pooled(hits, "query_id", "label", 3)


@query(_KNN + """, other AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS p FROM knn WHERE rank <= 50 AND label <> query_label),
 r AS (SELECT query_id, id, score, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM other WHERE p = 1) SELECT query_id, id, score, label, rank FROM r WHERE rank <= 3""")
def neighbour_filter(t):
    """Neighbours of other parents only, one a parent."""
    return vectors.neighbours(_labelled(t, _knn(t, 50)), 3, "label").select("query_id", "id", "score", "label", "rank")


@query("""WITH p AS (SELECT vec_id AS id, CAST(('0x' || substr(sha256('7:' || vec_id), 1, 12)) AS BIGINT) AS h FROM embeddings),
o AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS place FROM p), n AS (SELECT count(*) AS n FROM p),
a AS (SELECT p.id AS query_id, step, (h % n + step) % n AS place FROM p, n, range(0, 6) AS s(step)),
r AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY step) AS INTEGER) AS rank FROM a JOIN o USING (place) WHERE query_id <> id),
l AS (SELECT r.*, x.label AS ql, y.label AS il FROM r JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = id WHERE rank <= 5)
SELECT ql AS query_label, count(*) AS neighbours, round(avg(CASE WHEN ql = il THEN 1.0 ELSE 0.0 END), 6) AS precision_at_5 FROM l GROUP BY ql""")
def random_baseline_precision(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"))
    found = _labelled(t, vectors.random_neighbours(v.withColumnRenamed("id", "query_id"), v, 5))
    return found.groupBy("query_label").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.avg(F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0)), 6).alias("precision_at_5"))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS l FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / l)), 6) AS total, round(e[1] / l, 6) AS first_value FROM n""")
def l2_normalize(t):
    v = vectors.normalized(F.col("embedding"))
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, e: a + e), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first_value"))


@query(f"""WITH w AS (SELECT item_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark), h AS (SELECT item_id, sha256(t) AS h FROM w),
d AS (SELECT item_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 256 AS dim, sum(CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM d GROUP BY item_id)
SELECT item_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN l = 0 THEN x ELSE x / l END, 6) AS value FROM d JOIN n USING (item_id) WHERE x <> 0""")
def hashed_embeddings(t):
    """Non-zero components of the hashing embedder."""
    v = vectors.hashed_embedding(t.benchmark, "item_id", tx.tokens(F.col("text")))
    return v.select("item_id", F.posexplode("v").alias("dim", "value")).where("value <> 0").select("item_id", "dim", F.round("value", 6).alias("value"))


_LENGTH = """, len_rank AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS INTEGER) AS rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 10),
rk AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 10)
"""


def _two(t):
    a = _bm25(t).select("item_id", "doc_id", "rank")
    b = text_search.top(a.select("item_id", "doc_id").join(t.documents.select("doc_id", "n_chars"), "doc_id"), "item_id", ["n_chars", "doc_id"], 10).select("item_id", "doc_id", "rank")
    return a, b


@query(_BM25 + _LENGTH + """, f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT * FROM rk UNION ALL SELECT * FROM len_rank) GROUP BY 1, 2)
 SELECT item_id, doc_id, score, best_rank, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best_rank, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(t):
    """Reciprocal rank fusion of BM25 and of the same documents by length."""
    a, b = _two(t)
    return fusion.rrf(a.unionByName(b), "item_id", "doc_id")


@query(_BM25 + _LENGTH + """, seg AS (SELECT item_id, doc_id, rank, CASE WHEN rank <= 3 THEN 0 ELSE 2 END AS segment FROM rk UNION ALL SELECT item_id, doc_id, rank, 1 FROM len_rank WHERE rank <= 5),
 f AS (SELECT item_id, doc_id, min(segment * 1000 + rank) AS pl FROM seg GROUP BY 1, 2)
 SELECT item_id, doc_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pl, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 8""")
def append_fusion(t):
    a, b = _two(t)
    return fusion.appended(a, b.where("rank <= 5"), "item_id", "doc_id", 3, 8)


@query(_BM25 + """, sw AS (SELECT item_id, b AS budget, max(CASE WHEN contains(d.text, q.text) THEN 1 ELSE 0 END) AS found, min(CASE WHEN contains(d.text, q.text) THEN rank END) AS first_rank
 FROM bm JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id), (VALUES (1), (3), (5), (10)) AS x(b) WHERE rank <= b GROUP BY item_id, b)
 SELECT CAST(budget AS INTEGER) AS budget, count(*) AS tasks, round(avg(found), 6) AS hit_rate, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM sw GROUP BY budget""")
def budget_sweep(t):
    """Hit rate and MRR of the ranking's prefixes; a hit holds the benchmark text."""
    ranked = _bm25(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id").select("item_id", "rank", F.contains("text", "q").alias("hit"))
    rows = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, (1, 3, 5, 10))))).where("rank <= budget")
    each = rows.groupBy("item_id", "budget").agg(F.max(F.col("hit").cast("int")).alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))
    return each.groupBy("budget").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("found"), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


@query(_BM25 + """, m AS (SELECT item_id, min(CASE WHEN contains(d.text, q.text) THEN rank END) AS match_rank FROM bm JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id) WHERE rank <= 10 GROUP BY item_id)
 SELECT item_id, match_rank, coalesce(match_rank <= 1, false) AS hit_at_1, coalesce(match_rank <= 5, false) AS hit_at_5, coalesce(match_rank <= 10, false) AS hit_at_10, round(coalesce(1.0 / match_rank, 0.0), 6) AS rr FROM m""")
def hit_mrr_tasks(t):
    from siltstone.operators import statistics

    ranked = _bm25(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")
    return statistics.first_match(ranked, ["item_id"], F.contains("text", "q")).select("item_id", "match_rank", *statistics.hits())


@query(_BM25 + """, lab AS (SELECT label, count(*) AS df FROM (SELECT doc_id, unnest(['lang:' || lang, 'source:' || source]) AS label FROM documents) GROUP BY label),
 c AS (SELECT item_id, label, sum(1.0 / (10 + rank) * (ln((n + 1.0) / (df + 1.0)) + 1)) AS s, any_value(df) AS df FROM (SELECT item_id, rank, unnest(['lang:' || lang, 'source:' || source]) AS label FROM bm JOIN documents USING (doc_id) WHERE rank <= 10) JOIN lab USING (label), s GROUP BY 1, 2)
 SELECT item_id, label AS claim, round(s, 9) AS score, df, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, df, label) AS INTEGER) AS rank FROM c""")
def graph_idf_claims(t):
    """Labels of the ranked documents as claims, rare labels first."""
    claims = t.documents.select(F.col("doc_id").alias("item"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("claim"))
    df = claims.groupBy("claim").agg(F.count(F.lit(1)).alias("df"))
    return fusion.graph_idf(_bm25(t).select("item_id", F.col("doc_id").alias("item"), "rank"), claims, df, t.documents.count(), "item_id").select("item_id", "claim", "score", "df", "rank")


@query(_BM25 + """, pm AS (SELECT doc_id, (doc_id * 7 + pos) % 97 AS paper, pos FROM documents, range(0, 3) AS x(pos)),
 f AS (SELECT item_id, paper, min(rank * 10 + pos) AS pl FROM bm JOIN pm USING (doc_id) WHERE rank <= 10 GROUP BY 1, 2)
 SELECT item_id, CAST(paper AS BIGINT) AS paper, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pl, paper) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def rank_papers(t):
    """Papers (made from the document's number) in the order of their candidates."""
    mapping = t.documents.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.lit(2))).alias("pos", "_p")).select("doc_id", "pos", ((F.col("doc_id") * 7 + F.col("pos")) % 97).alias("paper"))
    return fusion.ranked_papers(_bm25(t), mapping, "item_id", "doc_id", "paper", 5)
