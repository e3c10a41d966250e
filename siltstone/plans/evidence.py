"""Evidence, packs, prompts, audits and record stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import answers, corpus, fusion
from siltstone.operators.text_search import top
from siltstone.plans.catalog import query
from siltstone.plans.search import _BM25, _bm25
from siltstone.sources import sinks

_ROUTES = """, fts AS (SELECT item_id AS query_id, 'fts' AS route, 'doc:' || doc_id AS entity_id, rank AS pos, score FROM bm WHERE rank <= 6),
 gr AS (SELECT item_id AS query_id, 'graph' AS route, 'lang:' || lang AS entity_id, min(rank) AS pos, CAST(count(*) AS DOUBLE) AS score FROM bm JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY 1, 3),
 ve AS (SELECT item_id AS query_id, 'vector' AS route, 'doc:' || doc_id AS entity_id, 7 - rank AS pos, score FROM bm WHERE rank <= 6 AND item_id % 3 = 0),
 e AS (SELECT *, CASE route WHEN 'fts' THEN 1 WHEN 'graph' THEN 3 ELSE 4 END AS route_ord FROM (SELECT * FROM fts UNION ALL SELECT * FROM gr UNION ALL SELECT * FROM ve)),
 ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY route_ord, pos, entity_id) AS INTEGER) AS ord FROM e)
"""


def _evidence(t, limit=4):
    """Text hits, their languages as graph neighbours, and for every third query the same hits as vectors."""
    hits = _bm25(t, 6).join(t.documents.select("doc_id", "lang", "text"), "doc_id")
    doc = F.concat(F.lit("doc:"), "doc_id")
    fts = hits.select(F.col("item_id").alias("query_id"), F.lit("fts").alias("route"), doc.alias("entity_id"), F.col("rank").alias("pos"), "score", doc.alias("title"), "text")
    graph = hits.groupBy("item_id", "lang").agg(F.min("rank").alias("pos"), F.count(F.lit(1)).cast("double").alias("score")).select(F.col("item_id").alias("query_id"), F.lit("graph").alias("route"), F.concat(F.lit("lang:"), "lang").alias("entity_id"), "pos", "score", F.col("lang").alias("title"), F.concat(F.lit("in language "), "lang").alias("text"))
    vector = fts.where(F.col("query_id") % 3 == 0).withColumn("route", F.lit("vector")).withColumn("pos", 7 - F.col("pos"))
    return fusion.evidence_union([fts, graph, vector], limit)


@query(_BM25 + _ROUTES + "SELECT query_id, route, entity_id, ord, ord <= 4 AS in_context FROM ev WHERE ord <= 8")
def evidence_union_dedupe(t):
    return _evidence(t).select("query_id", "route", "entity_id", "ord", "in_context")


@query(_BM25 + _ROUTES + "SELECT query_id, round(count(DISTINCT route) / 3, 3) AS coverage FROM ev WHERE ord <= 8 GROUP BY query_id")
def route_coverage(t):
    return fusion.coverage(_evidence(t), ["fts", "graph", "vector"])


@query(_BM25 + _ROUTES + """SELECT query_id, 'E' || ord AS citation, route, entity_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 77)) || '...' END AS text FROM
 (SELECT ev.*, trim(regexp_replace(CASE WHEN route = 'graph' THEN 'in language ' || substr(entity_id, 6) ELSE d.text END, '\\s+', ' ', 'g')) AS t FROM ev LEFT JOIN documents d ON entity_id = 'doc:' || d.doc_id WHERE ord <= 4)""")
def citations(t):
    return fusion.citations(_evidence(t), 4, 80).select("query_id", "citation", "route", "entity_id", "text")


@query(_BM25 + _ROUTES + """, c AS (SELECT query_id, count(*) FILTER (ord <= 4) AS n, list_sort(list(DISTINCT route) FILTER (ord <= 4)) AS routes FROM ev WHERE ord <= 8 GROUP BY query_id)
 SELECT query_id, CAST(n AS INTEGER) AS n_citations, array_to_string(routes, ',') AS routes FROM c""")
def prompt_pack(t):
    """Answer packs: the numbers of citations and their routes (prompts are compared in the tests)."""
    packs = _packs(t)
    return packs.select("query_id", "n_citations", F.array_join("routes", ",").alias("routes"))


def _packs(t):
    ev = _evidence(t)
    cited = fusion.citations(ev, 4, 200)
    paths = ev.where("route = 'graph'").select("query_id", F.concat(F.lit("P"), "ord").alias("path"), F.lit("query").alias("source_name"), F.lit("in_language").alias("relation_type"), F.col("title").alias("target_name"))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(ev.select("query_id").distinct(), "query_id", "left_semi")
    return answers.answer_packs(queries, cited, paths, fusion.coverage(ev, ["fts", "graph", "vector"]))


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS id, text, 'Conclusion. Evidence GO:' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || ' [G' || turn || '] may hold. Limitations [' || CASE WHEN turn % 4 = 0 THEN 'x' ELSE 'C' || turn END || ']' AS answer FROM conversations WHERE role = 'assistant'),
 f AS (SELECT id, CAST(floor(id / 1000) AS BIGINT) AS conv_id, id % 1000 AS turn, answer FROM a)
SELECT id, CAST(CASE WHEN turn % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_citations, round(CASE WHEN turn % 4 = 0 THEN 1.0 ELSE 0.5 END, 6) AS citation_validity, turn % 4 <> 0 AS citation_syntax,
 1.0 AS entailment, CAST(0 AS INTEGER) AS out_of_pack, true AS format_compliance, true AS calibrated, false AS overclaims, false AS abstains FROM f""")
def citation_audit(t):
    """Audits of templated answers, one an assistant turn, against a registry that knows the [G..] citation only."""
    a = t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.concat(F.lit("GO:"), F.lpad(F.col("conv_id").cast("string"), 7, "0")).alias("go"))
    text = F.concat(F.lit("Conclusion. Evidence "), "go", F.lit(" [G"), "turn", F.lit("] may hold. Limitations ["), F.when(F.col("turn") % 4 == 0, "x").otherwise(F.concat(F.lit("C"), F.col("turn").cast("string"))), F.lit("]"))
    return answers.audit(a.select("id", text.alias("answer")), a.select("id", F.concat(F.lit("G"), "turn").alias("citation"), F.col("go").alias("identifier")))


@query("""SELECT lang AS "partition", count(*) AS n FROM documents GROUP BY lang""")
def corpus_partitions(t):
    return t.documents.groupBy(F.col("lang").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT 's' || s_suppkey AS record_id, s_name AS document, CAST(s_acctbal AS DOUBLE) AS score FROM supplier WHERE s_suppkey % 2 = 0), u AS (SELECT 's' || s_suppkey AS record_id, upper(s_name) AS document, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0.0 END AS score FROM supplier WHERE s_suppkey % 4 IN (0, 1))
SELECT record_id, document, score, 'upsert' AS op FROM (SELECT * FROM s WHERE record_id NOT IN (SELECT record_id FROM u) UNION ALL SELECT * FROM u)
UNION ALL SELECT record_id, document, score, 'add' FROM (SELECT * FROM s UNION ALL SELECT * FROM u WHERE record_id NOT IN (SELECT record_id FROM s))
UNION ALL SELECT s.record_id, coalesce(u.document, s.document), coalesce(u.score, s.score), 'update' FROM s LEFT JOIN u ON s.record_id = u.record_id UNION ALL SELECT record_id, document, score, 'delete' FROM s WHERE record_id NOT IN (SELECT record_id FROM u)""")
def record_crud(t):
    """add, upsert, update and delete of one store by one batch."""
    base = t.supplier.select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("record_id"), F.col("s_name").alias("document"), F.col("s_acctbal").cast("double").alias("score"))
    store = base.where("s_suppkey % 2 = 0").drop("s_suppkey")
    rows = base.where("s_suppkey % 4 IN (0, 1)").select("record_id", F.upper("document").alias("document"), F.when(F.col("s_suppkey") % 3 == 0, None).otherwise(F.lit(0.0)).alias("score"))
    ops = {"upsert": sinks.upserted, "add": sinks.added, "update": sinks.updated, "delete": sinks.deleted}
    out = None
    for name, f in ops.items():
        part = f(store, rows).withColumn("op", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON d.source = 'src' || (i.item_id % 20) QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY d.doc_id) <= 20""")
def task_positive_refs(t):
    """Up to 20 corpus rows for each task's expected source."""
    keys = t.benchmark.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    return top(keys.join(t.documents.select("source", "doc_id"), "source"), "item_id", ["doc_id"], 20).select("item_id", "doc_id")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR contains(lower(c_name), '#0000001') THEN true ELSE false END AS matched FROM customer""")
def expected_matches(t):
    item = {"entity_id": corpus.entity_id(F.lit("customer"), F.col("c_custkey")), "symbol": F.lower("c_mktsegment"), "title": F.col("c_name")}
    expected = {"symbols": F.array(F.lit("Building")), "title_contains": F.array(F.lit("#0000001"))}
    return t.customer.select("c_custkey", corpus.matches_expected(item, expected).alias("matched"))


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def trace_windows(t):
    """Hourly summaries of traces; streaming/ingest.py has the same over a stream."""
    return t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select("event_type", F.col("w.start").alias("start"), "n", "mean_value")
