"""Graph building from knowledge-base rows, packs, selectors, communities and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import corpus, evaluation, graphs, knowledge
from siltstone.operators import statistics as st
from siltstone.plans.catalog import query
from siltstone.plans.search import _BM25, _bm25

_NODES5 = "nodes AS (SELECT DISTINCT l_suppkey AS node, p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey), member AS (SELECT s_suppkey AS node, s_nationkey % 4 AS community FROM supplier)"


@query("""WITH g AS (SELECT upper(p_brand) AS k, max_by('part:' || p_partkey, p_partkey) AS gene_id FROM part GROUP BY 1)
SELECT gene_id AS source_entity_id, 'variant' AS relation_type, 'supplier:' || s_suppkey AS target_entity_id FROM supplier JOIN g ON k = upper('brand#' || (s_suppkey % 25 + 1))""")
def symbol_edges(t):
    """Suppliers to the last part of a brand, by brand names in any case."""
    genes = t.part.select(corpus.entity_id(F.lit("part"), F.col("p_partkey")).alias("entity_id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"))
    variants = t.supplier.select(corpus.entity_id(F.lit("supplier"), F.col("s_suppkey")).alias("entity_id"), F.concat(F.lit("brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("gene"))
    return knowledge.symbol_edges(genes, variants, "variant").select("source_entity_id", "relation_type", "target_entity_id")


@query("""WITH a AS (SELECT s_suppkey AS acc, s_nationkey AS go, s_suppkey % 7 AS p1, s_suppkey % 5 + 100 AS p2 FROM supplier), w AS (SELECT acc, unnest(CASE WHEN n <= 10 THEN [0] ELSE [0, n - 10] END) AS s FROM (SELECT s_suppkey AS acc, length(s_name) AS n FROM supplier)),
 c AS (SELECT acc, go, unnest([p1, p2]) AS pmid FROM a), d AS (SELECT * FROM c WHERE pmid <> 3)
SELECT 'has_window' AS kind, count(*) AS n FROM w UNION ALL SELECT 'has_evidence', count(*) FROM a UNION ALL SELECT 'supports', count(*) FROM a UNION ALL SELECT 'annotated_with', count(*) FROM (SELECT DISTINCT acc, go FROM a)
UNION ALL SELECT 'cites', count(*) FROM d UNION ALL SELECT 'described_in', count(*) FROM (SELECT DISTINCT acc, pmid FROM d) UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT pmid, go FROM d)""")
def provenance_dag(t):
    """Relation counts of a provenance graph with suppliers as proteins, nations as terms and made-up papers (3 is unknown)."""
    proteins = t.supplier.select(F.col("s_suppkey").cast("string").alias("accession"), F.col("s_name").alias("name"), F.col("s_name").alias("sequence"))
    notes = t.supplier.select(F.col("s_suppkey").cast("string").alias("accession"), F.col("s_nationkey").cast("string").alias("go_id"), F.lit("IDA").alias("evidence_code"), F.lit(1).alias("at"), F.array((F.col("s_suppkey") % 7).cast("string"), (F.col("s_suppkey") % 5 + 100).cast("string")).alias("pmids"))
    terms = t.nation.select(F.col("n_nationkey").cast("string").alias("go_id"), F.col("n_name").alias("name"))
    papers = notes.select(F.explode("pmids").alias("pmid")).distinct().where("pmid <> '3'").withColumn("title", F.concat(F.lit("paper "), "pmid"))
    _, edges = knowledge.provenance(proteins, notes, terms, papers, 10)
    return corpus.status(edges, "relation_type")


@query(f"""WITH {_NODES5}, t AS (SELECT * FROM nodes JOIN member USING (node)), pop AS (SELECT count(DISTINCT node) AS n FROM t), size AS (SELECT community, count(DISTINCT node) AS draws FROM t GROUP BY 1 HAVING count(DISTINCT node) >= 2),
 g AS (SELECT term, count(DISTINCT node) AS successes FROM t GROUP BY 1), o AS (SELECT community, term, count(DISTINCT node) AS observed FROM t GROUP BY 1, 2 HAVING count(DISTINCT node) >= 1),
 c AS (SELECT * FROM o JOIN size USING (community) JOIN g USING (term), pop),
 x AS (SELECT community, term, any_value(observed) AS observed, least(1.0, sum(exp(lgamma(successes + 1.0) - lgamma(k + 1.0) - lgamma(successes - k + 1.0) + lgamma(n - successes + 1.0) - lgamma(draws - k + 1.0) - lgamma(n - successes - draws + k + 1.0) - lgamma(n + 1.0) + lgamma(draws + 1.0) + lgamma(n - draws + 1.0)))) AS p
  FROM c, unnest(range(greatest(observed, draws + successes - n), least(successes, draws) + 1)) AS u(k) GROUP BY 1, 2)
SELECT community, term, observed, round(p, 6) AS p FROM x""")
def community_enrichment(t):
    """Brands among the suppliers of four communities."""
    terms = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_suppkey").alias("node"), F.col("p_brand").alias("term"))
    member = t.supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 4).alias("community"))
    return evaluation.community_enrichment(member, terms, 2, 1, 1.0).select("community", "term", "observed", F.round("p", 6).alias("p"))


@query("""WITH m AS (SELECT s_suppkey AS node, s_nationkey AS community FROM supplier), p AS (SELECT DISTINCT l_suppkey AS node, l_partkey % 500 AS pmid FROM lineitem), c AS (SELECT community, pmid, count(DISTINCT node) AS n FROM m JOIN p USING (node) GROUP BY 1, 2),
 b AS (SELECT community, array_to_string(list(pmid ORDER BY r), ',') AS top_papers FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, pmid) AS r FROM c WHERE n >= 2) WHERE r <= 5 GROUP BY community)
SELECT c.community, count(*) AS papers, count(*) FILTER (n >= 2) AS shared, coalesce(any_value(top_papers), '') AS top_papers FROM c LEFT JOIN b ON b.community = c.community GROUP BY c.community""")
def literature_support(t):
    member = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    papers = t.lineitem.select(F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 500).alias("pmid"))
    return evaluation.literature_support(member, papers).select("community", "papers", "shared", F.coalesce(F.array_join("top_papers", ","), F.lit("")).alias("top_papers"))


@query("""WITH tk AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS token FROM documents), lb AS (SELECT DISTINCT doc_id, 'lang:' || lang AS label FROM documents WHERE lang IS NOT NULL),
 n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), t AS (SELECT token, count(*) AS dt FROM tk, n GROUP BY token HAVING count(*) >= 20 AND count(*) <= 0.5 * any_value(n)), g AS (SELECT label, count(*) AS dl FROM lb GROUP BY label HAVING count(*) >= 10),
 b AS (SELECT token, label, count(*) AS o, any_value(dt) AS dt, any_value(dl) AS dl FROM tk JOIN t USING (token) JOIN lb USING (doc_id) JOIN g USING (label) GROUP BY 1, 2)
,
 x AS (SELECT token, label, any_value(o) AS o, any_value(dt) AS dt, any_value(dl) AS dl, any_value(n) AS n, least(1.0, sum(exp(lgamma(dl + 1.0) - lgamma(k + 1.0) - lgamma(dl - k + 1.0) + lgamma(n - dl + 1.0) - lgamma(dt - k + 1.0) - lgamma(n - dl - dt + k + 1.0) - lgamma(n + 1.0) + lgamma(dt + 1.0) + lgamma(n - dt + 1.0)))) AS p
  FROM b, n, unnest(range(greatest(o, dt + dl - n), least(dt, dl) + 1)) AS u(k) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (ORDER BY p, token, label) AS r FROM x), k AS (SELECT (SELECT count(*) FROM t) * (SELECT count(*) FROM g) AS tests),
 q AS (SELECT *, least(1.0, min(p * tests / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r, k)
SELECT token, label, o AS observed, round((o + 0.5) * (n - dt - dl + o + 0.5) / ((dt - o + 0.5) * (dl - o + 0.5)), 6) AS odds_ratio, round(p, 6) AS p, round(q, 6) AS q FROM q WHERE o >= 5""")
def token_associations(t):
    """Tokens against languages."""
    from siltstone.functions.text import tokens

    tk = t.documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    lb = t.documents.where("lang is not null").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("label"))
    return evaluation.token_associations(tk, lb, 20, 10, 0.5, 5).select("token", "label", "observed", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "p", "q")])


@query()
def token_permutation_null(t):
    """Significant token and language pairs against languages dealt anew among texts of similar length (no SQL: replicates)."""
    from siltstone.functions.text import tokens

    tk = t.documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    lb = t.documents.where("lang is not null").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("label"))
    return evaluation.permutation_null(tk, lb, t.documents.select("doc_id", F.col("n_chars").alias("length")), 20, 10, 0.5, 5, replicates=4)


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1),
 p AS (SELECT source, lang, n, round(n / size, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) JOIN s USING (source) WHERE r = 1)
SELECT count(*) AS communities, round(avg(purity), 6) AS mean_purity, min(purity) AS least_purity, max(purity) AS most_purity, arg_max(lang, purity * 1000000 + n) AS top_label FROM p""")
def purity_summary(t):
    p = st.purity(t.documents.select("source", "lang"), "source", "lang").withColumnRenamed("lang", "label")
    return evaluation.purity_summary(p)


@query(_BM25 + """, c AS (SELECT item_id, 'source:' || source AS claim, rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 10), b AS (SELECT item_id, claim, min(rank) AS r FROM c GROUP BY 1, 2),
 f AS (SELECT item_id, claim, row_number() OVER (PARTITION BY item_id ORDER BY r, claim) AS rank FROM b), e AS (SELECT item_id, 'source:src' || (item_id % 20) AS claim FROM benchmark)
SELECT item_id, claim, CAST(f.rank AS INTEGER) AS rank, 'rank_first' AS selector FROM f WHERE f.rank <= 3 UNION ALL SELECT item_id, claim, 1, 'oracle' FROM b JOIN e USING (item_id, claim)""")
def claim_selectors(t):
    """Sources of the ranked documents as claims: rank-first and perfect selection."""
    c = _bm25(t).join(t.documents.select("doc_id", F.concat(F.lit("source:"), "source").alias("claim")), "doc_id").select("item_id", "claim", "rank")
    e = t.benchmark.select("item_id", F.concat(F.lit("source:src"), (F.col("item_id") % 20).cast("string")).alias("claim"))
    first = evaluation.selected_claims(c, "item_id", 3).withColumn("selector", F.lit("rank_first"))
    return first.unionByName(evaluation.oracle_claims(c, e, "item_id", 3).withColumn("selector", F.lit("oracle")))


@query(_BM25 + """, h AS (SELECT item_id, rank, contains(d.text, q.text) AS hit FROM bm JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id) WHERE rank <= 10),
 g AS (SELECT item_id, k, CAST(max(CASE WHEN rank <= k AND hit THEN 1 ELSE 0 END) AS DOUBLE) AS found, CAST(-k AS DOUBLE) AS thrift FROM h, (VALUES (1), (2), (5), (10)) AS x(k) GROUP BY item_id, k),
 m AS (SELECT k, round(avg(found), 9) AS found, round(avg(thrift), 9) AS thrift FROM g WHERE item_id % 2 = 0 GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, found, thrift FROM m ORDER BY found DESC, thrift DESC, k LIMIT 1""")
def grid_selection(t):
    """The best prefix on the dev half: the highest hit rate, then the shortest."""
    h = _bm25(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id").select("item_id", "rank", F.contains("text", "q").alias("hit"))
    g = h.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 5, 10))))).groupBy("item_id", "k").agg(F.max(F.when((F.col("rank") <= F.col("k")) & F.col("hit"), 1.0).otherwise(0.0)).alias("found")).withColumn("thrift", -F.col("k").cast("double"))
    return evaluation.tuned(g.withColumn("split", F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test")), ["k"], ["found", "thrift"])


@query("""WITH r AS (SELECT o_orderstatus AS status, o_orderpriority AS route, o_totalprice AS price FROM orders), n AS (SELECT route, status, count(*) AS n FROM r GROUP BY 1, 2)
SELECT r.route, round(avg(price), 6) AS price, any_value(s) AS statuses FROM r JOIN (SELECT route, string_agg(status || '=' || n, ',' ORDER BY status) AS s FROM n GROUP BY route) x ON x.route = r.route GROUP BY r.route""")
def status_report(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("route"), F.col("o_totalprice").alias("price"))
    text = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return evaluation.status_report(rows, ["route"], ["price"]).select("route", "price", text.alias("statuses"))


@query(_BM25 + """, e AS (SELECT item_id, doc_id, rank, 'lang:' || lang AS go, CAST(doc_id % 13 AS VARCHAR) AS pmid FROM bm JOIN documents USING (doc_id) WHERE rank <= 5), w AS (SELECT item_id, CAST(item_id % 13 AS VARCHAR) AS paper FROM benchmark),
 kept AS (SELECT DISTINCT item_id, pmid FROM e WHERE rank <= 3)
SELECT e.item_id AS query_id, CAST(count(DISTINCT doc_id) AS INTEGER) AS candidates, round(CASE WHEN bool_or(go = 'lang:en') THEN 1.0 ELSE 0.0 END, 6) AS go_recall,
 round(CASE WHEN bool_or(rank <= 3 AND pmid = paper) THEN 1.0 ELSE 0.0 END, 6) AS citation_recall, round(CASE WHEN bool_or(rank <= 3 AND pmid = paper) THEN 1.0 ELSE 0.0 END / count(DISTINCT CASE WHEN rank <= 3 THEN pmid END), 6) AS citation_precision,
 bool_or(go = 'lang:en' AND pmid = paper AND EXISTS (SELECT 1 FROM kept k WHERE k.item_id = e.item_id AND k.pmid = e.pmid)) AS strict_path FROM e JOIN w USING (item_id) GROUP BY e.item_id""")
def pack_scores(t):
    """Packs of five documents with their language as term and a made-up paper; English and one paper are expected."""
    ranked = _bm25(t, 5)
    labels = t.documents.select(F.col("doc_id").cast("string").alias("item"), F.concat(F.lit("lang:"), "lang").alias("go_id"), (F.col("doc_id") % 13).cast("string").alias("pmid"))
    c = ranked.select(F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("item"), "rank")
    papers = c.where("rank <= 3").join(labels, "item").select("query_id", "pmid").distinct()
    expected = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.struct(F.lit("go").alias("kind"), F.lit("lang:en").alias("value")), F.struct(F.lit("paper").alias("kind"), (F.col("item_id") % 13).cast("string").alias("value")))).alias("e")).select("query_id", "e.kind", "e.value")
    return evaluation.pack_scores(c, papers, labels, expected).select("query_id", "candidates", "go_recall", "citation_recall", "citation_precision", "strict_path")


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS method, o_custkey AS query_id FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT query_id, CASE WHEN max(method) = 'F' THEN 'O' ELSE 'F' END AS missing FROM s GROUP BY query_id HAVING count(*) = 1""")
def query_set_check(t):
    m = t.orders.where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderstatus").alias("method"), F.col("o_custkey").alias("query_id")).distinct()
    return evaluation.same_queries(m).select("query_id", F.array_join("missing", ",").alias("missing"))


def _hourly(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("query_id"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("v"))


@query()
def paired_bootstrap(t):
    """Intervals of the differences of any two event types' hourly means (no SQL: seeded resampling)."""
    h = _hourly(t)
    both = h.join(h.select("query_id", F.col("kind").alias("other"), F.col("v").alias("w")), "query_id").where("kind < other")
    return st.bootstrap(both.select(F.concat_ws("-", "kind", "other").alias("pair"), (F.col("v") - F.col("w")).alias("delta")), "pair", "delta")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS query_id, event_type AS kind, max(value) AS v FROM events GROUP BY 1, 2) SELECT query_id, round(max(v) - min(v), 6) AS delta FROM h GROUP BY 1""")
def paired_deltas(t):
    """The hourly differences of two result sets over the same hours: the largest and the smallest of the kinds' maxima."""
    h = t.events.groupBy(F.date_trunc("hour", "ts").alias("query_id"), "event_type").agg(F.max("value").alias("v")).groupBy("query_id").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return evaluation.paired(h.select("query_id", F.col("b").alias("v")), h.select("query_id", F.col("a").alias("v")), "v").select("query_id", F.round("delta", 6).alias("delta"))


@query("""WITH s AS (SELECT item_id, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{L}*]', '', 'g') AS s FROM benchmark) SELECT item_id, CAST(CASE WHEN length(s) <= 512 THEN least(8, len(list_distinct(list_prepend(s, CASE WHEN length(s) <= 128 THEN [s] ELSE list_concat(list_transform(range(0, CAST(ceil((length(s) - 128) / 64.0) AS BIGINT)), lambda i: substr(s, i * 64 + 1, 128)), [right(s, 128)]) END)))) ELSE 0 END AS INTEGER) AS texts, 'protein_window' AS target FROM s""")
def query_windows(t):
    """Texts that a sequence query asks with, and their target."""
    kind = F.lit("protein")
    return t.benchmark.select("item_id", F.size(knowledge.query_texts(F.col("text"), kind)).alias("texts"), knowledge.vector_target(kind, ["text", "protein_window"]).alias("target"))


@query("""SELECT n_nationkey AS record_id, CAST(min(a) AS INTEGER) AS attempt FROM nation, range(0, 4) AS x(a) WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE contains(c.c_name, substr(n_name || '_' || n_regionkey || 'zz', CAST(a AS BIGINT) * 2 + 1, 4))) AND length(substr(n_name || '_' || n_regionkey || 'zz', CAST(a AS BIGINT) * 2 + 1, 4)) > 0 GROUP BY 1""")
def non_leaking_queries(t):
    f = t.nation.select(F.col("n_nationkey").alias("record_id"), F.concat("n_name", F.lit("_"), F.col("n_regionkey").cast("string"), F.lit("zz")).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    f = f.select("record_id", "attempt", F.substr("s", F.col("attempt") * 2 + 1, F.lit(4)).alias("query")).where("length(query) > 0")
    return evaluation.non_leaking(f, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))).select("record_id", "attempt")


@query("""SELECT 'part:' || p_partkey AS record_id, length(regexp_replace(upper(p_name), '[^\\p{L}*]', '', 'g')) AS length FROM part WHERE length(regexp_replace(upper(p_name), '[^\\p{L}*]', '', 'g')) > 0""")
def sequence_records(t):
    return corpus.sequence_records(t.part, "p_partkey", F.col("p_name"), "part").select("record_id", F.col("length").cast("long").alias("length"))


@query("""SELECT query_id, route, hits, CASE WHEN hits > 0 THEN 'ok' ELSE 'no_hits' END AS status FROM (SELECT user_id AS query_id, route, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = route) AS hits FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click', 'view', 'none']) AS route))""")
def route_traces(t):
    return knowledge.traces(t.events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("route")), ["click", "view", "none"])


@query()
def view_graph_communities(t):
    """Communities by label propagation of the vectors' neighbour graph (no SQL: rounds of votes)."""
    from siltstone.plans.search import _knn

    pairs = graphs.undirected(_knn(t).where("score >= 0.1"), "query_id", "id", "score")
    return graphs.label_propagation(pairs)


@query("""WITH m AS (SELECT c_custkey, upper(c_mktsegment) AS s FROM customer) SELECT c_custkey, list_contains(['BUILDING', 'MACHINERY'], s) AS matched FROM m""")
def biological_matches(t):
    cand = F.create_map(F.lit("gene_symbols"), F.array("c_mktsegment"))
    want = F.create_map(F.lit("protein_gene_names"), F.array(F.lit("building"), F.lit("machinery")))
    return t.customer.select("c_custkey", knowledge.biological_match(cand, want).alias("matched"))
