"""Evaluation reports, splits and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.functions import text as tx
from siltstone.operators import evaluation, splits
from siltstone.operators import statistics as st
from siltstone.operators.text_search import top
from siltstone.plans.answering import _PACK, candidates, expected
from siltstone.plans.catalog import query
from siltstone.plans.evidence import _evidence, _packs, _ROUTES
from siltstone.plans.search import _BM25, _bm25

def _ranked(t):
    sold = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("q"))
    return top(sold, "query_id", [F.desc("q"), "item"], 50).select("query_id", "item", "rank")


_TOP50 = """WITH tot AS (SELECT l_suppkey AS query_id, l_partkey AS item, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
rk AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, item) AS rank FROM tot QUALIFY rank <= 50),
want AS (SELECT DISTINCT s_suppkey AS query_id, unnest([s_suppkey * 3, s_suppkey % 50, s_suppkey, s_suppkey * 7 + 1]) AS item FROM supplier)"""


def _want(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("query_id"), F.explode(F.array(k * 3, k % 50, k, k * 7 + 1)).alias("item")).distinct()


@query(_TOP50 + """, j AS (SELECT w.query_id, rank FROM want w LEFT JOIN rk ON rk.query_id = w.query_id AND rk.item = w.item),
 i AS (SELECT query_id, coalesce(max(CAST(rank <= 10 AS INTEGER)), 0) = 1 AS hit_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, coalesce(max(CAST(rank <= 50 AS INTEGER)), 0) = 1 AS hit_at_50, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_50, round(coalesce(1.0 / min(rank), 0.0), 6) AS rr FROM j GROUP BY 1),
 p AS (SELECT query_id, bool_or(f) AS paper_hit, round(avg(CAST(f AS INTEGER)), 6) AS paper_recall FROM (SELECT query_id, item, item % 3 = 0 AS f FROM want) GROUP BY 1)
SELECT i.*, paper_hit, paper_recall, hit_at_10 AND paper_hit AS path_complete FROM i JOIN p USING (query_id)""")
def ranking_reports(t):
    """Hits, recalls, papers and complete paths of the suppliers' rankings."""
    papers = _want(t).select("query_id", F.col("item").cast("string").alias("pmid"), (F.col("item") % 3 == 0).alias("found"))
    return evaluation.ranking_report(_ranked(t), _want(t), papers, (10, 50))


@query(_TOP50 + """, b AS (SELECT w.query_id, budget, max(CASE WHEN rank <= budget THEN 1 ELSE 0 END) AS hit, s_nationkey % 3 AS cat, s_suppkey % 2 AS qt FROM want w JOIN supplier ON s_suppkey = w.query_id LEFT JOIN rk ON rk.query_id = w.query_id AND rk.item = w.item, (VALUES (10), (20), (50)) AS x(budget) GROUP BY ALL),
 n AS (SELECT budget, 'c' || cat AS category, 'q' || qt AS query_type, hit FROM b)
SELECT CAST(budget AS INTEGER) AS budget, category, query_type, count(*) AS tasks, round(avg(hit), 6) AS hit FROM n GROUP BY GROUPING SETS ((budget), (category, budget), (query_type, budget))""")
def budget_reports(t):
    """Hit rates by budget, and with category and query type."""
    kinds = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("c"), F.col("s_nationkey") % 3).alias("category"), F.concat(F.lit("q"), F.col("s_suppkey") % 2).alias("query_type"))
    j = _want(t).join(_ranked(t), ["query_id", "item"], "left").withColumn("budget", F.explode(F.array(*map(F.lit, (10, 20, 50)))))
    rows = j.groupBy("query_id", "budget").agg(F.max(F.when(F.col("rank") <= F.col("budget"), 1).otherwise(0)).alias("hit")).join(kinds, "query_id")
    return evaluation.budget_reports(rows, ["hit"]).select("budget", "category", "query_type", "tasks", "hit")


@query("""WITH r AS (SELECT o_orderpriority AS category, o_orderstatus AS graph_status, o_totalprice > 100000 AS bio, o_custkey % 3 = 0 AS seed, o_custkey % 2 = 0 AS expd, o_custkey % 10 AS seeds, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 END AS added, o_totalprice / 1000 AS ms FROM orders),
 n AS (SELECT category, string_agg(graph_status || '=' || n, ',' ORDER BY graph_status) AS statuses FROM (SELECT category, graph_status, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT r.category, count(*) AS tasks, round(coalesce(avg(CAST(seed AS INTEGER)) FILTER (bio), 0), 4) AS seed_recall, round(coalesce(avg(CAST(expd AS INTEGER)) FILTER (bio), 0), 4) AS expanded_recall, round(avg(seeds), 4) AS mean_seeds, round(avg(coalesce(added, 0)), 4) AS mean_added, 1.0::DOUBLE AS mean_neighbours, 2.0::DOUBLE AS mean_nodes_found, round(avg(ms), 3) AS mean_ms, any_value(statuses) AS statuses FROM r JOIN n ON n.category = r.category GROUP BY r.category""")
def graph_rerank_summary(t):
    """Seed and expanded recall, mean counts and statuses by category."""
    k = F.col("o_custkey")
    rows = t.orders.select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("graph_status"), (F.col("o_totalprice") > 100000).alias("bio_evaluable"), (k % 3 == 0).alias("seed_hit"), (k % 2 == 0).alias("expanded_hit"), (k % 10).alias("seeds"), F.when(k % 7 != 0, k % 5).alias("added"), F.lit(1).alias("neighbours"), F.lit(2).alias("nodes_found"), (F.col("o_totalprice") / 1000).alias("ms"))
    text = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return evaluation.graph_rerank_summary(rows, ["category"]).withColumn("statuses", text)


@query(_TOP50 + """, m AS (SELECT 'sales' AS method, query_id, item, rank FROM rk WHERE rank <= 10 UNION ALL SELECT 'oracle', query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY item) FROM want),
 mp AS (SELECT p_partkey AS item, unnest([p_partkey % 97, p_partkey * 5 % 97]) AS paper, unnest([0, 1]) AS pos FROM part), ep AS (SELECT s_suppkey AS query_id, unnest([s_suppkey % 97, s_suppkey * 3 % 97, 96]) AS paper FROM supplier),
 rp AS (SELECT method, query_id, paper, row_number() OVER (PARTITION BY method, query_id ORDER BY o, paper) AS n FROM (SELECT method, query_id, paper, min(rank * 10 + pos) AS o FROM m JOIN mp USING (item) GROUP BY ALL) QUALIFY n <= 8),
 a AS (SELECT method, query_id, count(DISTINCT w.item) AS hits FROM m JOIN want w USING (query_id, item) GROUP BY ALL), b AS (SELECT method, query_id, count(DISTINCT ep.paper) AS reads FROM rp JOIN ep USING (query_id, paper) GROUP BY ALL), n AS (SELECT query_id, count(DISTINCT paper) AS np FROM ep GROUP BY 1)
SELECT query_id, method, coalesce(hits, 0) > 0 AS accession_hit, coalesce(reads, 0) > 0 AS paper_hit, round(coalesce(reads, 0) / np, 6) AS paper_recall, coalesce(hits, 0) > 0 AND coalesce(reads, 0) > 0 AS path_complete
FROM (SELECT * FROM n, (VALUES ('sales'), ('oracle')) AS x(method)) LEFT JOIN a USING (method, query_id) LEFT JOIN b USING (method, query_id)""")
def paper_path_report(t):
    """Sequence-to-paper retrieval of the suppliers' rankings and of the oracle."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    mapping = t.part.select(k.alias("item"), F.posexplode(F.array(k % 97, k * 5 % 97)).alias("pos", "paper"))
    want = _want(t).groupBy("query_id").agg(F.collect_set("item").alias("items"))
    e = want.join(t.supplier.select(s.alias("query_id"), F.array(s % 97, s * 3 % 97, F.lit(96).cast("long")).alias("papers")), "query_id")
    return evaluation.paper_paths(_ranked(t).withColumn("method", F.lit("sales")), mapping, e, 10, 8)


_GRIDS = """, cl AS (SELECT query_id, rank, unnest(go_ids) AS claim FROM pk), dfc AS (SELECT claim, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(['GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0'), 'GO:' || lpad(CAST(1000 + p_partkey % 37 AS VARCHAR), 7, '0')]) AS claim FROM part) GROUP BY 1), np AS (SELECT count(*) AS n FROM part),
 want AS (SELECT DISTINCT query_id, unnest(go_ids) AS claim FROM ex), g AS (SELECT query_id, claim, rank, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf, df, candidate_k, rank_offset, idf_power FROM cl JOIN dfc USING (claim), np, (VALUES (5), (10), (20), (50)) AS a(candidate_k), (VALUES (0.0), (1.0), (5.0), (10.0), (20.0), (60.0)) AS b(rank_offset), (VALUES (0.0), (0.5), (1.0), (1.5), (2.0)) AS c(idf_power) WHERE rank <= candidate_k),
 sg AS (SELECT query_id, candidate_k, rank_offset, idf_power, claim, round(sum(power(idf, CAST(idf_power AS DOUBLE)) / (rank_offset + rank)), 9) AS score, any_value(df) AS df FROM g GROUP BY ALL),
 rg AS (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_k, rank_offset, idf_power ORDER BY score DESC, df, claim) AS rn FROM sg QUALIFY rn <= 5),
 og AS (SELECT r.query_id, candidate_k, rank_offset, idf_power, output_k, count(*) AS given, count(w.claim) AS hits FROM rg r LEFT JOIN want w ON w.query_id = r.query_id AND w.claim = r.claim, (VALUES (1), (3), (5)) AS o(output_k) WHERE rn <= output_k GROUP BY ALL),
 sz AS (SELECT query_id, count(*) AS nw FROM want GROUP BY 1), me AS (SELECT og.*, hits / given AS p, hits / nw AS r FROM og JOIN sz USING (query_id)), mf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM me)"""


def _grid(t):
    claims = t.part.select(F.concat(F.lit("ACC"), "p_partkey").alias("item"), F.explode(F.array(F.concat(F.lit("GO:"), F.lpad(F.col("p_size").cast("string"), 7, "0")), F.concat(F.lit("GO:"), F.lpad((1000 + F.col("p_partkey") % 37).cast("string"), 7, "0")))).alias("claim"))
    df = claims.groupBy("claim").agg(F.count_distinct("item").alias("df"))
    want = expected(t).select("query_id", F.explode("go_ids").alias("claim"))
    return evaluation.selector_scores(candidates(t).select("query_id", F.col("accession").alias("item"), "rank"), claims, df, t.part.count(), want, "function")


@query(_PACK + _GRIDS + "SELECT CAST(candidate_k AS INTEGER) AS candidate_k, CAST(rank_offset AS DOUBLE) AS rank_offset, CAST(idf_power AS DOUBLE) AS idf_power, CAST(output_k AS INTEGER) AS output_k, count(*) AS queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM mf GROUP BY 1, 2, 3, 4")
def selector_grid(t):
    """Mean scores of all 360 configurations of the claim selector."""
    means = [F.round(F.avg(m), 6).alias(m) for m in ("precision", "recall", "f1")]
    return _grid(t).groupBy(*evaluation.GRID, "output_k").agg(F.count(F.lit(1)).alias("queries"), *means)


@query(_PACK + _GRIDS + """, dv AS (SELECT s_suppkey AS query_id FROM supplier WHERE s_suppkey % 2 = 0), nd AS (SELECT count(*) AS nd FROM dv)
SELECT CAST(candidate_k AS INTEGER) AS candidate_k, CAST(rank_offset AS DOUBLE) AS rank_offset, CAST(idf_power AS DOUBLE) AS idf_power, CAST(output_k AS INTEGER) AS output_k, round(sum(f) / any_value(nd), 6) AS f1 FROM mf JOIN dv USING (query_id), nd GROUP BY 1, 2, 3, 4
ORDER BY round(sum(f) / any_value(nd), 9) DESC, round(sum(r) / any_value(nd), 9) DESC, round(sum(p) / any_value(nd), 9) DESC, output_k, candidate_k, rank_offset, idf_power LIMIT 1""")
def tuned_selector(t):
    """The configuration that is best on the dev half of the suppliers."""
    dev = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("query_id"))
    return evaluation.tuned_selector(_grid(t), dev).select(*evaluation.GRID, "output_k", F.round("f1", 6).alias("f1"))


@query("""SELECT p_size AS replicate, count(*) AS replicates, round(avg(p_retailprice), 6) AS price, 'null' AS condition FROM part GROUP BY 1 UNION ALL SELECT 0, count(*), round(avg(p_retailprice), 6), 'observed' FROM part""")
def replicate_comparison(t):
    """Means of replicates beside the observed one."""
    null = evaluation.replicate_means(t.part.select(F.col("p_size").alias("replicate"), F.col("p_retailprice").alias("price")), "replicate", ["price"])
    seen = evaluation.replicate_means(t.part.select(F.lit(0).alias("replicate"), F.col("p_retailprice").alias("price")), "replicate", ["price"])
    return evaluation.comparison({"null": null, "observed": seen})


@query("""WITH e AS (SELECT o_custkey, count(*) AS edges, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS depth FROM orders GROUP BY 1) SELECT count(*) AS traces, round(avg(edges), 6) AS mean_edges, CAST(sum(edges) AS BIGINT) AS edges, max(depth) AS depth FROM e""")
def trace_summaries(t):
    return evaluation.trace_summary(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("edges"), F.max(F.substring("o_orderpriority", 1, 1).cast("int")).alias("depth")))


@query("""SELECT count(*) AS "rows", count(*) FILTER (p_size > 10) AS big, count(*) FILTER (contains(p_type, 'PROMO')) AS promo FROM part""")
def label_coverage(t):
    some = lambda c: F.when(c, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return evaluation.coverage(t.part.select(some(F.col("p_size") > 10).alias("big"), some(F.contains("p_type", F.lit("PROMO"))).alias("promo")), ["big", "promo"])


@query("""WITH e AS (SELECT event_type AS relation_type, count(*) AS n FROM events GROUP BY 1) SELECT relation_type, n FROM e""")
def relation_counts(t):
    from siltstone.operators.knowledge import relation_counts as counts

    return counts(t.events.select(F.col("event_type").alias("relation_type")))


_HASHCL = "WITH m AS (SELECT s_suppkey AS node, s_suppkey % 30 AS cluster, s_nationkey AS label FROM supplier), r AS (SELECT DISTINCT cluster, label, sha256('c:' || cluster) AS h FROM m),"


@query(_HASHCL + """ f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, cluster) AS n, count(*) OVER (PARTITION BY label) AS c FROM r), g AS (SELECT cluster, any_value(h) AS h FROM f GROUP BY 1 HAVING max(n) = 1 AND min(c) > 1)
SELECT cluster FROM g ORDER BY h, cluster LIMIT 10""")
def cluster_holdout(t):
    """Whole clusters held out so that every nation stays reachable."""
    m = t.supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 30).alias("cluster"))
    return splits.cluster_held_out(m, t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label")), 10, "c")


@query("""SELECT c_custkey, c_nationkey FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('p:' || c_custkey), c_custkey) <= 3""")
def copy_holdout(t):
    """Three copies of each group held out, where one at least stays."""
    return splits.copies_held_out(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 5, 3, "p")


@query("""WITH k AS (SELECT p_partkey FROM part WHERE p_size = 7), n AS (SELECT count(*) AS n FROM k), r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('b:' || p_partkey), p_partkey) AS o FROM part WHERE p_size <> 7)
SELECT p_partkey FROM k UNION ALL SELECT p_partkey FROM r, n WHERE o <= 150 - n""")
def controlled_rows(t):
    """All positives and others in hash order, 150 rows in all."""
    return splits.controlled_subset(t.part.select("p_partkey"), t.part.where("p_size = 7").select("p_partkey"), "p_partkey", 150, "b").select("p_partkey")


@query("""WITH s AS (SELECT n_nationkey AS id, n_regionkey AS grp, CAST(floor(length(s) * 0.0 + 10 * gc / length(s)) AS INTEGER) AS bin, s FROM (SELECT *, length(regexp_replace(s, '[^GC]', '', 'g')) AS gc FROM (SELECT *, repeat(translate(upper(n_name || r_name), 'NATIO_0123456789REG', 'ACGTACGTACGTACGTACG'), 2) AS s FROM nation JOIN region ON n_regionkey = r_regionkey))),
 k AS (SELECT DISTINCT id, grp, bin, substr(s, i, 5) AS g FROM s, range(1, CAST(length(s) - 3 AS BIGINT)) AS r(i)), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
 p AS (SELECT a.id, b.id AS negative, count(*) AS c FROM k a JOIN k b USING (bin, g) WHERE a.grp <> b.grp GROUP BY 1, 2)
SELECT p.id, negative, round(c / (a.n + b.n - c), 6) AS jaccard FROM p JOIN n a ON a.id = p.id JOIN n b ON b.id = negative QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(c / (a.n + b.n - c), 6) DESC, negative) <= 2""")
def hard_negatives(t):
    """Nations of other regions in the same GC bin that share most 5-mers."""
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.repeat(F.translate(F.upper(F.concat("n_name", "r_name")), "NATIO_0123456789REG", "ACGTACGTACGTACGTACG"), 2)
    rows = joined.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"), s.alias("s"))
    rows = rows.withColumn("bin", splits.gc_bin(F.col("s"), 10))
    return splits.hard_negatives(rows, "id", "grp", "bin", seq.kmers(F.col("s"), 5), 2)


@query("""WITH s AS (SELECT item_id, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{L}]', '', 'g') AS s FROM benchmark), q AS (SELECT item_id, substr(s, CAST(greatest((length(s) - 60) // 2, 0) AS BIGINT) + 1, 60) AS q FROM s),
 c AS (SELECT item_id, q, i, CAST(('0x' || substr(sha1(item_id || ':' || i), 1, 7)) AS BIGINT) AS d FROM q, range(1, 61) AS r(i) WHERE i <= length(q))
SELECT item_id, any_value(q) AS query, string_agg(CASE WHEN d % 1000 < 50 THEN substr('ACDEFGHIKLMNPQRSTVWY', (d // 1000) % 20 + 1, 1) ELSE substr(q, i, 1) END, '' ORDER BY i) AS mutated FROM c GROUP BY 1""")
def mutated_fragments(t):
    """Middle fragments with some residues replaced where a hash says so."""
    s = seq.middle(seq.clean(F.col("text"), stop=False), 60)
    return t.benchmark.select("item_id", s.alias("query"), seq.mutated(s, F.col("item_id").cast("string"), "ACDEFGHIKLMNPQRSTVWY").alias("mutated"))


@query("""WITH x AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^\\p{L}]', '', 'g') AS s, regexp_replace(upper(p_name), '[^ACGTN]', '', 'g') AS d FROM part)
SELECT p_partkey, rtrim(regexp_replace(regexp_replace(s, '[UZOB]', 'X', 'g'), '(.)', '\\1 ', 'g')) AS spaced, d AS dna FROM x""")
def encoder_inputs(t):
    return t.part.select("p_partkey", seq.encoder_input(F.col("p_name"), "spaced").alias("spaced"), seq.encoder_input(F.col("p_name"), "dna").alias("dna"))


@query("""WITH s AS (SELECT n_nationkey, regexp_replace(upper(n_name), '[^ACGTN]', 'N', 'g') AS s FROM nation), k AS (SELECT n_nationkey, i, substr(s, i, 3) AS m FROM s, range(1, 100) AS r(i) WHERE i <= length(s) - 2)
SELECT n_nationkey, string_agg(CAST((strpos('ACGTN', m[1]) - 1) * 25 + (strpos('ACGTN', m[2]) - 1) * 5 + strpos('ACGTN', m[3]) - 1 + 5 AS VARCHAR), ',' ORDER BY i) AS ids FROM k GROUP BY 1""")
def kmer_ids(t):
    ids = seq.base5_ids(F.col("n_name"))
    return t.nation.select("n_nationkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT s_suppkey, 'ACC' || s_suppkey AS accession, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g')) AS safe, CASE s_suppkey % 4 WHEN 0 THEN 'IGHV' WHEN 1 THEN 'TRBV' END AS family, 'k|' || s_suppkey AS evidence_key FROM supplier""")
def name_forms(t):
    """Accessions without versions, safe names, gene families and evidence keys."""
    k = F.col("s_suppkey").cast("string")
    symbol = F.array(F.lit("ighv3-23"), F.lit("TRBV20-1"), F.lit("BRCA1"), F.lit("CD8A"))[(F.col("s_suppkey") % 4).cast("int")]
    return t.supplier.select("s_suppkey", tx.normalized_accession(F.concat(F.lit("sp|ACC"), k, F.lit(".2|NAME"))).alias("accession"), tx.safe_name(F.col("s_name")).alias("safe"), tx.gene_family(symbol).alias("family"), tx.joined_key(F.lit("k"), k).alias("evidence_key"))


@query("""SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS number, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS listed FROM part""")
def coercions(t):
    """Metadata flattened and back, and values read as numbers, texts and lists."""
    even = F.col("p_size") % 2 == 0
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(even, F.col("p_size").cast("string")))
    back = tx.unflattened(tx.flattened(m))
    number = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    kind = F.when(even, F.col("p_type")).otherwise("")
    return t.part.select("p_partkey", back["brand"].alias("brand"), back["size"].alias("size"), tx.optional_float(number).alias("number"), tx.optional_text(kind).alias("kind"), F.size(tx.as_list(kind)).alias("listed"))


@query("""WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 0.07 AS z FROM embeddings a JOIN embeddings b ON a.label = b.label AND floor(a.vec_id / 50) = floor(b.vec_id / 50)),
 m AS (SELECT x, max(z) AS m FROM p GROUP BY 1), l AS (SELECT p.x, any_value(m) + ln(sum(exp(z - m))) - sum(CASE WHEN p.x = y THEN z END) AS loss FROM p JOIN m ON m.x = p.x GROUP BY p.x) SELECT round(avg(loss), 5) AS loss FROM l""")
def info_nce_loss(t):
    """InfoNCE of vectors against those of their label in the same fifty."""
    e = t.embeddings.select(F.col("vec_id").alias("anchor"), F.col("embedding").cast("array<double>").alias("a"), "label", F.floor(F.col("vec_id") / 50).alias("lot"))
    pairs = e.join(e.select(F.col("anchor").alias("other"), F.col("a").alias("b"), "label", "lot"), ["label", "lot"])
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return evaluation.info_nce(pairs.select("anchor", "other", dot.alias("similarity"))).select(F.round("loss", 5).alias("loss"))


@query(_PACK + """, x AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 5 = 0 THEN [] ELSE ['ACC' || (s_suppkey * 3), 'ACC' || s_suppkey] END AS wi, ex.go_ids AS wg, ex.pmids AS wp FROM supplier JOIN ex ON query_id = s_suppkey),
 lb AS (SELECT p.query_id, p.rank, p.accession AS item, g AS go_id, m AS pmid FROM pk p, unnest(p.go_ids) AS u(g), unnest(p.pmids) AS v(m)), kp AS (SELECT query_id, pmid FROM papers WHERE pl BETWEEN 1 AND 49),
 e AS (SELECT lb.*, kp.pmid IS NOT NULL AS kept FROM lb LEFT JOIN kp ON kp.query_id = lb.query_id AND kp.pmid = lb.pmid), c AS (SELECT query_id, count(DISTINCT item) AS n, min(rank) FILTER (list_contains(wi, item)) AS first, count(DISTINCT item) FILTER (list_contains(wi, item)) AS hi FROM e JOIN x USING (query_id) GROUP BY 1),
 g AS (SELECT query_id, count(DISTINCT go_id) FILTER (list_contains(wg, go_id)) AS hg, bool_or(kept AND list_contains(wg, go_id) AND list_contains(wp, pmid)) AS strict FROM e JOIN x USING (query_id) GROUP BY 1),
 q AS (SELECT query_id, count(DISTINCT pmid) AS np, count(DISTINCT pmid) FILTER (list_contains(wp, pmid)) AS hp FROM kp JOIN x USING (query_id) GROUP BY 1)
SELECT query_id, CAST(n AS INTEGER) AS candidates, 1.0::DOUBLE AS typed_rate, round(CASE WHEN len(wi) = 0 THEN 0.0 ELSE hi / len(list_distinct(wi)) END, 6) AS candidate_recall, hi > 0 AS candidate_hit, first AS first_rank, round(hg / 8, 6) AS go_recall, round(hp / np, 6) AS citation_precision, round(hp / len(list_distinct(wp)), 6) AS citation_recall, strict AS strict_path FROM c JOIN g USING (query_id) JOIN q USING (query_id) JOIN x USING (query_id)""")
def pack_reports(t):
    """Packs scored on all sides: candidates, terms, papers and strict paths."""
    from siltstone.plans.answering import papers

    c = candidates(t)
    labels = c.select(F.col("accession").alias("item"), F.explode("go_ids").alias("go_id"), "pmids").select("item", "go_id", F.explode("pmids").alias("pmid")).distinct()
    kept = papers(t).where("at BETWEEN 1 AND 49").select("query_id", "pmid")
    s = F.col("s_suppkey")
    items = t.supplier.where("s_suppkey % 5 <> 0").select(s.alias("query_id"), F.lit("item").alias("kind"), F.explode(F.array(F.concat(F.lit("ACC"), s * 3), F.concat(F.lit("ACC"), s))).alias("value"))
    e = expected(t)
    want = items.unionByName(e.select("query_id", F.lit("go").alias("kind"), F.explode("go_ids").alias("value"))).unionByName(e.select("query_id", F.lit("paper").alias("kind"), F.explode("pmids").alias("value")))
    return evaluation.pack_scores(c.select("query_id", F.col("accession").alias("item"), "rank"), kept, labels, want).select("query_id", "candidates", "typed_rate", "candidate_recall", "candidate_hit", "first_rank", "go_recall", "citation_precision", "citation_recall", "strict_path")


@query(_BM25 + _ROUTES + """, cv AS (SELECT item_id AS query_id, round(coalesce((SELECT count(DISTINCT route) FROM ev WHERE ev.query_id = item_id AND ord <= 8), 0) / 3, 3) AS coverage FROM benchmark)
SELECT query_id, coverage FROM cv UNION ALL SELECT -1 - n_nationkey, 0.0 FROM nation""")
def full_coverage(t):
    """Coverage of all queries, also of those that found nothing."""
    from siltstone.operators import fusion

    asked = t.benchmark.select(F.col("item_id").alias("query_id")).unionByName(t.nation.select((-1 - F.col("n_nationkey")).alias("query_id")))
    return fusion.coverage(_evidence(t), ["fts", "graph", "vector"], asked)


@query(_BM25 + _ROUTES + """, c AS (SELECT ev.query_id, ord, route, ev.entity_id, CASE WHEN route = 'graph' THEN substr(ev.entity_id, 6) ELSE ev.entity_id END AS title, trim(regexp_replace(CASE WHEN route = 'graph' THEN 'in language ' || substr(ev.entity_id, 6) ELSE d.text END, '\\s+', ' ', 'g')) AS x FROM ev LEFT JOIN documents d ON ev.entity_id = 'doc:' || d.doc_id WHERE ord <= 8),
 k AS (SELECT *, CASE WHEN length(x) <= 200 THEN x ELSE rtrim(left(x, 197)) || '...' END AS t2 FROM c WHERE ord <= 4), k4 AS (SELECT *, trim(t2) AS t3 FROM k),
 pp AS (SELECT query_id, string_agg('[P' || ord || '] query --in_language--> ' || title, chr(10) ORDER BY ord) AS paths, count(*) AS np FROM c WHERE route = 'graph' GROUP BY 1),
 a AS (SELECT query_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT route)), ', ') AS routes, string_agg('[E' || ord || '] ' || title || ': ' || t3, chr(10) ORDER BY ord) AS shown, string_agg('[E' || ord || '] ' || title || ' (route ' || route || ')' || chr(10) || t3, chr(10) ORDER BY ord) AS ev FROM k4 GROUP BY 1),
 cv AS (SELECT query_id, round(count(DISTINCT route) / 3, 3) AS cov FROM ev WHERE ord <= 8 GROUP BY 1)
SELECT a.query_id, 'Answer from the evidence only and cite every claim like [E1]; say what is missing.' || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || a.ev || coalesce(chr(10) || chr(10) || paths, '') AS prompt, 'Evidence for: ' || b.text || ' (' || n || ' items from ' || routes || ')' || CASE WHEN np > 0 THEN chr(10) || 'Graph relations: ' || np ELSE '' END || chr(10) || 'Coverage: ' || cov || chr(10) || shown AS answer, CAST(n AS INTEGER) AS n_citations, CAST(coalesce(np, 0) AS INTEGER) AS n_paths
FROM a JOIN benchmark b ON b.item_id = a.query_id JOIN cv ON cv.query_id = a.query_id LEFT JOIN pp ON pp.query_id = a.query_id""")
def generation_prompts(t):
    """The extractive answers and the prompts of the answer packs, whole."""
    return _packs(t).select("query_id", "prompt", "answer", "n_citations", "n_paths")


@query(_BM25 + """, j AS (SELECT bm.item_id, rank, bm.doc_id FROM bm WHERE rank <= 10), bs AS (SELECT item_id, min(rank) FILTER (lang = 'en') AS bio_rank, bool_or(lang IS NOT NULL) AS evaluable FROM j JOIN documents USING (doc_id) GROUP BY 1)
SELECT item_id, bio_rank AS match_rank, coalesce(bio_rank <= 1, false) AS hit_at_1, coalesce(bio_rank <= 5, false) AS hit_at_5, coalesce(bio_rank <= 10, false) AS hit_at_10, round(coalesce(1.0 / bio_rank, 0.0), 6) AS rr FROM bs""")
def biological_hits(t):
    """Hits by shared labels (here: language) instead of identity."""
    from siltstone.operators.knowledge import biological_match

    ranked = _bm25(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    cand = F.create_map(F.lit("gene_symbols"), F.array("lang"))
    want = F.create_map(F.lit("gene_symbols"), F.array(F.lit("EN")))
    return st.first_match(ranked, ["item_id"], biological_match(cand, want)).select("item_id", "match_rank", *st.hits())


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM t)
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS rank FROM (SELECT unnest(w) AS token, count(*) AS n FROM w GROUP BY 1) QUALIFY rank <= 20""")
def frequent_tokens(t):
    """The 20 most frequent tokens of a coverage audit."""
    from siltstone.operators.text_search import frequent_tokens as most

    return most(t.conversations, F.col("text"), 20)
