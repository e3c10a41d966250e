"""Graph queries: the star schema as a typed property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import corpus, graphs
from siltstone.plans.catalog import query

_NODES = """
nodes AS (SELECT 'region:' || r_regionkey AS entity_id, 'region' AS entity_type, r_name AS name, 'star' AS source FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'star' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'star' FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'star' FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'star' FROM part)
"""
_EDGES = """
edges AS (SELECT 'nation:' || n_nationkey AS source_entity_id, 'in_region' AS relation_type, 'region:' || n_regionkey AS target_entity_id, 'star' AS source, 1.0 AS confidence FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, 'star', 0.9 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, 'star', 0.9 FROM supplier
 UNION ALL SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, 'star', least(1.0, count(*) / 10.0) FROM lineitem GROUP BY l_suppkey, l_partkey)
"""


def nodes(t):
    part = lambda df, kind, i, n: df.select(corpus.entity_id(F.lit(kind), F.col(i)).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(n).alias("name"), F.lit("star").alias("source"))
    return graphs.upserted([part(t.region, "region", "r_regionkey", "r_name"), part(t.nation, "nation", "n_nationkey", "n_name"), part(t.customer, "customer", "c_custkey", "c_name"), part(t.supplier, "supplier", "s_suppkey", "s_name"), part(t.part, "part", "p_partkey", "p_name")], ["entity_id"])


def edges(t):
    at = lambda kind, c: corpus.entity_id(F.lit(kind), F.col(c))
    row = lambda df, a, rel, b, conf: df.select(a.alias("source_entity_id"), F.lit(rel).alias("relation_type"), b.alias("target_entity_id"), F.lit("star").alias("source"), conf.cast("double").alias("confidence"))
    supplies = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        row(t.nation, at("nation", "n_nationkey"), "in_region", at("region", "n_regionkey"), F.lit(1.0))
        .unionByName(row(t.customer, at("customer", "c_custkey"), "in_nation", at("nation", "c_nationkey"), F.lit(0.9)))
        .unionByName(row(t.supplier, at("supplier", "s_suppkey"), "in_nation", at("nation", "s_nationkey"), F.lit(0.9)))
        .unionByName(row(supplies, at("supplier", "l_suppkey"), "supplies", at("part", "l_partkey"), F.least(F.lit(1.0), F.col("n") / 10.0)))
    )


def _shared_parts(t):
    """Supplier pairs that share a part."""
    s = t.lineitem.select(F.col("l_partkey").alias("hub"), F.col("l_suppkey").alias("s")).distinct()
    pairs = s.join(s.withColumnRenamed("s", "z"), "hub").where("s < z")
    return pairs.groupBy(F.col("s").alias("u"), F.col("z").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


_SHARED = """shared AS (SELECT a.l_suppkey AS u, z.l_suppkey AS v, count(*) AS weight FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a
 JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) z USING (l_partkey) WHERE a.l_suppkey < z.l_suppkey GROUP BY 1, 2)"""


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes_first_wins(t):
    again = nodes(t).withColumn("name", F.upper("name"))  # a later source with other names loses
    return graphs.upserted([nodes(t), again], ["entity_id"]).select("entity_id", "entity_type", "name", "source")


@query(f"WITH {_EDGES} SELECT source_entity_id, relation_type, target_entity_id, source, round(confidence, 6) AS confidence FROM edges")
def graph_edges_star(t):
    return graphs.upserted([edges(t)], ["source_entity_id", "relation_type", "target_entity_id", "source"]).select("source_entity_id", "relation_type", "target_entity_id", "source", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_NODES}, {_EDGES} SELECT relation_type AS kind, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT entity_type, count(*) FROM nodes GROUP BY 1")
def status_counts(t):
    return corpus.status(edges(t), "relation_type").unionByName(corpus.status(nodes(t), "entity_type"))


@query("""WITH a AS (SELECT DISTINCT 'part:' || p_partkey AS entity_id, trim(x) AS alias FROM (SELECT p_partkey, unnest(string_split(replace(p_name || '|' || p_brand || ',brand:' || p_brand, '|', ','), ',')) AS x FROM part) WHERE trim(x) NOT IN ('', '-'))
SELECT entity_id, alias, CASE WHEN contains(alias, ':') THEN 'xref' ELSE 'name' END AS alias_type, 'star' AS source FROM a""")
def alias_rows(t):
    rows = t.part.withColumn("entity_id", corpus.entity_id(F.lit("part"), F.col("p_partkey")))
    return graphs.alias_rows(rows, "entity_id", [F.concat("p_name", F.lit("|"), "p_brand"), F.concat(F.lit("brand:"), "p_brand")], "star")


_QUERIES = "q AS (SELECT n_nationkey AS query_id, n_name AS query FROM nation)"


@query(f"""WITH {_NODES}, {_QUERIES}, a AS (SELECT entity_id, name AS alias FROM nodes),
 m AS (SELECT query_id, entity_id, CASE WHEN upper(query) = upper(alias) THEN 0 ELSE 1 END AS tier FROM q JOIN a ON contains(lower(alias), lower(trim(query)))),
 b AS (SELECT query_id, entity_id, min(tier) AS tier FROM m GROUP BY 1, 2)
SELECT query_id, entity_id, CAST(tier AS INTEGER) AS tier, entity_type, rank FROM (SELECT b.*, entity_type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, entity_type, entity_id) AS INTEGER) AS rank FROM b JOIN nodes USING (entity_id)) WHERE rank <= 8""")
def alias_resolve(t):
    """Nation names resolved among all names of the graph."""
    n = nodes(t)
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    return graphs.resolved(q, n.select("entity_id", F.col("name").alias("alias")), n, 8).select("query_id", "entity_id", "tier", "entity_type", "rank")


@query(f"""WITH {_NODES}, {_EDGES}, s AS (SELECT 'nation:' || n_nationkey AS seed_id FROM nation), f AS (SELECT seed_id, e.* FROM s JOIN edges e ON seed_id = source_entity_id UNION ALL SELECT seed_id, e.* FROM s JOIN edges e ON seed_id = target_entity_id AND source_entity_id <> target_entity_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY relation_type, target_entity_id, source_entity_id) AS INTEGER) AS rank FROM f)
SELECT seed_id, source_entity_id, relation_type, target_entity_id, rank, a.name AS source_name, b.name AS target_name FROM r JOIN nodes a ON a.entity_id = source_entity_id JOIN nodes b ON b.entity_id = target_entity_id WHERE rank <= 20""")
def graph_expand(t):
    seeds = t.nation.select(corpus.entity_id(F.lit("nation"), F.col("n_nationkey")).alias("seed_id"))
    return graphs.expanded(seeds, edges(t), nodes(t), 20).select("seed_id", "source_entity_id", "relation_type", "target_entity_id", "rank", "source_name", "target_name")


@query(f"""WITH {_EDGES}, s AS (SELECT 'supplier:' || s_suppkey AS seed_id FROM supplier), f AS (SELECT seed_id, target_entity_id AS entity_id, 'out' AS direction, confidence FROM s JOIN edges ON seed_id = source_entity_id WHERE relation_type = 'supplies'
 UNION ALL SELECT seed_id, source_entity_id, 'in', confidence FROM s JOIN edges ON seed_id = target_entity_id WHERE relation_type = 'supplies')
SELECT seed_id, entity_id, direction, round(confidence, 6) AS confidence, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id, direction ORDER BY confidence DESC, entity_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def graph_candidates(t):
    seeds = t.supplier.select(corpus.entity_id(F.lit("supplier"), F.col("s_suppkey")).alias("seed_id"))
    return graphs.neighbours_of(seeds, edges(t), ["supplies"], 5).select("seed_id", "entity_id", "direction", F.round("confidence", 6).alias("confidence"), "rank")


@query("SELECT DISTINCT 'customer:' || c_custkey AS \"left\", 'supplier:' || s_suppkey AS \"right\" FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def two_hop_xref(t):
    """Customers and suppliers over their nation."""
    rows = t.customer.select(F.lit("customer").alias("node_type"), corpus.entity_id(F.lit("customer"), F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("hub")).unionByName(t.supplier.select(F.lit("supplier").alias("node_type"), corpus.entity_id(F.lit("supplier"), F.col("s_suppkey")).alias("node"), F.col("s_nationkey").alias("hub")))
    return graphs.two_hop(rows, "customer", "hub", "supplier")


@query(f"WITH {_SHARED}, d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM shared UNION ALL SELECT v FROM shared) GROUP BY node) SELECT count(*) AS nodes, (SELECT count(*) FROM shared) AS edges, round(2.0 * (SELECT count(*) FROM shared) / (count(*) * (count(*) - 1)), 6) AS density, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree FROM d")
def degree_density(t):
    pairs = _shared_parts(t)
    d = graphs.degrees(pairs).agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean"))
    return d.crossJoin(pairs.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", F.round(graphs.density(F.col("nodes"), F.col("edges")), 6).alias("density"), "max_degree", F.round("mean", 6).alias("mean_degree"))


@query(f"""WITH {_SHARED}, e AS (SELECT a.s_nationkey AS cu, b.s_nationkey AS cv FROM shared JOIN supplier a ON u = a.s_suppkey JOIN supplier b ON v = b.s_suppkey), m AS (SELECT count(*) AS m FROM e),
 x AS (SELECT c, sum(i) AS l, count(*) AS d FROM (SELECT cu AS c, CASE WHEN cu = cv THEN 0.5 ELSE 0 END AS i FROM e UNION ALL SELECT cv, CASE WHEN cu = cv THEN 0.5 ELSE 0 END FROM e) GROUP BY c)
SELECT round(CAST(sum(l / m - power(d / (2.0 * m), 2)) AS DOUBLE), 6) AS modularity, count(*) AS communities FROM x, m""")
def modularity_by_label(t):
    return graphs.modularity(_shared_parts(t), t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))).select(F.round("modularity", 6).alias("modularity"), "communities")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label AND abs(a.vec_id - b.vec_id) <= 3),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def connected_components(t):
    """Vectors of one label whose numbers are at most three apart."""
    v = t.embeddings.select("vec_id", "label")
    near = v.select(F.col("vec_id").alias("u"), "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("v"))
    pairs = near.join(v.select(F.col("vec_id").alias("v"), F.col("label").alias("l2")), "v").where("label = l2").select("u", "v")
    return graphs.components(pairs)


@query(f"""WITH {_SHARED}, n AS (SELECT u, v, weight, node FROM (SELECT *, u AS node FROM shared UNION ALL SELECT *, v FROM shared)), c AS (SELECT DISTINCT u, v, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, u, v) AS r FROM n) WHERE r <= 2)
SELECT u, v, weight, CAST(coalesce(tier, 1) AS INTEGER) AS tier FROM shared LEFT JOIN c USING (u, v) ORDER BY coalesce(tier, 1), weight DESC, u, v LIMIT 60""")
def display_edges(t):
    return graphs.display_edges(_shared_parts(t), 2, 60)


@query(f"WITH {_SHARED}, x AS (SELECT a.s_nationkey AS p, b.s_nationkey AS q FROM shared JOIN supplier a ON u = a.s_suppkey JOIN supplier b ON v = b.s_suppkey) SELECT count(*) FILTER (p = q) AS within, count(*) FILTER (p <> q) AS across, count(DISTINCT CASE WHEN p <> q THEN least(p, q) * 1000 + greatest(p, q) END) AS parent_pairs FROM x")
def parent_collapse(t):
    return graphs.parent_collapse(_shared_parts(t), t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("parent")))


@query(f"""WITH {_EDGES}, b AS (SELECT source_entity_id AS a, target_entity_id AS b, relation_type, confidence FROM edges UNION ALL SELECT target_entity_id, source_entity_id, relation_type, confidence FROM edges),
 s AS (SELECT 'region:' || r_regionkey AS seed_id FROM region), one AS (SELECT seed_id, a, b, relation_type, confidence, 1 AS depth FROM s JOIN b ON a = seed_id),
 f AS (SELECT DISTINCT seed_id, b AS node FROM one WHERE b <> seed_id), two AS (SELECT seed_id, a, b, relation_type, confidence, 2 AS depth FROM f JOIN b ON a = node)
SELECT seed_id, u, v, relation_type, CAST(depth AS INTEGER) AS depth, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY depth, confidence DESC, u, v, relation_type) AS INTEGER) AS rank FROM
 (SELECT seed_id, least(a, b) AS u, greatest(a, b) AS v, relation_type, min(depth) AS depth, max(confidence) AS confidence FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2, 3, 4)) WHERE rank <= 30""")
def bfs_trace(t):
    """Edges within two steps of each region, 30 a region."""
    seeds = t.region.select(corpus.entity_id(F.lit("region"), F.col("r_regionkey")).alias("seed_id"))
    return graphs.traced(seeds, edges(t), 2, 30).select("seed_id", "u", "v", "relation_type", "depth", "rank")


def _near_vectors(t):
    """The neighbour graph of all vectors."""
    from siltstone.plans.search import _knn

    return graphs.undirected(_knn(t), "query_id", "id", "score")


@query()
def community_detection(t):
    """Greedy-modularity communities of the vectors' neighbour graph (no SQL: merges in sequence)."""
    return graphs.greedy_communities(_near_vectors(t).withColumn("graph", F.lit("vectors")), "graph")


@query()
def degree_null(t):
    """Degrees of three degree-preserving nulls of the vectors' neighbour graph (no SQL: random walks)."""
    null = graphs.degree_null(_near_vectors(t), 3)
    return null.select("replicate", F.explode(F.array("u", "v")).alias("node")).groupBy("replicate", "node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {_NODES}, {_EDGES}, bad AS (SELECT * FROM edges UNION ALL SELECT 'part:-1', 'made_of', 'part:1', 'star', 1.0) SELECT source_entity_id, relation_type, target_entity_id FROM bad WHERE source_entity_id NOT IN (SELECT entity_id FROM nodes) OR target_entity_id NOT IN (SELECT entity_id FROM nodes)")
def dangling_edges(t):
    bad = t.spark.createDataFrame([("part:-1", "made_of", "part:1", "star", 1.0)], edges(t).schema)
    return graphs.dangling(edges(t).unionByName(bad), nodes(t)).select("source_entity_id", "relation_type", "target_entity_id")
