"""Property graphs as three tables: nodes, edges and aliases; building, lookup, traversal and structure."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import missing, split_list
from siltstone.operators import pairs as pairing
from siltstone.operators.fusion import first_wins
from siltstone.operators.text_search import top
from siltstone.sources.shared import stored

NODE = ["entity_id", "entity_type", "name", "source"]


def upserted(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of tables in order; the first row of each key stays. A NULL in the key is never equal to another."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    cols = [c for c in rows.columns if c not in ("_part", *keys)]
    kept = rows.where(whole).groupBy(*keys).agg(F.min(F.struct("_part", *cols)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])
    return kept.unionByName(rows.where(~whole).drop("_part"))


def alias_rows(df: DataFrame, id_col: str, fields: list[Column], source: str) -> DataFrame:
    """(entity_id, alias, alias_type, source): each element of the fields once; those with a colon are xrefs."""
    names = F.explode(F.flatten(F.array(*[split_list(f) for f in fields])))
    rows = df.select(F.col(id_col).alias("entity_id"), names.alias("alias")).where(missing(F.col("alias")).isNotNull()).distinct()
    return rows.select("entity_id", "alias", F.when(F.instr("alias", ":") > 0, "xref").otherwise("name").alias("alias_type"), F.lit(source).alias("source"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("entity_id").distinct()
    at = lambda end: edges.join(ids, edges[end] == ids["entity_id"], "left_anti")
    return at("source_entity_id").unionByName(at("target_entity_id")).distinct()


def resolved(queries: DataFrame, aliases: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """query_id, entity_id, tier, rank. Tier 0: an alias equal but for case, by an equi-join. Tier 1: the query in an alias
    or a name, by one pass of an automaton over these."""
    from siltstone.operators.splits import containment

    q = queries.select("query_id", F.trim("query").alias("query")).where("query <> ''")
    exact = q.join(aliases, F.upper("query") == F.upper("alias")).select("query_id", "entity_id", F.lit(0).alias("tier"))
    names = aliases.select("entity_id", "alias").unionByName(nodes.select("entity_id", F.col("name").alias("alias")))
    part = containment(q.select("query_id", F.lower("query").alias("query")), names.select(F.col("entity_id").alias("id"), F.lower("alias").alias("text")))
    best = exact.unionByName(part.select("query_id", F.col("id").alias("entity_id"), F.lit(1).alias("tier"))).groupBy("query_id", "entity_id").agg(F.min("tier").alias("tier"))
    return top(best.join(nodes.select("entity_id", "entity_type"), "entity_id"), "query_id", ["tier", "entity_type", "entity_id"], limit)


def expanded(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Edges at each seed (seed_id), in either direction, with both ends' types and names; two equi-joins, not an OR."""
    out = seeds.join(edges, seeds["seed_id"] == edges["source_entity_id"])
    into = seeds.join(edges.where("source_entity_id <> target_entity_id"), seeds["seed_id"] == F.col("target_entity_id"))
    found = top(out.unionByName(into), "seed_id", ["relation_type", "target_entity_id", "source_entity_id"], limit)
    for end in ("source", "target"):
        found = found.join(nodes.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name")), f"{end}_entity_id")
    return found


def neighbours_of(seeds: DataFrame, edges: DataFrame, relations: list[str], per_seed: int) -> DataFrame:
    """seed_id, entity_id, direction, confidence: the per_seed surest neighbours of each seed in each direction."""
    e = edges.where(F.col("relation_type").isin(relations)) if relations else edges
    out = seeds.join(e, seeds["seed_id"] == e["source_entity_id"]).select("seed_id", F.col("target_entity_id").alias("entity_id"), F.lit("out").alias("direction"), "confidence")
    into = seeds.join(e, seeds["seed_id"] == e["target_entity_id"]).select("seed_id", F.col("source_entity_id").alias("entity_id"), F.lit("in").alias("direction"), "confidence")
    return top(out.unionByName(into), ["seed_id", "direction"], [F.desc("confidence"), "entity_id"], per_seed)


def seeded(evidence: DataFrame, by_symbol: DataFrame, by_query: DataFrame, by_title: DataFrame) -> DataFrame:
    """Seeds in tiers: evidence ids, then aliases of its symbols, of the query, of its titles; each (query_id, seed_id) once."""
    parts = [evidence, by_symbol, by_query, by_title]
    rows = reduce(DataFrame.unionByName, [p.select("query_id", "seed_id", F.lit(i).alias("tier"), "pos") for i, p in enumerate(parts)])
    return first_wins(rows, ["query_id", "seed_id"], ["tier", "pos"])


def two_hop(edges: DataFrame, left: str, hub: str, right: str) -> DataFrame:
    """Different (left, right) pairs over a shared hub. edges: (node_type, node, hub).

    Nodes of equal hubs are one class. Pairs of classes are made different, so that those of nodes need no more than a join."""
    side = lambda kind, name: stored(pairing.classed(edges.where(F.col("node_type") == kind).withColumnRenamed("node", name), name, "hub", f"_{name}"), "hubs")
    a, b = side(left, "left"), side(right, "right")
    hubs = lambda df, name: df.select(name).distinct().select(name, F.explode(name).alias("hub"))
    both = hubs(a, "_left").join(hubs(b, "_right"), "hub").select("_left", "_right").distinct()
    return pairing.dealt(a.join(both, "_left").select("left", "_right"), b, "_right").select("left", "right")


def undirected(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """(u, v, weight): one row a pair, the largest weight, no loops."""
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.max(weight).alias("weight"))


def degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def density(n_nodes: Column, n_edges: Column) -> Column:
    return F.when(n_nodes > 1, 2.0 * n_edges / (n_nodes * (n_nodes - 1))).otherwise(0.0)


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: Q = sum over communities of L / m - (d / 2m)^2. membership: (node, community)."""
    c = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    rows = pairs.join(c("u"), "u").join(c("v"), "v")
    ends = rows.select(F.explode(F.array(F.struct(F.col("c_u").alias("c"), F.when(F.col("c_u") == F.col("c_v"), 0.5).otherwise(0.0).alias("inside")), F.struct(F.col("c_v").alias("c"), F.when(F.col("c_u") == F.col("c_v"), 0.5).otherwise(0.0).alias("inside")))).alias("x"))
    by = ends.groupBy("x.c").agg(F.sum("x.inside").alias("inside"), F.count(F.lit(1)).alias("d"))
    m = by.agg((F.sum("d") / 2).alias("m"))
    return by.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached from each node. Minima of neighbours, then of the minima's own."""
    both = stored(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    while True:
        labels = stored(labels)
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        after = stored(lower.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "was"))
        labels = after.select("node", "component")
        if not after.where("component < was").limit(1).count():
            return labels


def clustered(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, cluster) for all ids (node); nodes without pairs are clusters of their own."""
    found = components(pairs)
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def mapped_clusters(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clusters from an external mapping (node, cluster); others get UNMAPPED_ and their id."""
    return ids.join(mapping, "node", "left").select("node", F.coalesce("cluster", F.concat(F.lit("UNMAPPED_"), F.col("node").cast("string"))).alias("cluster"))


def label_propagation(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round every node takes the most frequent label around it, the smallest of equals; ids of any
    type. A round is two shuffles of the links; labels are stored between rounds."""
    both = stored(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        labels = stored(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select("node", F.col("m.community").alias("community")))
    return labels


def cluster_stats(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: nodes, clusters, singletons, and the largest cluster's size. ids: (node); clusters: (node, cluster)."""
    sizes = ids.join(clusters, "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def kmer_graph(nodes: DataFrame, size: int, neighbours: int) -> DataFrame:
    """(u, v, weight): the control graph of k-mer Jaccard neighbours, each node's nearest by score and then the larger id, one row
    a pair. nodes: (node, sequence). Nodes are ranked in blocks where they are read."""
    from siltstone.operators import text_search

    asked = nodes.select(F.col("node").alias("query"), F.col("sequence").alias("q"))
    # The best is taken by id too, smaller first: the larger id is wanted here, so ids are turned around.
    flipped = nodes.select((-F.col("node")).alias("other"), F.col("sequence").alias("s"))
    near = text_search.kmer_jaccard(flipped, "other", F.col("s"), asked, "query", F.col("q"), size, neighbours + 1)
    near = near.where(F.col("query") != -F.col("other")).select("query", (-F.col("other")).alias("other"), "score", "rank")
    return undirected(top(near.drop("rank"), "query", [F.desc("score"), F.desc("other")], neighbours), "query", "other", "score")


#: Links of one graph that a task of degree_null() takes, and of greedy_communities().
GREEDY_LINKS, MERGED_LINKS = 500_000, 2_000_000


def _merged_greedily(us: list, vs: list) -> dict:
    """Each node's community, named by its smallest node.

    A heap has the links of communities by gain. A merge only lowers the gains of links whose count stays, so that their entries
    are corrected when they come up; links that two communities had to the same third are entered anew. Of two communities the
    one with fewer links is moved."""
    m, weight, links, heap, serial = float(len(us)), defaultdict(int), defaultdict(dict), [], count()
    for u, v in zip(us, vs):
        weight[u] += 1
        weight[v] += 1
        around = links[u]
        if u != v:
            link = around[v] = links[v][u] = around.get(v) or [0, u, v, None]  # count, ends, place in the heap
            link[0] += 1
    least, member = {n: n for n in links}, {n: [n] for n in links}

    def place(link: list) -> tuple:
        c, a, b, _ = link
        return (weight[a] * weight[b] / (2 * m * m) - c / m, *sorted((least[a], least[b])))

    def enter(link: list) -> None:
        link[3] = place(link)
        if link[3][0] < -1e-12:
            heappush(heap, (*link[3], next(serial), link))

    for u, around in links.items():
        for link in around.values():
            if link[1] == u:
                enter(link)
    while heap:
        *was, _, link = heappop(heap)
        if link[3] != tuple(was):
            continue
        if link[3] != place(link):
            enter(link)
            continue
        few, many = sorted(link[1:3], key=lambda n: len(links[n]))
        del links[many][few]
        more, around = [], links[many]
        for n, x in links.pop(few).items():
            if n == many:
                continue
            del links[n][few]
            if n in around:
                around[n][0] += x[0]
                x[3] = None
                more.append(around[n])
            else:
                x[1], x[2] = many, n
                around[n] = links[n][many] = x
        weight[many] += weight.pop(few)
        least[many] = min(least[many], least[few])
        short, long = sorted((member.pop(few), member[many]), key=len)
        long += short
        member[many] = long
        for x in more:
            enter(x)
    return {n: least[k] for k, ns in member.items() for n in ns}


def greedy_communities(pairs: DataFrame, group: str) -> DataFrame:
    """(group, node, community) by greedy modularity, each graph of the column `group` in one task. A graph of more than
    MERGED_LINKS links is an error: label_propagation() is the way for these. Communities are merged by the largest gain until
    none is left; ties by the smaller pair."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MERGED_LINKS:
            raise ValueError(f"{len(pdf)} links in one graph; greedy_communities takes {MERGED_LINKS}, label_propagation any number")
        rows = list(_merged_greedily(pdf["u"].tolist(), pdf["v"].tolist()).items())
        return pd.DataFrame({group: pdf[group].iloc[0], "node": [r[0] for r in rows], "community": [r[1] for r in rows]})

    return pairs.groupBy(group).applyInPandas(merge, f"{group} {dict(pairs.dtypes)[group]}, node long, community long")


def degree_null(pairs: DataFrame, replicates: int, swaps: float = 5.0, seed: int = 1) -> DataFrame:
    """(replicate, u, v): double edge swaps that keep every degree; each replicate is one task's random walk, of
    GREEDY_LINKS links at most."""

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > GREEDY_LINKS:
            raise ValueError(f"{len(pdf)} links; a random walk takes {GREEDY_LINKS}")
        r = int(pdf["replicate"].iloc[0])
        rng, e = np.random.default_rng([seed, r]), sorted(zip(pdf["u"].tolist(), pdf["v"].tolist()))
        have = set(e)
        for _ in range(int(swaps * len(e))):
            i, j = rng.integers(len(e)), rng.integers(len(e))
            (a, b), (c, d) = e[i], e[j] if rng.random() < 0.5 else e[j][::-1]
            x, y = (min(a, d), max(a, d)), (min(c, b), max(c, b))
            if i != j and len({a, b, c, d}) == 4 and x not in have and y not in have:
                have -= {e[i], e[j]}
                have |= {x, y}
                e[i], e[j] = x, y
        return pd.DataFrame({"replicate": r, "u": [x[0] for x in e], "v": [x[1] for x in e]})

    return pairs.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "u", "v").groupBy("replicate").applyInPandas(swap, "replicate int, u long, v long")


def traced(seeds: DataFrame, edges: DataFrame, depth: int, budget: int) -> DataFrame:
    """seed_id, u, v, relation_type, depth: edges around each seed, breadth first, the nearest and then the surest first, a
    pair and relation once, `budget` edges a seed."""
    both = edges.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), "relation_type", "confidence").unionByName(edges.select(F.col("target_entity_id").alias("a"), F.col("source_entity_id").alias("b"), "relation_type", "confidence"))
    front = seeds.select("seed_id", F.col("seed_id").alias("node"))
    seen, found = front, None
    for d in range(1, depth + 1):
        step = front.join(both, front["node"] == both["a"]).select("seed_id", "a", "b", "relation_type", "confidence", F.lit(d).alias("depth"))
        found = step if found is None else found.unionByName(step)
        front = step.select("seed_id", F.col("b").alias("node")).distinct().join(seen, ["seed_id", "node"], "left_anti")
        seen = seen.unionByName(front)
    rows = found.select("seed_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "relation_type", "confidence", "depth")
    rows = rows.groupBy("seed_id", "u", "v", "relation_type").agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"))
    return top(rows, "seed_id", ["depth", F.desc("confidence"), "u", "v", "relation_type"], budget)


def display_edges(pairs: DataFrame, per_node: int, budget: int) -> DataFrame:
    """(u, v, weight): the per_node strongest edges of each node, filled up to the budget by the strongest others."""
    ends = pairs.select("u", "v", "weight", F.explode(F.array("u", "v")).alias("node"))
    chosen = top(ends, "node", [F.desc("weight"), "u", "v"], per_node).select("u", "v", F.lit(0).alias("tier")).distinct()
    ranked = pairs.join(chosen, ["u", "v"], "left").select("u", "v", "weight", F.coalesce("tier", F.lit(1)).alias("tier"))
    return ranked.orderBy("tier", F.desc("weight"), "u", "v").limit(budget).select("u", "v", "weight", "tier")


def merged(base: tuple[DataFrame, DataFrame], overlay: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of two graphs, the base's first: each node and each edge key once, edges only among the nodes."""
    nodes = upserted([base[0], overlay[0].select(*base[0].columns)], ["entity_id"])
    ids = nodes.select("entity_id")
    inside = lambda e: e.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    edges = upserted([inside(base[1]), inside(overlay[1].select(*base[1].columns))], ["source_entity_id", "relation_type", "target_entity_id", "source"])
    return nodes.select(*base[0].columns), edges.select(*base[1].columns)


def searched(queries: DataFrame, evidence: DataFrame, aliases: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int, per_symbol: int = 2) -> DataFrame:
    """query_id, edge columns, rank: edges around each query's seeds, `limit` a query.

    Seeds in tiers: entities of the first `limit` evidence rows (query_id, pos, entity_id, symbol, title), up to `per_symbol`
    nodes that each one's symbol names, `limit` nodes that the query names, `per_symbol` that each title names. Seeds are gone
    through in this order, each one's edges by relation and ends; an edge comes once a query."""
    e = evidence.where(F.col("pos") <= limit)
    found = lambda column: _named(e, column, aliases, nodes, per_symbol)
    asked = resolved(queries, aliases, nodes, limit).select("query_id", F.col("entity_id").alias("seed_id"), F.col("rank").cast("long").alias("pos"))
    own = e.where("entity_id is not null").select("query_id", F.col("entity_id").alias("seed_id"), F.col("pos").cast("long").alias("pos"))
    seeds = seeded(own, found("symbol"), asked, found("title"))
    around = expanded(seeds.select("seed_id").distinct(), edges, nodes, limit)
    rows = seeds.join(around.withColumnRenamed("rank", "edge_rank"), "seed_id")
    key = ["query_id", "source_entity_id", "relation_type", "target_entity_id", "source"]
    once = first_wins(rows, key, ["tier", "pos", "seed_id", "edge_rank"])
    return top(once, "query_id", ["tier", "pos", "seed_id", "edge_rank"], limit)


def _named(evidence: DataFrame, column: str, aliases: DataFrame, nodes: DataFrame, each: int) -> DataFrame:
    """Seeds that the values of an evidence column name, in the order of the rows; different values are resolved once."""
    values = evidence.where(F.col(column).isNotNull()).select(F.col(column).alias("query")).distinct().withColumn("query_id", F.col("query"))
    hits = resolved(values, aliases, nodes, each).select(F.col("query_id").alias(column), F.col("entity_id").alias("seed_id"), "rank")
    return evidence.join(hits, column).select("query_id", "seed_id", (F.col("pos") * (each + 1) + F.col("rank")).cast("long").alias("pos"))


def parent_collapse(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """One row: edges within a parent, across parents, and different parent pairs. parents: (node, parent)."""
    p = lambda end: parents.select(F.col("node").alias(end), F.col("parent").alias(f"p_{end}"))
    rows = pairs.join(p("u"), "u").join(p("v"), "v")
    same = F.col("p_u") == F.col("p_v")
    return rows.agg(F.count(F.when(same, 1)).alias("within"), F.count(F.when(~same, 1)).alias("across"), F.count_distinct(F.when(~same, F.struct(F.least("p_u", "p_v"), F.greatest("p_u", "p_v")))).alias("parent_pairs"))


def paths(edges: DataFrame, citations: DataFrame) -> DataFrame:
    """P1, P2, ... of each query's graph rows in order, ties by entity, with the citation of the same entity where there is one."""
    w = Window.partitionBy("query_id").orderBy("ord", "entity_id")
    rows = edges.withColumn("path", F.concat(F.lit("P"), F.row_number().over(w)))
    return rows.join(citations.select("query_id", "entity_id", "citation"), ["query_id", "entity_id"], "left")
