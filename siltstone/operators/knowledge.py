"""Building graphs from knowledge-base rows, and the rows that routes and applications exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.functions.text import compact, missing, split_list, token_id
from siltstone.operators import corpus, graphs, pairs
from siltstone.operators.fusion import first_wins
from siltstone.operators.text_search import top
from siltstone.sources.shared import numbered, stored

EDGE = ["source_entity_id", "relation_type", "target_entity_id", "source", "confidence"]


def scan(kb: DataFrame, kinds: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Rows in the order of their id, of some kinds only; filters reach the scan."""
    rows = kb.where(F.col("kind").isin(kinds)) if kinds else kb
    return rows.orderBy("id").limit(limit) if limit else rows


def lookup(kb: DataFrame, kind: str, source_id: str) -> DataFrame:
    """The row with the smallest id."""
    return kb.where((F.col("kind") == kind) & (F.col("source_id") == source_id)).orderBy("id").limit(1)


def terms_over_xrefs(nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(node, term): terms that a node, or a node that shares a cross reference with it, has by `relation`.

    nodes: (entity_id); edges: the graph's, cross references being those of relations has_...; hubs are exploded once."""
    x = edges.where(F.col("relation_type").startswith("has_")).select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("hub")).distinct()
    has = edges.where(F.col("relation_type") == relation).select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("term")).distinct()
    over = x.join(x.join(has, "node").select("hub", "term").distinct(), "hub").select("node", "term")
    return has.unionByName(over).distinct().join(nodes.select(F.col("entity_id").alias("node")), "node", "left_semi")


def term_counts_over_xrefs(nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(node, terms): how many terms terms_over_xrefs() gives each node, without its pairs.

    Terms are numbered, and a hub's terms are a bitmap. Nodes of equal hubs are one class, whose bitmaps are joined by OR. A
    node's own terms are among its hubs', so they are counted only where it has no hub."""
    x = edges.where(F.col("relation_type").startswith("has_")).select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("hub")).where("hub is not null").distinct()
    has = stored(edges.where(F.col("relation_type") == relation).select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("term")).distinct(), "terms")
    asked = nodes.select(F.col("entity_id").alias("node"))
    number = numbered(has.select(F.col("term").alias("t")).distinct(), ["t"], "n")
    bit = has.join(number, F.col("term").eqNullSafe(F.col("t"))).select("node", (F.col("n") + 1).alias("n"))
    hubs = x.join(bit, "node").groupBy("hub", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    members = stored(pairs.classed(x.join(asked, "node", "left_semi"), "node", "hub", "hubs"), "members")
    each = members.select("hubs").distinct().select("hubs", F.explode("hubs").alias("hub")).join(stored(hubs, "bits"), "hub")
    counts = each.groupBy("hubs", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("hubs").agg(F.sum("n").alias("terms"))
    alone = has.join(x, "node", "left_anti").join(asked, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("terms"))
    return members.join(counts, "hubs").select("node", "terms").unionByName(alone)


def node_id(kind: str, *parts: Column) -> Column:
    """protein:ACC, window:ACC:start-end, evidence:ACC:GO:CODE:n, paper:PMID, go:ID."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *[p.cast("string") for p in parts]))


def window_id(accession: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("window:"), accession, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def edge(source: Column, relation: str, target: Column, origin: str, confidence: float) -> list[Column]:
    return [source.alias("source_entity_id"), F.lit(relation).alias("relation_type"), target.alias("target_entity_id"), F.lit(origin).alias("source"), F.lit(confidence).alias("confidence")]


def document_nodes(kb: DataFrame) -> DataFrame:
    return kb.select(corpus.entity_id(F.col("kind"), F.col("source_id")).alias("entity_id"), F.col("kind").alias("entity_type"), F.coalesce(missing(F.col("symbol")), missing(F.col("name")), F.col("source_id").cast("string")).alias("name"), "source")


def xrefs(kb: DataFrame, families: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a gene's cross references; families: column to node type, each a list in a text."""
    nodes = edges = None
    for c, kind in families.items():
        r = kb.select(corpus.entity_id(F.col("kind"), F.col("source_id")).alias("gene"), F.explode(split_list(F.col(c))).alias("x"))
        n = r.select(corpus.entity_id(F.lit(kind), F.col("x")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col("x").alias("name"), F.lit("xref").alias("source")).distinct()
        e = r.select(*edge(F.col("gene"), f"has_{kind}", corpus.entity_id(F.lit(kind), F.col("x")), "xref", 1.0))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges


def symbol_edges(genes: DataFrame, variants: DataFrame, relation: str) -> DataFrame:
    """Variants to genes by equal symbols, whatever their case; of genes that share a symbol the last in order counts.
    genes: (entity_id, name, ord); variants: (entity_id, gene)."""
    best = genes.where(missing(F.col("name")).isNotNull()).groupBy(F.upper("name").alias("k")).agg(F.max_by("entity_id", "ord").alias("gene_id"))
    return variants.join(best, F.upper("gene") == F.col("k")).select(*edge(F.col("gene_id"), relation, F.col("entity_id"), "symbol", 0.9))


def mapping_edges(mapping: DataFrame, pathways: DataFrame, species: str, limit: int) -> DataFrame:
    """Entities to pathways that exist, of one species, the first `limit` in file order (`at`)."""
    rows = mapping.where(F.col("species") == species).join(pathways.select(F.col("entity_id").alias("pathway")), "pathway", "left_semi").orderBy("at").limit(limit)
    return rows.select(*edge(F.col("entity"), "in_pathway", F.col("pathway"), "mapping", 1.0))


def built(kb: DataFrame, families: dict[str, str], extra: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (documents first, then cross references) and edges, each key once."""
    n, e = xrefs(kb, families)
    return graphs.upserted([document_nodes(kb), n], ["entity_id"]), graphs.upserted([e, *extra], EDGE[:4])


def provenance(proteins: DataFrame, annotations: DataFrame, terms: DataFrame, papers: DataFrame, size: int = 128) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges protein -> window, protein -> evidence -> term and paper, protein -> term and paper.

    proteins: (accession, name, sequence); annotations: (accession, go_id, evidence_code, at, pmids); terms: (go_id, name);
    papers: (pmid, title). Several evidences of one protein and term make one direct edge, the first."""
    p = F.col("accession")
    w = proteins.select("accession", F.explode(seq.edge_windows(F.col("sequence"), size)).alias("w"))
    wid = window_id(p, F.col("w.start"), F.col("w.end"))
    a = annotations.withColumn("evidence", node_id("evidence", p, F.col("go_id"), F.col("evidence_code"), F.col("at")))
    cited = a.select("accession", "go_id", "evidence", F.explode("pmids").alias("pmid")).join(papers.select("pmid"), "pmid", "left_semi")
    node = lambda df, i, kind, name: df.select(i.alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("name"), F.lit("dag").alias("source"))
    nodes = graphs.upserted(
        [node(proteins, node_id("protein", p), "protein", F.col("name")), node(w, wid, "window", wid), node(a, F.col("evidence"), "evidence", F.col("evidence_code")), node(terms, node_id("go", F.col("go_id")), "go", F.col("name")), node(papers, node_id("paper", F.col("pmid")), "paper", F.col("title"))], ["entity_id"]
    )
    protein, go, paper = node_id("protein", p), node_id("go", F.col("go_id")), node_id("paper", F.col("pmid"))
    edges = [
        w.select(*edge(protein, "has_window", wid, "dag", 1.0)), a.select(*edge(protein, "has_evidence", F.col("evidence"), "dag", 1.0)), a.select(*edge(F.col("evidence"), "supports", go, "dag", 1.0)),
        a.select(*edge(protein, "annotated_with", go, "dag", 1.0)), cited.select(*edge(F.col("evidence"), "cites", paper, "dag", 1.0)), cited.select(*edge(protein, "described_in", paper, "dag", 0.9)), cited.select(*edge(paper, "mentions", go, "dag", 0.8)),
    ]
    return nodes, graphs.upserted(edges, EDGE[:4])


def papers_of(edges: DataFrame) -> DataFrame:
    """(accession, pmids): papers of each protein, in numeric order."""
    rows = edges.where(F.col("source_entity_id").startswith("protein:") & F.col("target_entity_id").startswith("paper:"))
    strip = lambda c: F.regexp_replace(c, r"^[a-z]+:", "")
    return rows.groupBy(strip("source_entity_id").alias("accession")).agg(F.transform(F.array_sort(F.collect_set(strip("target_entity_id").cast("long"))), lambda x: x.cast("string")).alias("pmids"))


def view_graph(records: DataFrame, neighbours: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of vector records (record_id, target, name) and edges of their neighbours (query_id, id, score) from `least` on,
    neither to themselves nor twice."""
    nodes = records.select(F.col("record_id").cast("string").alias("entity_id"), corpus.entity_type(F.col("target")).alias("entity_type"), "name", F.lit("vector").alias("source"))
    e = neighbours.where((F.col("query_id") != F.col("id")) & (F.col("score") >= least)).select(F.col("query_id").cast("string").alias("source_entity_id"), F.lit("similar_to").alias("relation_type"), F.col("id").cast("string").alias("target_entity_id"), F.lit("vector").alias("source"), F.col("score").alias("confidence"))
    return nodes, graphs.upserted([e], EDGE[:4])


def seeds_by_label(nodes: DataFrame, label: str, limit: int) -> DataFrame:
    """Nodes that carry a label (`labels`, an array), whatever its case, in the order of their id."""
    return nodes.where(F.exists("labels", lambda x: F.upper(x) == label.upper())).orderBy("entity_id").limit(limit)


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation_type")


def token_graph(counts: DataFrame, associations: DataFrame, namespace: str) -> DataFrame:
    """Edges token -> document (observed_in, by count) and token -> label (associated_with, by odds ratio)."""
    t = token_id(namespace, F.col("token"))
    seen = counts.select(t.alias("source_entity_id"), F.lit("observed_in").alias("relation_type"), F.col("doc_id").cast("string").alias("target_entity_id"), F.lit(namespace).alias("source"), F.col("n").cast("double").alias("confidence"))
    return seen.unionByName(associations.select(t.alias("source_entity_id"), F.lit("associated_with").alias("relation_type"), F.col("label").alias("target_entity_id"), F.lit(namespace).alias("source"), F.col("odds_ratio").alias("confidence")))


def evidence_row(route: str, **cols: Column) -> list[Column]:
    """The common evidence columns; those not given are NULL."""
    names = {"entity_id": "string", "kind": "string", "source_id": "string", "symbol": "string", "title": "string", "text": "string", "score": "double", "source": "string"}
    return [F.lit(route).alias("route"), *[(cols[n] if n in cols else F.lit(None)).cast(t).alias(n) for n, t in names.items()]]


def text_evidence(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("rank").alias("pos"), *evidence_row("fts", entity_id=corpus.entity_id(F.col("kind"), F.col("source_id")), kind=F.col("kind"), source_id=F.col("source_id"), symbol=F.col("symbol"), title=F.coalesce(missing(F.col("name")), F.col("symbol")), text=compact(F.col("description"), 400), score=F.col("score"), source=F.col("source")))


def alignment_evidence(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").alias("pos"), *evidence_row("blast", entity_id=F.col("subject_id"), kind=F.lit("sequence"), source_id=F.col("subject_id"), title=F.col("subject_id"), text=F.format_string("identity %.2f over %d positions", "identity", "aln_length"), score=F.col("bitscore"), source=F.lit("alignment")))


def graph_evidence(edges: DataFrame) -> DataFrame:
    path = F.concat_ws(" ", "source_name", F.concat(F.lit("--"), "relation_type", F.lit("-->")), "target_name")
    return edges.select("query_id", F.col("rank").alias("pos"), *evidence_row("graph", entity_id=F.col("target_entity_id"), kind=F.lit("edge"), title=path, text=path, score=F.col("confidence"), source=F.col("source")))


def vector_evidence(hits: DataFrame) -> DataFrame:
    title = F.concat_ws(" ", "name", F.when(F.col("start").isNotNull(), F.concat(F.lit("["), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("]"))))
    return hits.select("query_id", F.col("rank").alias("pos"), *evidence_row("vector", entity_id=F.col("id"), kind=F.col("target"), title=title, text=F.col("text"), score=F.col("score"), source=F.lit("vector")))


def vector_target(kind: Column, available: list[str]) -> Column:
    """The first target that there is for a query's alphabet: windows before whole sequences before text."""
    order = {"protein": ["protein_window", "protein_sequence", "mixed"], "dna": ["dna_window", "dna_sequence", "mixed"]}
    pick = lambda names: next((n for n in names if n in available), None)
    text = pick(["text", "entity", "mixed"])
    return F.when(kind.isin("dna", "rna"), F.lit(pick(order["dna"]))).when(kind.isNotNull(), F.lit(pick(order["protein"]))).otherwise(F.lit(text))


def query_texts(query: Column, kind: Column, size: int = 128, stride: int = 64) -> Column:
    """A text as it is; a sequence by its windows, whole too if it isn't longer than max(2 size, 512)."""
    s = seq.clean(query)
    whole = F.length(s) <= max(2 * size, 512)
    return F.when(kind.isNull(), F.array(query)).when(whole, seq.window_texts(query, size, stride)).otherwise(seq.window_texts(query, size, stride, whole=False))


def traces(evidence: DataFrame, routes: list[str]) -> DataFrame:
    """A row for each query and route asked: hits, and ok or no_hits."""
    asked = evidence.select("query_id").distinct().withColumn("route", F.explode(F.array(*map(F.lit, routes))))
    n = evidence.groupBy("query_id", "route").agg(F.count(F.lit(1)).alias("hits"))
    return asked.join(n, ["query_id", "route"], "left").select("query_id", "route", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") > 0, "ok").otherwise("no_hits").alias("status"))


def resolved_evidence(ids: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence of entities, from their node where there is none."""
    e = evidence.select("entity_id", "title", "text")
    n = nodes.select("entity_id", F.col("name").alias("node_name"), "entity_type")
    return ids.join(e, "entity_id", "left").join(n, "entity_id", "left").select("entity_id", F.coalesce("title", "node_name", "entity_id").alias("title"), F.coalesce("text", F.concat_ws(" ", "entity_type", "node_name")).alias("text"))


def parents_once(evidence: DataFrame, parent: str) -> DataFrame:
    """The first window of each parent."""
    return first_wins(evidence, ["query_id", parent], ["pos"])


def annotated(tasks: DataFrame, size: int) -> DataFrame:
    """Tasks (id, query, expected map of arrays) with modality, target partitions, label type and split."""
    from siltstone.operators.splits import hash_split

    kind = seq.detected(F.col("query"))
    m = F.when(kind.isNull(), "text").when(kind.isin("dna", "rna"), "dna").otherwise("protein")
    return tasks.select("id", m.alias("modality"), F.when(m == "text", F.array(F.lit("text"), F.lit("entity"))).otherwise(F.array(F.concat(m, F.lit("_sequence")), F.concat(m, F.lit("_window")))).alias("partitions"), corpus.label_type(F.col("expected")).alias("label_type"), hash_split(F.col("id")).alias("split"))


def biological_match(candidate: Column, expected: Column) -> Column:
    """Shared gene ids (by case), symbols, names or families (any case); both are maps of arrays."""
    none = F.array().cast("array<string>")
    get = lambda m, k: F.coalesce(m[k], none)
    up = lambda a: F.transform(a, lambda x: F.upper(x))
    names = lambda m: up(F.concat(get(m, "gene_symbols"), get(m, "protein_gene_names")))
    family = F.arrays_overlap(up(get(candidate, "gene_families")), up(get(expected, "gene_families")))
    return F.arrays_overlap(get(candidate, "gene_ids"), get(expected, "gene_ids")) | F.arrays_overlap(names(candidate), names(expected)) | family


def application_rows(documents: DataFrame, nodes: DataFrame, edges: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, entities and relationships as an application takes them, all marked with the snapshot."""
    s = F.lit(snapshot).alias("snapshot")
    named = lambda end: nodes.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(end))
    d = documents.select(F.col("id").alias("document_id"), "text", "modality", s)
    e = nodes.select("entity_id", "name", F.col("entity_type").alias("category"), s)
    r = edges.join(named("source").withColumnRenamed("source", "subject"), "source_entity_id").join(named("target").withColumnRenamed("target", "object"), "target_entity_id").select("subject", F.col("relation_type").alias("predicate"), "object", F.col("confidence").alias("weight"), s)
    return d, e, r


def top_positives(tasks: DataFrame, corpus_keys: DataFrame, limit: int = 20) -> DataFrame:
    """(id, record_id): corpus rows of a task's expected keys (id, kind, key), any case, each once, `limit` a task."""
    k = lambda df: df.withColumn("k", F.upper("key"))
    hit = k(tasks).drop("key").join(k(corpus_keys).drop("key"), ["kind", "k"]).select("id", "record_id").distinct()
    return top(hit, "id", ["record_id"], limit)
