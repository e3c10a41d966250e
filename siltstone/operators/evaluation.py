"""Reports over rankings, packs, communities and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import statistics as st
from siltstone.operators.text_search import top
from siltstone.sources.shared import stored


def ranking_report(ranked: DataFrame, expected: DataFrame, papers: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """query_id with hit and recall at each k, reciprocal rank, paper hit and recall, and a complete path (both found).

    ranked: (query_id, item, rank); expected: (query_id, item); papers: (query_id, pmid, found)."""
    rows = expected.select("query_id", "item").distinct().join(ranked, ["query_id", "item"], "left")
    at = [c for k in ks for c in (F.max(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hit_at_{k}"), F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}"))]
    items = rows.groupBy("query_id").agg(*at, F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))
    p = papers.groupBy("query_id").agg(F.max("found").alias("paper_hit"), F.round(F.avg(F.col("found").cast("double")), 6).alias("paper_recall"))
    return items.join(p, "query_id", "left").withColumn("path_complete", F.coalesce(F.col(f"hit_at_{ks[0]}") & F.col("paper_hit"), F.lit(False)))


def budget_reports(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by budget, and by budget with category or query type."""
    sets = [[F.col("budget")], [F.col("category"), F.col("budget")], [F.col("query_type"), F.col("budget")]]
    return rows.groupingSets(sets, "budget", "category", "query_type").agg(F.count(F.lit(1)).alias("tasks"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])


def status_report(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means and a map of status counts."""
    n = rows.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    return rows.groupBy(*by).agg(*[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics]).join(n, by)


def pack_scores(candidates: DataFrame, papers: DataFrame, labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Scores of evidence packs, one row a query.

    candidates: (query_id, item, rank); papers: (query_id, pmid); labels: (item, go_id, pmid), an edge each; expected:
    (query_id, kind, value) of kinds item, go and paper."""
    want = lambda k: expected.where(F.col("kind") == k).groupBy("query_id").agg(F.collect_set("value").alias(f"want_{k}"))
    e = candidates.join(labels, "item", "left").join(papers.withColumn("kept", F.lit(True)), ["query_id", "pmid"], "left")
    typed = e.groupBy("query_id", "item").agg(F.min("rank").alias("rank"), F.max(F.col("go_id").isNotNull() | F.col("kept").isNotNull()).alias("typed"))
    c = typed.groupBy("query_id").agg(F.collect_set("item").alias("items"), F.round(F.avg(F.col("typed").cast("double")), 6).alias("typed_rate"), F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("ranked"))
    g = e.groupBy("query_id").agg(F.collect_set("go_id").alias("gos"), F.collect_set(F.when(F.col("kept"), F.col("pmid"))).alias("bridged"), F.collect_set(F.when(F.col("kept") & F.col("go_id").isNotNull(), F.concat_ws("|", "go_id", "pmid"))).alias("edges"))
    p = papers.groupBy("query_id").agg(F.collect_set("pmid").alias("papers"))
    rows = c.join(g, "query_id").join(p, "query_id", "left").join(want("item"), "query_id", "left").join(want("go"), "query_id", "left").join(want("paper"), "query_id", "left")
    none = F.array().cast("array<string>")
    a = lambda n: F.coalesce(F.col(n), none)
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a(x), a(y))), F.size(a(y))), F.lit(0.0)), 6)
    hit = lambda x, y: F.arrays_overlap(a(x), a(y))
    strict = F.exists(a("edges"), lambda x: F.array_contains(a("want_go"), F.split_part(x, F.lit("|"), F.lit(1))) & F.array_contains(a("want_paper"), F.split_part(x, F.lit("|"), F.lit(2))))
    first = F.array_min(F.transform(F.filter("ranked", lambda s: F.array_contains(a("want_item"), s["item"])), lambda s: s["rank"]))
    return rows.select("query_id", F.size("items").alias("candidates"), "typed_rate", share("items", "want_item").alias("candidate_recall"), hit("items", "want_item").alias("candidate_hit"), first.alias("first_rank"), share("gos", "want_go").alias("go_recall"), share("want_paper", "papers").alias("citation_precision"), share("papers", "want_paper").alias("citation_recall"), share("bridged", "want_paper").alias("path_support"), (hit("items", "want_item") & hit("papers", "want_paper")).alias("path_complete"), strict.alias("strict_path"))


def selected_claims(claims: DataFrame, by: str, k: int) -> DataFrame:
    """Rank-first selection: claims in the order of their best candidate, each once."""
    best = claims.groupBy(by, "claim").agg(F.min(F.struct("rank", "claim")).alias("at"))
    return top(best, by, ["at"], k).select(by, "claim", "rank")


def oracle_claims(claims: DataFrame, expected: DataFrame, by: str, k: int) -> DataFrame:
    """What a perfect selector could take: expected claims among the candidates', `k` at most."""
    return top(claims.select(by, "claim").distinct().join(expected, [by, "claim"], "left_semi"), by, ["claim"], k)


def tuned(rows: DataFrame, configs: list[str], objective: list[str], split: str = "dev") -> DataFrame:
    """The configuration with the lexicographically best mean objective on the dev split; the smallest of equals.

    rows: one for each query and configuration, with its split and metrics."""
    means = rows.where(F.col("split") == split).groupBy(*configs).agg(*[F.round(F.avg(m), 9).alias(m) for m in objective])
    return means.orderBy(*[F.desc(m) for m in objective], *configs).limit(1)


def conditional(rows: DataFrame, oracle: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means over the queries where the oracle finds something. oracle: (query_id, hit)."""
    return rows.join(oracle.where("hit").select("query_id"), "query_id", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])


def paired(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """(query_id, delta) of two result sets over the same queries; other query sets are an error."""
    delta = left.select("query_id", F.col(metric).cast("double").alias("a")).join(right.select("query_id", F.col(metric).cast("double").alias("b")), "query_id", "full_outer")
    check = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.concat(F.lit("query in one set only: "), F.col("query_id").cast("string"))).cast("double"))
    return delta.select("query_id", F.coalesce(check, F.col("a") - F.col("b")).alias("delta"))


def same_queries(methods: DataFrame) -> DataFrame:
    """(query_id, missing) queries that some method lacks; none if all have the same. methods: (method, query_id)."""
    all_ = methods.select("method").distinct().agg(F.collect_set("method").alias("all"))
    have = methods.groupBy("query_id").agg(F.collect_set("method").alias("have"))
    return have.crossJoin(F.broadcast(all_)).select("query_id", F.array_sort(F.array_except("all", "have")).alias("missing")).where(F.size("missing") > 0)


def community_enrichment(membership: DataFrame, terms: DataFrame, least_size: int, least: int, most_rate: float) -> DataFrame:
    """community, term, observed, p, q, enrichment of terms (node, term) among the labelled nodes of communities."""
    m = membership.select("node", "community").distinct()
    t = terms.distinct().join(m, "node")
    pop = t.select("node").distinct().count()
    size = t.groupBy("community").agg(F.count_distinct("node").alias("draws")).where(F.col("draws") >= least_size)
    glob = t.groupBy("term").agg(F.count_distinct("node").alias("successes")).where(F.col("successes") <= most_rate * pop)
    seen = t.groupBy("community", "term").agg(F.count_distinct("node").alias("observed")).where(F.col("observed") >= least)
    rows = seen.join(size, "community").join(glob, "term").withColumn("population", F.lit(pop))
    q = st.benjamini_hochberg(st.hypergeometric(rows, ["community", "term"]), order=["community", "term"])
    return q.withColumn("enrichment", st.enrichment(F.col("observed") / F.col("draws"), F.col("successes") / F.col("population")))


def literature_support(membership: DataFrame, papers: DataFrame, top_n: int = 5) -> DataFrame:
    """community, papers, shared (on two nodes or more) and the most shared papers. papers: (node, pmid)."""
    c = membership.join(papers.distinct(), "node").groupBy("community", "pmid").agg(F.count_distinct("node").alias("n"))
    counts = c.groupBy("community").agg(F.count(F.lit(1)).alias("papers"), F.count(F.when(F.col("n") >= 2, 1)).alias("shared"))
    best = top(c.where("n >= 2"), "community", [F.desc("n"), "pmid"], top_n).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmid"))), lambda s: s["pmid"]).alias("top_papers"))
    return counts.join(best, "community", "left")


def token_associations(tokens: DataFrame, labels: DataFrame, least_token: int, least_label: int, most_share: float, least_overlap: int) -> DataFrame:
    """token, label, n11, odds_ratio, p, q over all pairs of frequent enough tokens and labels: pairs that never meet have
    p = 1 and count as tests. tokens: (doc_id, token); labels: (doc_id, label)."""
    t, g, n = _frequent(tokens, labels, least_token, least_label, most_share)
    return _associations(tokens, labels, t, g, n, []).where(F.col("observed") >= least_overlap)


def _frequent(tokens: DataFrame, labels: DataFrame, least_token: int, least_label: int, most_share: float) -> tuple[DataFrame, DataFrame, int]:
    n = tokens.select("doc_id").union(labels.select("doc_id")).distinct().count()
    t = tokens.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("dt")).where((F.col("dt") >= least_token) & (F.col("dt") <= most_share * n))
    return t, labels.distinct().groupBy("label").agg(F.count(F.lit(1)).alias("dl")).where(F.col("dl") >= least_label), n


def _associations(tokens: DataFrame, labels: DataFrame, t: DataFrame, g: DataFrame, n: int, by: list[str]) -> DataFrame:
    """labels may have further columns `by`, each of whose values is a table of its own."""
    both = tokens.distinct().join(t, "token").join(labels.distinct().join(g, "label"), "doc_id").groupBy(*by, "token", "label").agg(F.count(F.lit(1)).alias("observed"), F.first("dt").alias("draws"), F.first("dl").alias("successes"))
    tests = t.count() * g.count()
    rows = stored(st.hypergeometric(both.withColumn("population", F.lit(n)), [*by, "token", "label"]), "associations")
    # The pairs that never meet come last with p = 1: they only raise the number of tests.
    q = st.benjamini_hochberg(rows, by=by, order=["token", "label"])
    met = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_met"))
    q = (q.join(met, by) if by else q.crossJoin(F.broadcast(met))).withColumn("q", F.least(F.lit(1.0), F.col("q") * F.lit(tests) / F.col("_met"))).drop("_met")
    a, b, c = F.col("observed"), F.col("draws") - F.col("observed"), F.col("successes") - F.col("observed")
    return q.withColumn("odds_ratio", st.odds_ratio(a, b, c, F.lit(n) - a - b - c))


def permutation_null(tokens: DataFrame, labels: DataFrame, lengths: DataFrame, least_token: int, least_label: int, most_share: float, least_overlap: int, fdr: float = 0.05, bins: int = 10, replicates: int = 20, seed: str = "1") -> DataFrame:
    """One row: observed significant associations, replicates, their mean number under labels dealt anew among documents of
    similar length, and the empirical p, (1 + replicates with as many) / (1 + replicates). lengths: (doc_id, length)."""
    t, g, n = _frequent(tokens, labels, least_token, least_label, most_share)
    good = (F.col("q") <= fdr) & (F.col("odds_ratio") > 1) & (F.col("observed") >= least_overlap)
    observed = _associations(tokens, labels, t, g, n, []).where(good).count()
    sets = lengths.join(labels.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels")), "doc_id", "left")
    dealt = st.stratified_permutation(sets, "doc_id", "length", "labels", bins, replicates, seed)
    null = _associations(tokens, dealt.select("replicate", "doc_id", F.explode("labels").alias("label")), t, g, n, ["replicate"])
    counts = null.groupBy("replicate").agg(F.count(F.when(good, 1)).alias("n"))
    every = tokens.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    counts = every.join(counts, "replicate", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.lit(observed).cast("long").alias("observed"), F.count(F.lit(1)).alias("replicates"), F.round(F.avg("n"), 6).alias("null_mean"), F.round((1 + F.count(F.when(F.col("n") >= observed, 1))) / (1 + F.count(F.lit(1))), 6).alias("empirical_p"))


def graph_rerank_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Seed and expanded candidates: recall over the evaluable rows, mean counts and latency, and the graph's statuses.

    rows: bio_evaluable, seed_hit, expanded_hit (booleans), seeds, added, neighbours, nodes_found, ms, graph_status."""
    share = lambda c, n: F.round(F.coalesce(F.avg(F.when(F.col("bio_evaluable"), F.coalesce(F.col(c), F.lit(False)).cast("double"))), F.lit(0.0)), 4).alias(n)
    mean = lambda c, d=4: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), d).alias(f"mean_{c}")
    n = rows.groupBy(*by, "graph_status").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("graph_status", "n")))).alias("statuses"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), share("seed_hit", "seed_recall"), share("expanded_hit", "expanded_recall"), *map(mean, ("seeds", "added", "neighbours", "nodes_found")), mean("ms", 3)).join(n, by)


def paper_paths(candidates: DataFrame, mapping: DataFrame, expected: DataFrame, top_k: int = 10, paper_k: int = 50) -> DataFrame:
    """query_id, method, accession_hit, paper_hit, paper_recall, path_complete of sequence-to-paper retrieval.

    candidates: (method, query_id, item, rank); mapping: (item, paper, pos); expected: (query_id, items, papers), arrays. The
    method `oracle`, which takes the expected items themselves, is added. Every method has a row for every query."""
    from siltstone.operators.fusion import ranked_papers

    own = expected.select(F.lit("oracle").alias("method"), "query_id", F.posexplode(F.array_sort(F.array_distinct("items"))).alias("rank", "item")).withColumn("rank", F.col("rank") + 1)
    rows = candidates.select("method", "query_id", "item", "rank").unionByName(own).where(F.col("rank") <= top_k).withColumn("key", F.struct("method", "query_id"))
    found = rows.groupBy("method", "query_id").agg(F.collect_set("item").alias("got"))
    papers = ranked_papers(rows, mapping, "key", "item", "paper", paper_k).groupBy("key.method", "key.query_id").agg(F.collect_set("paper").alias("read"))
    every = expected.crossJoin(F.broadcast(rows.select("method").distinct()))
    both = every.join(found, ["method", "query_id"], "left").join(papers, ["method", "query_id"], "left")
    common = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
    hit, read = common("items", "got"), common("papers", "read")
    recall = F.round(F.coalesce(F.try_divide(read, F.size(F.array_distinct("papers"))), F.lit(0.0)), 6)
    return both.select("query_id", "method", (hit > 0).alias("accession_hit"), (read > 0).alias("paper_hit"), recall.alias("paper_recall"), ((hit > 0) & (read > 0)).alias("path_complete"))


#: The grid of the claim selector: candidates, rank offset, power of the inverse document frequency, claims given out.
GRID = {"candidate_k": (5, 10, 20, 50), "rank_offset": (0.0, 1.0, 5.0, 10.0, 20.0, 60.0), "idf_power": (0.0, 0.5, 1.0, 1.5, 2.0)}
OUTPUT = {"function": (1, 3, 5), "literature": (1, 3, 5, 10)}


def selector_scores(candidates: DataFrame, claims: DataFrame, df: DataFrame, n: int, expected: DataFrame, task: str, grid: dict = GRID) -> DataFrame:
    """query_id, the grid's columns, output_k, precision, recall, f1 of every configuration (360 for functions, 480 for papers).

    candidates: (query_id, item, rank); claims: (item, claim); df: (claim, df); expected: (query_id, claim). A claim scores the sum
    of idf ^ power / (offset + rank) over its candidates; ties by df, then claim. Claims of all configurations are one
    aggregate; rows grow with queries x claims x configurations, all of them needed."""
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    base = candidates.join(claims, "item").join(df, "claim", "left").select("query_id", "claim", "rank", idf.alias("idf"), F.coalesce("df", F.lit(0)).alias("df"))
    for name, values in grid.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    key = ["query_id", *grid]
    scored = base.where(F.col("rank") <= F.col("candidate_k")).groupBy(*key, "claim").agg(F.round(F.sum(F.pow("idf", "idf_power") / (F.col("rank_offset") + F.col("rank"))), 9).alias("score"), F.first("df").alias("df"))
    want = expected.select("query_id", "claim").distinct().withColumn("hit", F.lit(1))
    ranked = top(scored, key, [F.desc("score"), "df", "claim"], max(OUTPUT[task])).join(want, ["query_id", "claim"], "left")
    most = F.broadcast(expected.sparkSession.createDataFrame([(k,) for k in OUTPUT[task]], "output_k int"))
    sums = ranked.join(most, F.col("rank") <= F.col("output_k")).groupBy(*key, "output_k").agg(F.count(F.lit(1)).alias("given"), F.count("hit").alias("hits"))
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("want"))
    p, r = F.col("hits") / F.col("given"), F.coalesce(F.col("hits") / F.col("want"), F.lit(0.0))
    rows = sums.join(size, "query_id", "left").withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select(*key, "output_k", "precision", "recall", "f1")


def tuned_selector(scores: DataFrame, dev: DataFrame) -> DataFrame:
    """The configuration of the best mean f1, recall and precision on the dev queries (query_id), then the fewest claims and
    candidates, then the smallest offset and power."""
    n = dev.count()
    means = scores.join(dev.select("query_id"), "query_id", "left_semi").groupBy(*GRID, "output_k").agg(*[F.round(F.sum(m) / n, 9).alias(m) for m in ("f1", "recall", "precision")])
    return means.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "output_k", "candidate_k", "rank_offset", "idf_power").limit(1)


def modality_counts(evidence: DataFrame) -> DataFrame:
    """query_id, routes and modalities: maps of counts. evidence: (query_id, route, target)."""
    from siltstone.operators.corpus import modality

    def counted(c: Column, name: str) -> DataFrame:
        n = evidence.groupBy("query_id", c.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    return counted(F.col("route"), "routes").join(counted(modality(F.coalesce("target", F.lit("text"))), "modalities"), "query_id")


def purity_summary(rows: DataFrame) -> DataFrame:
    """One row: communities, mean, least and largest purity, and the purest community."""
    return rows.agg(F.count(F.lit(1)).alias("communities"), F.round(F.avg("purity"), 6).alias("mean_purity"), F.min("purity").alias("least_purity"), F.max("purity").alias("most_purity"), F.max_by("label", F.struct("purity", "n")).alias("top_label"))


def replicate_means(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("replicates"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def comparison(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.withColumn("condition", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def ratings(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Means by route of the reviewers' means by case. rows: (case_id, route, reviewer, fields)."""
    case = rows.groupBy("route", "case_id").agg(*[F.avg(f).alias(f) for f in fields])
    return case.groupBy("route").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(f), 6).alias(f) for f in fields])


def trace_summary(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg("edges"), 6).alias("mean_edges"), F.sum("edges").alias("edges"), F.max("depth").alias("depth"))


def coverage(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row: rows, and those that have each label (arrays)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.size(c) > 0, 1)).alias(c) for c in labels])


def answer_rows(pack: DataFrame, kind: str, go_k: int, paper_k: int) -> DataFrame:
    """Deterministic answers of a question type from ranked claims: (query_id, go_ids, pmids), abstaining without support."""
    none = F.array().cast("array<string>")
    go = F.slice(F.array_distinct("go_ranked"), 1, go_k) if kind != "literature" else none
    pm = F.slice(F.array_distinct("pmid_ranked"), 1, paper_k) if kind != "function" else none
    return pack.select("query_id", go.alias("go_ids"), pm.alias("pmids")).withColumn("abstains", (F.size("go_ids") == 0) & (F.size("pmids") == 0))


def text_control(chunks: DataFrame, limit: int) -> DataFrame:
    """Packs of a text-only control: a chunk's document once, at its first rank, with the identifiers named in its chunks.
    chunks: (query_id, document_id, rank, text)."""
    from siltstone.operators.answers import GO, PMID

    ids = lambda p: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(p), F.lit(1))))))
    docs = chunks.groupBy("query_id", "document_id").agg(F.min("rank").alias("first_rank"), ids(GO).alias("go_ids"), ids(PMID).alias("pmids"))
    return top(docs, "query_id", ["first_rank", "document_id"], limit)


def ablated(packs: DataFrame, test_ids: DataFrame, clear: bool) -> DataFrame:
    """Test packs of one route; with `clear` without their evidence arrays."""
    rows = packs.join(test_ids, "query_id", "left_semi")
    return rows.select(*[F.array().cast(t).alias(c) if clear and t.startswith("array") else F.col(c) for c, t in rows.dtypes])


def non_leaking(fragments: DataFrame, index: DataFrame, attempts: str = "attempt") -> DataFrame:
    """Each record's first query fragment that no index text holds. fragments: (record_id, attempt, query)."""
    from siltstone.operators.splits import containment

    keyed = fragments.withColumn("query_id", F.concat_ws("#", F.col("record_id").cast("string"), F.col(attempts).cast("string")))
    bad = containment(keyed.select("query_id", "query"), index).select("query_id").distinct()
    return top(keyed.join(bad, "query_id", "left_anti"), "record_id", [attempts], 1).select("record_id", attempts, "query")


def info_nce(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row: the mean of -log softmax of each anchor's own pair. pairs: (anchor, other, similarity)."""
    z = pairs.select("anchor", "other", (F.col("similarity") / temperature).alias("z"))
    top_ = z.groupBy("anchor").agg(F.max("z").alias("m"))
    own = F.sum(F.when(F.col("anchor") == F.col("other"), F.col("z")))
    each = z.join(top_, "anchor").groupBy("anchor").agg((F.first("m") + F.log(F.sum(F.exp(F.col("z") - F.col("m")))) - own).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"))


def strand_mean(forward: Column, reverse: Column) -> Column:
    """Mean of the vectors of both strands, at length 1."""
    from siltstone.operators.vectors import normalized

    return normalized(F.zip_with(forward, reverse, lambda a, b: (a + b) / 2))
