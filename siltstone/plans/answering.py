"""Queries over evidence packs: suppliers ask, their parts are the candidates, parts carry terms and papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import answering, answers, evaluation
from siltstone.operators.text_search import top
from siltstone.plans.catalog import query

_PACK = """
WITH tot AS (SELECT l_suppkey AS query_id, l_partkey AS item, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
cand AS (SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY q DESC, item) AS INTEGER) AS rank FROM tot QUALIFY rank <= 10),
pk AS (SELECT query_id, rank, 'ACC' || p_partkey AS accession, p_brand AS symbol,
 ['GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0'), 'GO:' || lpad(CAST(1000 + p_partkey % 37 AS VARCHAR), 7, '0')] AS go_ids,
 [CAST(1000000 + p_partkey % 211 AS VARCHAR), CAST(1000000 + p_partkey * 7 % 211 AS VARCHAR)] AS pmids FROM cand JOIN part ON item = p_partkey),
px AS (SELECT query_id, rank, accession, unnest(pmids) AS pmid, unnest([0, 1]) AS pos FROM pk),
papers AS (SELECT query_id, pmid, min(rank * 10 + pos) AS pl FROM px GROUP BY 1, 2 UNION ALL SELECT DISTINCT query_id, '9999999', 0 FROM pk),
ex AS (SELECT s_suppkey AS query_id, list_transform(range(1, 9), lambda i: 'GO:' || lpad(CAST(s_nationkey + i AS VARCHAR), 7, '0')) AS go_ids,
 [CAST(1000000 + s_suppkey % 211 AS VARCHAR), CAST(1000000 + s_suppkey * 3 % 211 AS VARCHAR)] AS pmids FROM supplier),
gx AS (SELECT query_id, rank, accession, unnest(go_ids) AS value, unnest([0, 1]) AS pos FROM pk),
g1 AS (SELECT query_id, value, min(rank * 10 + pos) AS pl, arg_min(accession, rank * 10 + pos) AS acc, min(rank) AS r FROM gx GROUP BY 1, 2)
"""
_ANSWERS = """,
fn AS (SELECT query_id, value, 'E' || r || '|' || acc || '|' || value AS cite, acc, row_number() OVER (PARTITION BY query_id ORDER BY pl, value) AS n FROM g1 QUALIFY n <= 5),
sp AS (SELECT query_id, pmid, arg_min(accession, rank) AS acc FROM px GROUP BY 1, 2),
ln AS (SELECT query_id, pmid AS value, acc, row_number() OVER (PARTITION BY query_id ORDER BY pl, pmid) AS n FROM papers JOIN sp USING (query_id, pmid) QUALIFY n <= 10)
"""


def candidates(t):
    sold = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("q"))
    go = lambda c: F.concat(F.lit("GO:"), F.lpad(c.cast("string"), 7, "0"))
    key = F.col("p_partkey")
    pm = lambda c: (F.lit(1000000) + c % 211).cast("string")
    part = t.part.select(key.alias("item"), F.concat(F.lit("ACC"), key).alias("accession"), F.col("p_brand").alias("symbol"), F.array(go(F.col("p_size")), go(1000 + key % 37)).alias("go_ids"), F.array(pm(key), pm(key * 7)).alias("pmids"))
    return top(sold, "query_id", [F.desc("q"), "item"], 10).join(part, "item").select("query_id", "rank", "accession", "symbol", "go_ids", "pmids")


def papers(t):
    c = candidates(t)
    each = c.select("query_id", "rank", F.posexplode("pmids").alias("pos", "pmid")).groupBy("query_id", "pmid").agg(F.min(F.col("rank") * 10 + F.col("pos")).alias("at"))
    return each.select("query_id", "pmid", "at").unionByName(c.select("query_id", F.lit("9999999").alias("pmid"), F.lit(0).alias("at")).distinct())


def expected(t):
    go = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("GO:"), F.lpad((F.col("s_nationkey") + i).cast("string"), 7, "0")))
    pm = lambda c: (F.lit(1000000) + c % 211).cast("string")
    return t.supplier.select(F.col("s_suppkey").alias("query_id"), go.alias("go_ids"), F.array(pm(F.col("s_suppkey")), pm(F.col("s_suppkey") * 3)).alias("pmids"))


KINDS = ("function", "literature", "mechanism")


@query(_PACK + _ANSWERS + """SELECT query_id, 'function' AS kind, string_agg(value, ',' ORDER BY n) AS ids, string_agg(cite, ';' ORDER BY n) AS citations, false AS abstained,
 'Terms of the retrieved candidates: ' || string_agg(value, ', ' ORDER BY n) || '.' AS text FROM fn GROUP BY query_id
UNION ALL SELECT query_id, 'literature', string_agg(value, ',' ORDER BY n), string_agg('P' || n || '|' || acc || '|' || value, ';' ORDER BY n), false, 'Papers of the retrieved candidates: ' || string_agg(value, ', ' ORDER BY n) || '.' FROM ln GROUP BY query_id
UNION ALL SELECT DISTINCT query_id, 'mechanism', '', '', true, 'The retrieved evidence doesn''t support a mechanism; curated or experimental evidence is needed.' FROM pk""")
def qa_answers(t):
    """Extractive answers of all three question types."""
    out = None
    for kind in KINDS:
        a = answering.answered(candidates(t), papers(t), kind)
        a = a.select("query_id", F.lit(kind).alias("kind"), F.array_join(F.concat("go_ids", "pmids"), ",").alias("ids"), F.array_join("citations", ";").alias("citations"), "abstained", "text")
        out = a if out is None else out.unionByName(a)
    return out


_SETS = """,
sc AS (SELECT 'function' AS kind, p.query_id, p.vs, e.go_ids AS es, p.n FROM (SELECT query_id, list(value) AS vs, count(*) AS n FROM fn GROUP BY 1) p JOIN ex e USING (query_id)
 UNION ALL SELECT 'literature', p.query_id, p.vs, e.pmids, p.n FROM (SELECT query_id, list(value) AS vs, count(*) AS n FROM ln GROUP BY 1) p JOIN ex e USING (query_id)),
sm AS (SELECT *, len(list_intersect(vs, list_distinct(es))) AS hit, len(list_distinct(es)) AS ne FROM sc)
"""


@query(_PACK + _ANSWERS + _SETS + """SELECT query_id, kind, CAST(n AS INTEGER) AS citation_count, 1.0::DOUBLE AS citation_support_rate, round(hit / n, 6) AS precision, round(hit / ne, 6) AS recall, round(2.0 * hit / (n + ne), 6) AS f1, false AS abstained, false AS abstention_correct FROM sm
UNION ALL SELECT DISTINCT query_id, 'mechanism', 0, 1.0, 0.0, 0.0, 0.0, true, true FROM pk""")
def answer_scores(t):
    """Scores of the extractive answers against each supplier's expected identifiers."""
    out = None
    for kind in KINDS:
        a = answering.answer_scores(answering.answered(candidates(t), papers(t), kind), candidates(t), expected(t), kind).withColumn("kind", F.lit(kind))
        out = a if out is None else out.unionByName(a)
    return out


_REGISTRY = """,
lab AS (SELECT * FROM pk WHERE rank <= 5),
lg AS (SELECT query_id, rank, unnest(go_ids) AS go_id, unnest([0, 1]) AS pos FROM lab),
gg AS (SELECT query_id, go_id, min(rank * 10 + pos) AS pl, array_to_string(list_transform(list_sort(list(DISTINCT rank)), lambda r: 'C' || r), ',') AS support FROM lg GROUP BY 1, 2),
gr AS (SELECT query_id, go_id, support, row_number() OVER (PARTITION BY query_id ORDER BY pl, go_id) AS n FROM gg QUALIFY n <= 3),
lp AS (SELECT query_id, rank, unnest(pmids) AS pmid FROM lab),
sup AS (SELECT query_id, pmid, array_to_string(list_transform(list_sort(list(DISTINCT rank)), lambda r: 'C' || r), ',') AS support FROM lp GROUP BY 1, 2),
pr AS (SELECT p.query_id, p.pmid, support, row_number() OVER (PARTITION BY p.query_id ORDER BY pl, p.pmid) AS n FROM papers p LEFT JOIN sup USING (query_id, pmid) QUALIFY n <= 3),
reg AS (SELECT query_id, 1 AS k, rank AS n, 'C' || rank AS label, 'candidate' AS kind, accession AS identifier, 'candidate accession=' || accession || '; symbol=' || symbol || '; a retrieved neighbour, indirect evidence' AS line FROM lab
 UNION ALL SELECT query_id, 2, n, 'G' || n, 'go', go_id, 'candidates=' || support || ' -> ' || go_id || ' (' || coalesce(nm, 'name unavailable') || ')' FROM gr LEFT JOIN (SELECT 'GO:' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS go_id, n_name AS nm FROM nation) USING (go_id)
 UNION ALL SELECT query_id, 3, n, 'P' || n, 'paper', pmid, 'PMID:' || pmid || '; title=' || coalesce('Paper ' || pmid, '') || '; year=' || CASE WHEN CAST(pmid AS BIGINT) % 3 = 0 THEN 'year unavailable' ELSE CAST(1990 + CAST(pmid AS BIGINT) % 30 AS VARCHAR) END || '; candidate support=' || coalesce(support, 'none') ||
  CASE WHEN CAST(pmid AS BIGINT) % 2 = 0 THEN '; abstract=About ' || pmid ELSE '' END FROM pr)
"""


def _registry(t):
    terms = t.nation.select(F.concat(F.lit("GO:"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0")).alias("go_id"), F.col("n_name").alias("name"))
    n = F.col("pmid").cast("long")
    read = papers(t).withColumn("title", F.concat(F.lit("Paper "), "pmid")).withColumn("year", F.when(n % 3 != 0, (1990 + n % 30).cast("string"))).withColumn("abstract", F.when(n % 2 == 0, F.concat(F.lit(" About\n"), "pmid")))
    return answering.registry(candidates(t), terms, read)


@query(_PACK + _REGISTRY + "SELECT query_id, label, kind, identifier, line FROM reg")
def evidence_registry(t):
    """What a free-form prompt may cite."""
    return _registry(t)


@query(_PACK + _REGISTRY + f"""SELECT s_suppkey AS query_id, 'Query sequence:' || chr(10) || s_name || chr(10) || 'Evidence:' || chr(10) || coalesce(shown, 'No evidence was retrieved.') || chr(10) || '{chr(10).join(answering.RULES)}' AS prompt
 FROM supplier LEFT JOIN (SELECT query_id, string_agg('[' || label || '] ' || line, chr(10) ORDER BY k, n) AS shown FROM reg GROUP BY query_id) ON query_id = s_suppkey""")
def freeform_prompts(t):
    """Free-form prompts of all suppliers."""
    return answering.freeform_prompts(t.supplier.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query")), _registry(t))


# Generated answers: per supplier one of each kind, its form set by the supplier's number.
_GENERATED = """,
shown AS (SELECT query_id, array_to_string(list(go_ids[1] ORDER BY rank), ' ') AS gos, array_to_string(list('PMID:' || pmids[1] ORDER BY rank), ' ') AS pms FROM pk WHERE rank <= 4 GROUP BY 1),
o AS (SELECT query_id * 3 + k AS id, query_id, ['function', 'literature', 'mechanism'][k + 1] AS qa_type, query_id % 5 AS form, k,
 ['GO:' || lpad(CAST(query_id % 50 + 1 AS VARCHAR), 7, '0'), 'GO:' || lpad(CAST(query_id % 25 + 3 AS VARCHAR), 7, '0')] AS ng, [CAST(1000000 + query_id % 211 AS VARCHAR), '1234567'] AS np,
 CASE WHEN query_id % 2 = 0 THEN [] ELSE string_split(CASE k WHEN 0 THEN gos ELSE replace(pms, 'PMID:', '') END, ' ') END AS seen0, query_id % 2 = 0 AS hidden FROM shown, range(0, 3) AS r(k)),
a AS (SELECT *, list_filter(seen0, lambda x, i: list_position(seen0, x) = i) AS seen, form = 4 AS abstains, CASE WHEN form = 4 THEN [] ELSE ng END AS p_go, CASE WHEN form = 4 THEN [] ELSE np END AS p_pm,
 CASE form WHEN 0 THEN ['E1', 'E2'] WHEN 1 THEN ['E1', 'E99'] WHEN 2 THEN ['E3'] WHEN 3 THEN [] ELSE [] END AS cites FROM o)
"""


def _outputs(t):
    go = lambda c: F.concat(F.lit("GO:"), F.lpad(c.cast("string"), 7, "0"))
    q = F.col("query_id")
    first = candidates(t).where("rank <= 4").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("go_ids")[0].alias("g"), F.concat(F.lit("PMID:"), F.col("pmids")[0]).alias("p")))).alias("l"))
    rows = first.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("form", q % 5)
    named = F.concat(go(q % 50 + 1), F.lit(" and "), go(q % 25 + 3), F.lit("; PMID "), (1000000 + q % 211).cast("string"), F.lit(", PMID:1234567"))
    cites = F.when(F.col("form") == 0, "[E1] [E2]").when(F.col("form") == 1, "[E1], E99").when(F.col("form") == 2, "[E3]").otherwise("none")
    answer = F.when(F.col("form") == 4, F.lit("ANSWER: There is insufficient evidence.\nCITATIONS: none")).when(F.col("form") == 2, F.concat(F.lit("I think "), named, F.lit("\nCITATIONS: "), cites)).otherwise(F.concat(F.lit("ANSWER: "), named, F.lit("\nCITATIONS: "), cites))
    shown = F.when(q % 2 == 0, "").otherwise(F.array_join(F.transform("l", lambda s: F.when(F.col("k") == 0, s["g"]).otherwise(s["p"])), " "))
    prompt = F.concat(F.lit("Return at most 2 items. "), shown, F.lit("\nQuery: GO:9999999"))
    return rows.select((q * 3 + F.col("k")).alias("id"), "query_id", F.array(*map(F.lit, KINDS))[F.col("k")].alias("qa_type"), answer.alias("answer"), prompt.alias("prompt"))


@query(_PACK + _GENERATED + """,
kn AS (SELECT query_id, list('E' || rank) AS known, list_distinct(flatten(list(go_ids))) AS pack_go, list_distinct(flatten(list(pmids))) AS pack_pm FROM pk GROUP BY 1),
ci AS (SELECT id, list_distinct(flatten(list(CASE WHEN qa_type = 'function' THEN p.go_ids ELSE p.pmids END))) AS cited FROM a JOIN pk p ON p.query_id = a.query_id AND list_contains(a.cites, 'E' || p.rank) GROUP BY 1),
z AS (SELECT a.*, known, pack_go, pack_pm, coalesce(cited, []) AS cited, CASE WHEN k = 0 THEN list_distinct(p_go) ELSE p_pm END AS named, list_distinct(CASE WHEN k = 0 THEN e.go_ids ELSE e.pmids END) AS want, CASE WHEN k = 0 THEN pack_go ELSE pack_pm END AS pack
 FROM a JOIN kn USING (query_id) JOIN ex e USING (query_id) LEFT JOIN ci USING (id)),
y AS (SELECT *, len(named) AS n, len(want) AS w, len(list_intersect(named, want)) AS h, len(list_intersect(want, seen)) AS hw, len(list_intersect(named, list_intersect(want, seen))) AS hh, len(seen[:2]) AS ns, len(list_intersect(named, seen[:2])) AS hs,
 len(list_intersect(named, cited)) AS hc, len(list_intersect(named, pack)) AS hp, len(list_intersect(list_distinct(p_go), pack_go)) AS hg, len(list_intersect(p_pm, pack_pm)) AS hm, len(list_distinct(p_go)) AS ngo, len(p_pm) AS npm FROM z)
SELECT id, query_id, qa_type, CASE WHEN k = 2 OR n = 0 THEN 0.0 ELSE round(h / n, 6) END AS answer_precision, CASE WHEN k = 2 THEN 0.0 ELSE round(h / w, 6) END AS answer_recall, CASE WHEN k = 2 THEN 0.0 ELSE round(2.0 * h / (n + w), 6) END AS answer_f1,
 CASE WHEN k = 2 OR n = 0 THEN 0.0 ELSE round(hh / n, 6) END AS retrievable_precision, CASE WHEN k = 2 OR hw = 0 THEN 0.0 ELSE round(hh / hw, 6) END AS retrievable_recall, CASE WHEN k = 2 OR n + hw = 0 THEN 0.0 ELSE round(2.0 * hh / (n + hw), 6) END AS retrievable_f1,
 CASE WHEN k = 2 THEN 0.0 ELSE round(hw / w, 6) END AS prompt_gold_recall, CASE WHEN k = 2 OR n + ns = 0 THEN 0.0 ELSE round(2.0 * hs / (n + ns), 6) END AS evidence_selection_f1,
 CASE WHEN len(cites) > 0 THEN round(len(list_intersect(cites, known)) / len(cites), 6) WHEN abstains THEN 1.0 ELSE 0.0 END AS citation_validity,
 CASE WHEN k = 2 THEN CASE WHEN abstains THEN 1.0 ELSE 0.0 END WHEN n = 0 THEN 1.0 ELSE round(hc / n, 6) END AS citation_entailment,
 CASE WHEN n = 0 THEN 0.0 WHEN k = 2 THEN round(least(1.0, (ngo - hg) / ngo + (npm - hm) / npm), 6) ELSE round((n - hp) / n, 6) END AS hallucination_rate,
 k = 2 AND abstains AS abstention_correct, abstains AND (k = 2 OR len(seen) = 0) AS evidence_aware_abstention, form <> 2 AS format_compliance, abstains OR (len(cites) > 0 AND form <> 1) AS citation_syntax FROM y""")
def generated_scores(t):
    """All metrics of generated answers in five forms, good and bad ones."""
    packs = candidates(t).select("query_id", F.concat(F.lit("E"), "rank").alias("citation"), "go_ids", "pmids")
    return answering.generated_scores(_outputs(t), packs, expected(t))


@query(_PACK + """, ch AS (SELECT query_id, CAST(substr(accession, 4) AS BIGINT) % 7 AS document_id, rank, 'has ' || go_ids[1] || ' and PMID: ' || pmids[2] AS text, go_ids[1] AS g, pmids[2] AS p FROM pk),
 d AS (SELECT query_id, document_id, min(rank) AS first_rank, array_to_string(list_sort(list(DISTINCT g)), ',') AS go_ids, array_to_string(list_sort(list(DISTINCT p)), ',') AS pmids FROM ch GROUP BY 1, 2)
SELECT query_id, document_id, first_rank, go_ids, pmids, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_rank, document_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 4""")
def text_control_packs(t):
    """Packs of the text-only control from chunks that name identifiers."""
    chunks = candidates(t).select("query_id", (F.substring("accession", 4, 20).cast("long") % 7).alias("document_id"), "rank", F.concat(F.lit("has "), F.col("go_ids")[0], F.lit(" and PMID: "), F.col("pmids")[1]).alias("text"))
    got = evaluation.text_control(chunks, 4)
    return got.select("query_id", "document_id", "first_rank", F.array_join("go_ids", ",").alias("go_ids"), F.array_join("pmids", ",").alias("pmids"), "rank")


@query(_PACK + """, x AS (SELECT query_id AS id, list_distinct(list(go_ids[2])) AS p FROM pk GROUP BY 1), y AS (SELECT id, p, go_ids AS e, len(list_intersect(p, go_ids)) AS h FROM x JOIN ex ON query_id = id)
SELECT id, round(h / len(p), 6) AS precision, round(h / len(e), 6) AS recall, round(2.0 * h / (len(p) + len(e)), 6) AS f1, h > 0 AS hit FROM y""")
def identifier_f1(t):
    """Identifiers named in a text against the expected ones."""
    said = candidates(t).groupBy(F.col("query_id").alias("id")).agg(F.concat_ws(" / ", F.collect_list(F.col("go_ids")[1])).alias("answer"))
    return answers.identifier_scores(said.join(expected(t).withColumnRenamed("query_id", "id"), "id"), "answer", "go_ids", answers.GO)


@query(_PACK + """SELECT query_id, rank, accession, symbol, 0 AS n_go, 0 AS n_pm, 'cleared' AS kind FROM pk WHERE query_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT query_id, rank, accession, symbol, 2, 2, 'kept' FROM pk WHERE query_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def ablated_packs(t):
    """Packs of the test queries (suppliers in credit), with and without their evidence."""
    test = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("query_id"))
    rows = lambda clear, kind: evaluation.ablated(candidates(t), test, clear).select("query_id", "rank", "accession", "symbol", F.size("go_ids").alias("n_go"), F.size("pmids").alias("n_pm"), F.lit(kind).alias("kind"))
    return rows(True, "cleared").unionByName(rows(False, "kept"))


_REVIEWS = """
rv AS (SELECT l_orderkey AS case_id, l_linenumber AS variant_id, r AS reviewer, CAST(l_quantity AS INTEGER) % 5 AS accuracy, (l_linenumber + r) % 5 AS clarity, l_shipmode_ AS route
 FROM (SELECT *, ['blast', 'vector', 'graph'][CAST((l_orderkey + l_linenumber) % 3 AS INTEGER) + 1] AS l_shipmode_ FROM lineitem), range(0, 2) AS x(r))
"""


def _reviews(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("variant_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("reviewer"), (F.col("l_quantity").cast("int") % 5).alias("accuracy"))
    r = r.withColumn("clarity", (F.col("variant_id") + F.col("reviewer")) % 5)
    route = F.array(F.lit("blast"), F.lit("vector"), F.lit("graph"))[((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int")]
    key = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("variant_id"), route.alias("route")).distinct()
    return answers.decoded(r, key)


@query("WITH" + _REVIEWS + "SELECT case_id, variant_id, CAST(reviewer AS INTEGER) AS reviewer, accuracy, CAST(clarity AS INTEGER) AS clarity, route FROM rv")
def decoded_reviews(t):
    """Blinded ratings with their routes."""
    return _reviews(t)


@query("WITH" + _REVIEWS + ", c AS (SELECT route, case_id, avg(accuracy) AS a, avg(clarity) AS b FROM rv GROUP BY 1, 2) SELECT route, count(*) AS cases, round(avg(a), 6) AS accuracy, round(avg(b), 6) AS clarity FROM c GROUP BY route")
def review_ratings(t):
    """Means by route of the means by case."""
    return evaluation.ratings(_reviews(t), ["accuracy", "clarity"])


@query("WITH" + _REVIEWS + "SELECT route, count(*) AS cases, round(avg(CAST(accuracy >= 3 AS INTEGER)), 6) AS good, round(avg(clarity), 6) AS clarity FROM rv GROUP BY route")
def route_review(t):
    """Means by route, booleans as shares."""
    return answers.route_summary(_reviews(t).withColumn("good", F.col("accuracy") >= 3), ["good", "clarity"])


@query(_PACK + """, m AS (SELECT query_id, go_ids[1] AS go, count(*) AS n FROM pk GROUP BY 1, 2), r AS (SELECT query_id, max(CASE WHEN list_contains(ex.go_ids, go) THEN 1 ELSE 0 END) AS hit FROM m JOIN ex USING (query_id) GROUP BY 1),
 s AS (SELECT query_id, CASE WHEN rank <= 5 THEN 'head' ELSE 'tail' END AS method, avg(CASE WHEN list_contains(ex.go_ids, pk.go_ids[1]) THEN 1.0 ELSE 0.0 END) AS precision FROM pk JOIN ex USING (query_id) GROUP BY 1, 2)
SELECT method, count(*) AS queries, round(avg(precision), 6) AS precision FROM s JOIN r USING (query_id) WHERE hit = 1 GROUP BY method""")
def selector_conditional(t):
    """Precision of the packs' head and tail where the oracle finds a term."""
    rows = candidates(t).join(expected(t).select("query_id", F.col("go_ids").alias("want")), "query_id").withColumn("good", F.array_contains("want", F.col("go_ids")[0]))
    oracle = rows.groupBy("query_id").agg(F.max("good").alias("hit"))
    per = rows.groupBy("query_id", F.when(F.col("rank") <= 5, "head").otherwise("tail").alias("method")).agg(F.avg(F.col("good").cast("double")).alias("precision"))
    return evaluation.conditional(per, oracle, "method", ["precision"])


@query(_PACK + """, l AS (SELECT query_id, list(v ORDER BY rank, pos) AS vs FROM (SELECT query_id, rank, unnest(pmids) AS v, unnest([0, 1]) AS pos FROM pk) GROUP BY 1),
 u AS (SELECT query_id, list_filter(vs, lambda x, i: list_position(vs, x) = i) AS o FROM l) SELECT query_id, array_to_string(o[:6], ',') AS pmids, CAST(len(o) AS INTEGER) AS n FROM u""")
def ordered_evidence(t):
    """Papers of a pack in order of first occurrence."""
    listed = candidates(t).groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmids"))), lambda s: s["pmids"])).alias("ids"))
    return listed.select("query_id", F.array_join(answers.ordered_ids(F.col("ids"), 6), ",").alias("pmids"), F.size(answers.ordered_ids(F.col("ids"), 1 << 30)).alias("n"))


@query(_PACK + """, l AS (SELECT query_id, list(accession ORDER BY rank) AS c, list_distinct(list(go_ids[1])) AS g0, list(pmids[1] ORDER BY rank) AS p FROM pk GROUP BY 1), lg AS (SELECT *, list_sort(g0) AS g FROM l),
 q AS (SELECT s_suppkey AS query_id, 'What of ' || s_name || '?' AS question, c, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE g END AS g, p FROM supplier JOIN lg ON query_id = s_suppkey),
 k AS (SELECT q.*, kind, mode FROM q, (VALUES ('function'), ('literature'), ('mechanism')) AS a(kind), (VALUES ('raw'), ('ranked'), ('none')) AS b(mode))
SELECT query_id, kind, mode, 'Task: ' || kind || '. Reply as JSON with "answer", "citations" and "abstain".' || chr(10) || question || chr(10) || CASE WHEN mode = 'none' OR (kind <> 'literature' AND len(g) = 0) THEN 'No supported evidence: abstain.'
 ELSE CASE WHEN mode = 'raw' THEN array_to_string(c, ', ') || chr(10) ELSE '' END || array_to_string(g, ', ') || chr(10) || array_to_string(p, ', ') END AS prompt FROM k""")
def qa_prompts(t):
    """Prompts by question type and evidence mode."""
    c = candidates(t)
    in_order = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("rank", v.alias("v")))), lambda s: s["v"])
    rows = c.groupBy("query_id").agg(in_order(F.col("accession")).alias("candidates"), F.array_sort(F.collect_set(F.col("go_ids")[0])).alias("g"), in_order(F.col("pmids")[0]).alias("papers"))
    q = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("What of "), "s_name", F.lit("?")).alias("question"))
    packs = rows.join(q, "query_id").withColumn("go_ids", F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("g")))
    out = None
    for kind in KINDS:
        for mode in ("raw", "ranked", "none"):
            part = answers.prompts(packs, kind, mode).withColumn("kind", F.lit(kind)).withColumn("mode", F.lit(mode))
            out = part if out is None else out.unionByName(part)
    return out
