"""Deterministic answers of evidence packs, free-form prompts with a registry, and the scores of answers.

A pack is three tables: candidates (query_id, rank, accession, symbol, go_ids, pmids), papers (query_id, at, pmid) in rank order
and, where claims were ranked, claims (query_id, kind, rank, value, accessions, citation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import compact
from siltstone.operators.statistics import set_metrics

#: What identifiers, citations and abstentions look like.
GO, PMID = r"(GO:\d{7})", r"(?i)PMID\s*[:=]?\s*(\d{7,8})"
CITED, BARE = r"\[?([EPGL]\d+)\]?", r"(?<!\[)\b[EPGL]\d+\b(?!\])"
ABSTAINS = r"(?i)insufficient|cannot be (?:determined|inferred)|no supported|not enough evidence|abstain"
MECHANISM = "The retrieved evidence doesn't support a mechanism; curated or experimental evidence is needed."


def _none() -> Column:
    return F.array().cast("array<string>")


def _ranked(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """(query_id, name): values of a query as an array in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy("query_id").agg(F.transform(listed, lambda s: s["v"]).alias(name))


def answered(candidates: DataFrame, papers: DataFrame, kind: str, go_k: int = 5, paper_k: int = 10, candidate_k: int = 10) -> DataFrame:
    """query_id, go_ids, pmids, citations, abstained, text: the extractive answer to a question of a kind.

    function: the first go_k different terms of the first candidates, each cited from the candidate that it was first seen
    on; literature: the first paper_k ranked papers that a candidate supports; mechanism: always an abstention. A citation is
    `id|accession|identifier`."""
    base = candidates.select("query_id").union(papers.select("query_id")).distinct()
    if kind == "mechanism":
        return base.select("query_id", _none().alias("go_ids"), _none().alias("pmids"), _none().alias("citations"), F.lit(True).alias("abstained"), F.lit(MECHANISM).alias("text"))
    if kind == "function":
        rows = candidates.where(F.col("rank") <= candidate_k).select("query_id", "rank", "accession", F.posexplode("go_ids").alias("pos", "value"))
        first = rows.groupBy("query_id", "value").agg(F.min(F.struct("rank", "pos", "accession")).alias("at"))
        cite = F.concat_ws("|", F.concat(F.lit("E"), F.col("at.rank")), "at.accession", "value")
        most, words, none = go_k, "Terms of the retrieved candidates: ", "No term was retrieved for the first candidates."
    else:
        support = candidates.select("query_id", "rank", "accession", F.explode("pmids").alias("value")).groupBy("query_id", "value").agg(F.min(F.struct("rank", "accession")).alias("by"))
        ranked = papers.groupBy("query_id", F.col("pmid").alias("value")).agg(F.min("at").alias("at"))
        first = ranked.join(support, ["query_id", "value"]).withColumn("at", F.struct("at"))
        cite = F.concat_ws("|", "by.accession", "value")
        most, words, none = paper_k, "Papers of the retrieved candidates: ", "No supported paper was retrieved."
    listed = first.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "value", cite.alias("cite")))), 1, most).alias("l"))
    rows = base.join(listed, "query_id", "left")
    values = F.coalesce(F.transform("l", lambda s: s["value"]), _none())
    cites = F.coalesce(F.transform("l", lambda s: s["cite"]), _none())
    if kind == "literature":
        cites = F.transform(cites, lambda c, i: F.concat(F.lit("P"), i + 1, F.lit("|"), c))
    text = F.when(F.size(values) > 0, F.concat(F.lit(words), F.array_join(values, ", "), F.lit("."))).otherwise(none)
    return rows.select("query_id", *[(values if k == kind else _none()).alias(n) for k, n in (("function", "go_ids"), ("literature", "pmids"))], cites.alias("citations"), (F.size(values) == 0).alias("abstained"), text.alias("text"))


def answer_scores(answers: DataFrame, candidates: DataFrame, expected: DataFrame, kind: str) -> DataFrame:
    """query_id, citation_count, citation_support_rate, precision, recall, f1, abstained, abstention_correct of answered() rows.

    expected: (query_id, go_ids, pmids). A citation is supported if the first candidate of its accession has the identifier;
    without citations the rate is 1 for mechanism questions, else 0."""
    ids = {"function": "go_ids", "literature": "pmids"}.get(kind)
    first = candidates.groupBy("query_id", "accession").agg(F.min(F.struct("rank", "go_ids", "pmids")).alias("c"))
    cites = answers.select("query_id", F.explode(F.array_distinct("citations")).alias("cite"))
    cites = cites.select("query_id", F.split_part("cite", F.lit("|"), F.lit(2)).alias("accession"), F.split_part("cite", F.lit("|"), F.lit(3)).alias("value"))
    good = cites.join(first, ["query_id", "accession"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("citation_count"), F.sum(F.coalesce(F.array_contains(F.concat("c.go_ids", "c.pmids"), F.col("value")), F.lit(False)).cast("int")).alias("good")
    )
    want = expected.select("query_id", *[F.col(c).alias(f"want_{c}") for c in ("go_ids", "pmids")])
    rows = answers.join(want, "query_id", "left").join(good, "query_id", "left")
    metrics = [m for m in set_metrics(F.col(ids), F.coalesce(f"want_{ids}", _none()))][:3] if ids else [F.lit(0.0).alias(n) for n in ("precision", "recall", "f1")]
    rate = F.round(F.coalesce(F.col("good") / F.col("citation_count"), F.lit(1.0 if kind == "mechanism" else 0.0)), 6)
    return rows.select("query_id", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), rate.alias("citation_support_rate"), *metrics, "abstained", (F.lit(kind == "mechanism") & F.col("abstained")).alias("abstention_correct"))


def registry(candidates: DataFrame, terms: DataFrame, papers: DataFrame, candidate_k: int = 5, go_k: int = 3, paper_k: int = 3) -> DataFrame:
    """query_id, label, kind, identifier, line: what a free-form prompt may cite, C1.. candidates, G1.. terms, P1.. papers.

    candidates: (query_id, rank, accession, symbol, go_ids, pmids); terms: (go_id, name); papers: (query_id, at, pmid, title,
    year, abstract). Terms come in the order of the candidates that have them, with those candidates' labels."""
    c = candidates.where(F.col("rank") <= candidate_k).withColumn("label", F.concat(F.lit("C"), "rank"))
    lines = c.select("query_id", "label", F.lit("candidate").alias("kind"), F.col("accession").alias("identifier"), F.concat(F.lit("candidate accession="), F.coalesce("accession", F.lit("unknown")), F.lit("; symbol="), F.coalesce("symbol", F.lit("unknown")), F.lit("; a retrieved neighbour, indirect evidence")).alias("line"))
    labelled = lambda rows, k: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "label"))), lambda s: s["label"]), ",")
    g = c.select("query_id", "rank", "label", F.posexplode("go_ids").alias("pos", "go_id")).groupBy("query_id", "go_id").agg(F.min(F.struct("rank", "pos")).alias("at"), labelled(c, "go").alias("support"))
    g = _numbered(g.join(terms, "go_id", "left"), ["at", "go_id"], go_k, "G")
    go_lines = g.select("query_id", "label", F.lit("go").alias("kind"), F.col("go_id").alias("identifier"), F.concat(F.lit("candidates="), "support", F.lit(" -> "), "go_id", F.lit(" ("), F.coalesce("name", F.lit("name unavailable")), F.lit(")")).alias("line"))
    s = c.select("query_id", "rank", "label", F.explode("pmids").alias("pmid")).groupBy("query_id", "pmid").agg(labelled(c, "paper").alias("support"))
    p = _numbered(papers.join(s, ["query_id", "pmid"], "left"), ["at", "pmid"], paper_k, "P")
    abstract = F.when(F.length(compact(F.col("abstract"), 240)) > 0, F.concat(F.lit("; abstract="), compact(F.col("abstract"), 240))).otherwise("")
    paper_lines = p.select("query_id", "label", F.lit("paper").alias("kind"), F.col("pmid").alias("identifier"), F.concat(F.lit("PMID:"), "pmid", F.lit("; title="), F.coalesce("title", F.lit("title unavailable")), F.lit("; year="), F.coalesce("year", F.lit("year unavailable")), F.lit("; candidate support="), F.coalesce("support", F.lit("none")), abstract).alias("line"))
    return lines.unionByName(go_lines).unionByName(paper_lines)


def _numbered(rows: DataFrame, order: list[str], k: int, letter: str) -> DataFrame:
    from siltstone.operators.text_search import top

    return top(rows, "query_id", order, k).withColumn("label", F.concat(F.lit(letter), "rank"))


#: What a free-form note must keep to, a line each.
RULES = (
    "Write an evidence note of 150 words at most.", "Name at most two functions and three papers.", "Give each function with its GO id and cite its [G#] line.",
    "Cite each paper by its [P#] line and each candidate by its [C#] line.", "Use no GO id that has no [G#] line.", "Call every transferred function a hypothesis.", "Say so where evidence is weak or missing.",
)


def freeform_prompts(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """query_id, prompt of (query_id, query) and registry() rows; citable lines in the order C, G, P."""
    order = F.struct(F.position(F.substring("label", 1, 1), F.lit("CGP")).alias("k"), F.substring("label", 2, 9).cast("int").alias("n"), F.concat(F.lit("["), "label", F.lit("] "), "line").alias("line"))
    shown = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["line"]), "\n").alias("shown"))
    body = F.coalesce("shown", F.lit("No evidence was retrieved."))
    return queries.join(shown, "query_id", "left").select("query_id", F.concat_ws("\n", F.lit("Query sequence:"), compact(F.col("query"), 4000), F.lit("Evidence:"), body, *map(F.lit, RULES)).alias("prompt"))


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _share(part: Column, whole: Column) -> Column:
    """Share of the second array's elements that the first has; 0 where it is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(whole, part)), F.size(whole)), F.lit(0.0))


def generated_scores(outputs: DataFrame, packs: DataFrame, expected: DataFrame, default_k: int = 5) -> DataFrame:
    """13 metrics of generated answers, a row an output (id, query_id, qa_type, answer, prompt).

    packs: (query_id, citation, go_ids, pmids), what each citation of a query's pack stands for; expected: (query_id, go_ids,
    pmids). Retrievable scores count only expected identifiers that the prompt shows before `Query:`; evidence selection
    compares with the first k of these, k as the prompt asks; entailment is the share of named identifiers that a cited line has;
    hallucination the share that no line of the pack has. Mechanism questions score by abstention."""
    known = packs.groupBy("query_id").agg(F.collect_set("citation").alias("known"), F.array_distinct(F.flatten(F.collect_list("go_ids"))).alias("pack_go"), F.array_distinct(F.flatten(F.collect_list("pmids"))).alias("pack_pm"), F.collect_list(F.struct("citation", "go_ids", "pmids")).alias("lines"))
    want = expected.select("query_id", F.col("go_ids").alias("want_go"), F.col("pmids").alias("want_pm"))
    region = F.coalesce(F.nullif(F.regexp_extract("answer", r"(?s)(?:^|\n)CITATIONS:\s*(.*)$", 1), F.lit("")), F.col("answer"))
    shown = F.split_part("prompt", F.lit("Query:"), F.lit(1))
    asked = F.coalesce(F.nullif(F.regexp_extract("prompt", r"(?:Return at most|Copy the first) (\d+)", 1), F.lit("")).cast("int"), F.lit(default_k))
    rows = outputs.join(known, "query_id", "left").join(want, "query_id", "left").select(
        "id", "query_id", "qa_type", "answer", region.alias("region"), asked.alias("k"), F.col("answer").rlike(ABSTAINS).alias("abstains"), _found(F.col("answer"), GO).alias("p_go"), _found(F.col("answer"), PMID).alias("p_pm"), _found(shown, GO).alias("s_go"), _found(shown, PMID).alias("s_pm"),
        *[F.coalesce(c, _none()).alias(c) for c in ("known", "pack_go", "pack_pm", "want_go", "want_pm")], F.col("lines"),
    )
    rows = rows.withColumn("cites", _found(F.col("region"), CITED))
    cited = lambda field: F.coalesce(F.flatten(F.transform(F.filter("lines", lambda x: F.array_contains(F.col("cites"), x["citation"])), lambda x: x[field])), _none())
    function, mechanism = F.col("qa_type") == "function", F.col("qa_type") == "mechanism"
    by = lambda go, pm: F.when(function, F.col(go)).otherwise(F.col(pm))
    rows = rows.select("id", "query_id", "qa_type", "answer", "region", "k", "abstains", "cites", "known", by("p_go", "p_pm").alias("named"), by("s_go", "s_pm").alias("seen"), by("want_go", "want_pm").alias("want"), by("pack_go", "pack_pm").alias("pack"), F.when(function, cited("go_ids")).otherwise(cited("pmids")).alias("cited"), "p_go", "p_pm", "pack_go", "pack_pm")
    held = F.array_intersect("want", "seen")
    score = lambda p, e: set_metrics(p, e)[:3]
    off = lambda c: F.when(mechanism, F.lit(0.0)).otherwise(c)
    p, r, f1 = (off(c) for c in score(F.col("named"), F.col("want")))
    rp, rr, rf = (off(c) for c in score(F.col("named"), held))
    nothing = (F.size("p_go") == 0) & (F.size("p_pm") == 0)
    outside = lambda ids, pack: F.coalesce(F.try_divide(F.size(F.array_except(ids, pack)), F.size(F.col(ids))), F.lit(0.0))
    entailed = F.when(mechanism, (F.col("abstains") & nothing).cast("double")).when((F.size("named") == 0) & F.col("abstains"), 1.0).otherwise(_share(F.col("cited"), F.col("named")))
    lost = F.when(mechanism, F.least(F.lit(1.0), outside("p_go", F.col("pack_go")) + outside("p_pm", F.col("pack_pm")))).otherwise(outside("named", F.col("pack")))
    valid = F.when(F.size("cites") > 0, F.size(F.array_intersect("cites", "known")) / F.size("cites")).otherwise(F.col("abstains").cast("double"))
    bare = F.size(F.regexp_extract_all("region", F.lit(f"({BARE})"), F.lit(1)))
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return rows.select(
        "id", "query_id", "qa_type", rounded(p, "answer_precision"), rounded(r, "answer_recall"), rounded(f1, "answer_f1"), rounded(rp, "retrievable_precision"), rounded(rr, "retrievable_recall"), rounded(rf, "retrievable_f1"),
        rounded(off(_share(F.col("seen"), F.col("want"))), "prompt_gold_recall"), rounded(off(set_metrics(F.col("named"), F.slice("seen", F.lit(1), F.col("k")))[2]), "evidence_selection_f1"), rounded(valid, "citation_validity"), rounded(entailed, "citation_entailment"), rounded(lost, "hallucination_rate"),
        (mechanism & F.col("abstains")).alias("abstention_correct"), (F.col("abstains") & (mechanism | (F.size("seen") == 0))).alias("evidence_aware_abstention"), F.col("answer").rlike(r"^ANSWER:[^\n]*\nCITATIONS:[^\n]*\s*$").alias("format_compliance"), (F.col("abstains") | (F.size("cites") > 0) & (bare == 0)).alias("citation_syntax"),
    )
