"""Answer packs, prompts, and audits of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import compact
from siltstone.operators.statistics import set_metrics

SECTIONS = ("Conclusion", "Evidence", "Limitations")
CITATION, GO, PMID, BRACKET = r"\[([CGP]\d+)\]", r"(GO:\d{7})", r"PMID:?\s*(\d+)", r"\[([^\]]*)\]"
HEDGES = r"(?i)\b(may|might|could|suggests?|likely|possibly|uncertain)\b"
OVERCLAIMS = r"(?i)\b(proves?|definitely|certainly|undoubtedly|always|never)\b"
ABSTENTIONS = r"(?i)\b(insufficient evidence|cannot be determined|not enough evidence|no supported evidence)\b"


def answer_packs(queries: DataFrame, cited: DataFrame, paths: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row a query: citations and paths as ordered arrays, active views, an extractive answer and a prompt.

    cited: (query_id, citation, route, title, text); paths: (query_id, path, source_name, relation_type, target_name)."""
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int")
    cites = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(number("citation").alias("n"), "citation", "route", "title", "text"))).alias("citations"), F.array_sort(F.collect_set("route")).alias("routes"))
    lines = paths.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(number("path").alias("n"), F.concat(F.lit("["), "path", F.lit("] "), "source_name", F.lit(" --"), "relation_type", F.lit("--> "), "target_name").alias("line")))).alias("paths"))
    rows = queries.join(cites, "query_id", "left").join(lines, "query_id", "left").join(coverage, "query_id", "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    lines_of = F.transform(F.coalesce("paths", F.array().cast("array<struct<n:int,line:string>>")), lambda p: p["line"])
    head = F.concat(F.lit("Evidence for: "), "query", F.lit(" ("), n.cast("string"), F.lit(" items from "), F.array_join("routes", ", "), F.lit(")"))
    shown = F.transform(F.slice("citations", 1, 4), lambda c: F.concat(F.lit("["), c["citation"], F.lit("] "), c["title"], F.lit(": "), compact(c["text"], 220)))
    answer = F.when(n > 0, F.concat_ws("\n", head, F.when(F.size(lines_of) > 0, F.concat(F.lit("Graph relations: "), F.size(lines_of).cast("string"))), F.concat(F.lit("Coverage: "), F.col("coverage").cast("string")), F.array_join(shown, "\n"))).otherwise(F.lit("No local evidence was found."))
    evidence = F.transform("citations", lambda c: F.concat(F.lit("["), c["citation"], F.lit("] "), c["title"], F.lit(" (route "), c["route"], F.lit(")\n"), c["text"]))
    prompt = F.concat_ws("\n\n", F.lit("Answer from the evidence only and cite every claim like [E1]; say what is missing."), F.concat(F.lit("Question: "), "query"), F.when(n > 0, F.array_join(evidence, "\n")).otherwise("No evidence."), F.when(F.size(lines_of) > 0, F.array_join(lines_of, "\n")))
    return rows.select("query_id", "query", n.alias("n_citations"), F.size(lines_of).alias("n_paths"), "routes", answer.alias("answer"), prompt.alias("prompt"))


def prompts(packs: DataFrame, kind: str, mode: str) -> DataFrame:
    """query_id, prompt from (query_id, question, candidates, go_ids, papers arrays): by question type (function,
    literature, mechanism) and evidence mode (raw, ranked, none). Without support it asks for an abstention."""
    need = {"function": F.size("go_ids") > 0, "literature": F.size("papers") > 0, "mechanism": (F.size("go_ids") > 0) & (F.size("papers") > 0)}[kind]
    shown = {"raw": F.array("candidates", "go_ids", "papers"), "ranked": F.array("go_ids", "papers"), "none": F.array().cast("array<array<string>>")}[mode]
    body = F.array_join(F.transform(shown, lambda a: F.array_join(a, ", ")), "\n")
    ask = F.lit(f'Task: {kind}. Reply as JSON with "answer", "citations" and "abstain".')
    return packs.select("query_id", F.concat_ws("\n", ask, F.col("question"), F.when(need & F.lit(mode != "none"), body).otherwise(F.lit("No supported evidence: abstain."))).alias("prompt"))


def ordered_ids(items: Column, limit: int) -> Column:
    """Different ids in order of first occurrence."""
    return F.slice(F.array_distinct(items), 1, limit)


def extracted(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def audit(answers: DataFrame, registry: DataFrame) -> DataFrame:
    """Citation validity, citation syntax, entailment, format, calibration, overclaiming and abstention of answers (id,
    answer); registry: (id, citation, identifier) has the evidence that each answer was given."""
    known = registry.groupBy("id").agg(F.collect_set("citation").alias("known"), F.collect_set(F.concat_ws(" ", "identifier", "citation")).alias("pairs"), F.collect_set("identifier").alias("given"))
    rows = answers.join(known, "id", "left").withColumn("cites", extracted(F.col("answer"), CITATION)).withColumn("claims", F.regexp_extract_all("answer", F.lit(r"((?:GO:\d{7}|PMID:?\s*\d+)[^\[\n.;]{0,80}\[[CGP]\d+\])"), F.lit(1)))
    none = F.array().cast("array<string>")
    pairs = F.transform("claims", lambda c: F.concat_ws(" ", F.coalesce(F.nullif(F.regexp_extract(c, GO, 1), F.lit("")), F.regexp_extract(c, PMID, 1)), F.regexp_extract(c, CITATION, 1)))
    named = F.array_union(extracted(F.col("answer"), GO), extracted(F.col("answer"), PMID))
    good = F.size(F.array_intersect("cites", F.coalesce("known", none)))
    brackets = F.regexp_extract_all("answer", F.lit(BRACKET), F.lit(1))
    return rows.select(
        "id",
        F.size("cites").alias("n_citations"),
        F.round(F.when(F.size("cites") == 0, 1.0).otherwise(good / F.size("cites")), 6).alias("citation_validity"),
        F.forall(brackets, lambda b: b.rlike(r"^[CGP]\d+$")).alias("citation_syntax"),
        F.round(F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: F.array_contains(F.coalesce("pairs", none), p))) / F.size(pairs)).otherwise(F.when(F.size(named) == 0, 1.0).otherwise(0.0)), 6).alias("entailment"),
        F.size(F.array_except(named, F.coalesce("given", none))).alias("out_of_pack"),
        F.forall(F.array(*map(F.lit, SECTIONS)), lambda s: F.contains("answer", s)).alias("format_compliance"),
        F.col("answer").rlike(HEDGES).alias("calibrated"),
        F.col("answer").rlike(OVERCLAIMS).alias("overclaims"),
        F.col("answer").rlike(ABSTENTIONS).alias("abstains"),
    )


def identifier_scores(rows: DataFrame, answer: str, expected: str, pattern: str) -> DataFrame:
    """Set precision, recall and F1 of the identifiers in a text against an array of expected ones."""
    return rows.select("id", *set_metrics(extracted(F.col(answer), pattern), F.col(expected)))


def route_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by route, booleans as shares."""
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])


def decoded(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """Blinded ratings (case_id, variant_id, reviewer, ...) with their route; a rating without a key entry is an error."""
    rows = ratings.join(key, ["case_id", "variant_id"], "left")
    return rows.withColumn("route", F.coalesce("route", F.raise_error(F.concat(F.lit("no route for "), "case_id", F.lit("/"), "variant_id")).cast("string")))
