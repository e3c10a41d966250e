"""Rank fusion, first-wins lists, evidence unions, claims and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import compact
from siltstone.operators.text_search import top

ROUTES = ("fts", "blast", "graph", "vector")


def rrf(rankings: DataFrame, by: str, item: str, k: int = 60, limit: int = 10) -> DataFrame:
    """rankings: (by, method, item, rank). Sums 1 / (k + rank); ties by best rank, then item."""
    fused = rankings.groupBy(by, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    return top(fused, by, [F.desc("score"), "best_rank", item], limit)


def appended(primary: DataFrame, secondary: DataFrame, by: str, item: str, prefix: int, limit: int) -> DataFrame:
    """The primary's prefix, then the secondary, then the rest of the primary; each item once."""
    parts = primary.select(by, item, "rank", F.when(F.col("rank") <= prefix, 0).otherwise(2).alias("segment")).unionByName(secondary.select(by, item, "rank", F.lit(1).alias("segment")))
    first = parts.groupBy(by, item).agg(F.min(F.struct("segment", "rank")).alias("at"))
    return top(first, by, ["at", item], limit).select(by, item, "rank")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def evidence_union(routes: list[DataFrame], limit: int) -> DataFrame:
    """Rows (query_id, route, entity_id, pos, ...) of all routes in the order of ROUTES, the first of each route and
    entity, 2 * limit a query; `in_context` marks the first `limit`."""
    order = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    rows = reduce(DataFrame.unionByName, routes).withColumn("route_ord", order)
    rows = first_wins(rows, ["query_id", "route", "entity_id"], ["pos"])
    return top(rows, "query_id", ["route_ord", "pos", "entity_id"], 2 * limit, "ord").withColumn("in_context", F.col("ord") <= limit)


def coverage(evidence: DataFrame, modes: list[str], queries: DataFrame | None = None) -> DataFrame:
    """Share of the active routes with evidence, to 3 places; 1 without active routes. queries: (query_id), all that were
    asked, so that those without evidence get 0."""
    active = [m for m in modes if m in ROUTES]
    hit = F.count_distinct(F.when(F.col("route").isin(active), F.col("route")))
    found = evidence.groupBy("query_id").agg(F.round(hit / len(active), 3).alias("coverage") if active else F.lit(1.0).alias("coverage"))
    if queries is None:
        return found
    return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("coverage", F.lit(0.0 if active else 1.0)).alias("coverage"))


def citations(evidence: DataFrame, limit: int, chars: int) -> DataFrame:
    """E1, E2, ... for the first `limit` rows of each query, with clipped text."""
    return evidence.where(F.col("ord") <= limit).select("query_id", F.concat(F.lit("E"), F.col("ord")).alias("citation"), "route", "entity_id", "title", compact(F.col("text"), chars).alias("text"))


def ranked_papers(candidates: DataFrame, mapping: DataFrame, by: str, item: str, paper: str, limit: int) -> DataFrame:
    """Papers in the order of their best candidate, then of their own order there, each once."""
    best = candidates.join(mapping, item).groupBy(by, paper).agg(F.min(F.struct("rank", "pos")).alias("at"))
    return top(best, by, ["at", paper], limit).select(by, paper, "rank")


def graph_idf(candidates: DataFrame, claims: DataFrame, df: DataFrame, n: int | Column, by: str, offset: float = 10.0, power: float = 1.0) -> DataFrame:
    """(by, claim, score, df, rank): sums of (ln((n + 1) / (df + 1)) + 1) ^ power / (offset + rank) over a claim's candidates.

    candidates: (by, item, rank); claims: (item, claim); df: (claim, df). Ties by df, then claim."""
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    rows = candidates.join(claims, "item").join(df, "claim", "left")
    scored = rows.groupBy(by, "claim").agg(F.round(F.sum(F.pow(idf, F.lit(power)) / (offset + F.col("rank"))), 9).alias("score"), F.first(F.coalesce("df", F.lit(0))).alias("df"))
    return top(scored, by, [F.desc("score"), "df", "claim"], 1 << 30)


def reranked(candidates: DataFrame, hits: DataFrame, by: str, item: str, limit: int, append: bool = True) -> DataFrame:
    """Aligned candidates by bit score, e-value and identity, then, if `append`, the others by vector score."""
    rows = candidates.join(hits, [by, item], "left" if append else "inner").withColumn("segment", F.when(F.col("bitscore").isNotNull(), 0).otherwise(1))
    return top(rows, by, ["segment", F.desc_nulls_last("bitscore"), F.asc_nulls_last("evalue"), F.desc_nulls_last("identity"), F.desc("score"), item], limit)


def routes_of(sequence_type: Column) -> Column:
    """The routes of a query: alignment and vectors for sequences, else text, graph and vectors."""
    return F.when(sequence_type.isNotNull(), F.array(F.lit("blast"), F.lit("vector"))).otherwise(F.array(F.lit("fts"), F.lit("graph"), F.lit("vector")))


def over_fetch(target: str, limit: int) -> int:
    """Rows to ask for before windows are merged by parent."""
    return min(5000, max(1000, 100 * limit)) if target.endswith("_window") else limit
