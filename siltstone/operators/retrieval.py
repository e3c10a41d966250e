"""The vector route from query texts to evidence, and rankings over several window scales."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.operators import fusion, knowledge, vectors


@dataclass(frozen=True)
class Collection:
    """Records of one target in one engine: (id, text, v, ...), made by an embedder."""

    target: str
    engine: str
    backend: str
    records: DataFrame


#: Engines in the order in which they are asked for a target.
ENGINES = ("index", "store", "matrix")


def chosen(collections: list[Collection], target: str) -> Collection | None:
    """The target's collection in the first engine that has one."""
    have = {c.engine: c for c in collections if c.target == target}
    return next((have[e] for e in ENGINES if e in have), None)


def vector_route(queries: DataFrame, collections: list[Collection], limit: int, target: str | None = None, where: Column | None = None, embedders: vectors.Embedders | None = None, size: int = 128, stride: int = 64) -> tuple[DataFrame, DataFrame]:
    """Evidence and traces of queries (query_id, query).

    A query's target is given, or the first that there is for its alphabet. Long sequences ask with their windows; window targets
    fetch more than the limit; a record counts with its best window. `where` filters records before they are ranked. Traces:
    (query_id, status, hits, target, engine, backend, query_windows, raw_top_k), status missing_index where no engine has the
    target, unknown_backend where no embedder is registered under the collection's."""
    embedders = embedders or vectors.EMBEDDERS
    kind = seq.detected(F.col("query"))
    names = sorted({c.target for c in collections})
    goal = F.lit(target) if target else knowledge.vector_target(kind, names)
    asked = queries.select("query_id", "query", kind.alias("kind"), goal.alias("target"))
    evidence, traces = [], []
    for name in [target] if target else [*names, None]:
        mine = asked.where(F.col("target") == name) if name else asked.where("target is null")
        c = chosen(collections, name) if name else None
        status = "missing_index" if c is None else "ok" if c.backend in embedders else "unknown_backend"
        trace = lambda n, windows, status=status, c=c, name=name: ["query_id", status if isinstance(status, Column) else F.lit(status).alias("status"), n.cast("long").alias("hits"), F.lit(name).cast("string").alias("target"), F.lit(c and c.engine).cast("string").alias("engine"), F.lit(c and c.backend).cast("string").alias("backend"), windows.cast("int").alias("query_windows"), F.lit(fusion.over_fetch(name or "", limit)).alias("raw_top_k")]
        if status != "ok":
            traces.append(mine.select(*trace(F.lit(0), F.lit(0))))
            continue
        texts = mine.select("query_id", F.explode(knowledge.query_texts(F.col("query"), F.col("kind"), size, stride)).alias("text")).withColumn("part", F.concat_ws("#", F.col("query_id").cast("string"), F.sha1("text")))
        embedded = embedders.embed(texts.select("part", "text"), "part", "text", c.backend)
        number = embedded.select(F.xxhash64("part").alias("query_id"), "v")
        rows = c.records.where(where) if where is not None else c.records
        hits = vectors.knn(number, rows.select("id", "v"), fusion.over_fetch(name, limit), not_self=False).withColumnRenamed("query_id", "n")
        hits = texts.select("query_id", F.xxhash64("part").alias("n")).join(hits, "n").select("query_id", "id", "score")
        best = vectors.merged_hits(hits, ["query_id", "id"], limit)
        details = [x for x in ("name", "start", "end") if x in rows.columns]
        full = best.join(rows.select("id", "text", *details), "id").withColumn("target", F.lit(name))
        for column, t in (("name", "string"), ("start", "int"), ("end", "int")):
            if column not in details:
                full = full.withColumn(column, F.lit(None).cast(t))
        evidence.append(knowledge.vector_evidence(full.withColumn("id", F.col("id").cast("string"))))
        found = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
        windows = texts.groupBy("query_id").agg(F.count(F.lit(1)).alias("windows"))
        done = mine.join(found, "query_id", "left").join(windows, "query_id", "left")
        state = F.when(F.coalesce("hits", F.lit(0)) > 0, "ok").otherwise("no_hits").alias("status")
        traces.append(done.select(*trace(F.coalesce("hits", F.lit(0)), F.coalesce("windows", F.lit(0)), status=state)))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    nothing = knowledge.vector_evidence(asked.limit(0).select("query_id", F.lit(0).alias("rank"), *[F.lit(None).cast("string").alias(x) for x in ("id", "name", "text", "target")], *[F.lit(None).cast("int").alias(x) for x in ("start", "end")], F.lit(0.0).alias("score")))
    return union(evidence) if evidence else nothing, union(traces)


def multi_scale(queries: DataFrame, scales: dict[str, DataFrame], k: int, depth: int = 100, rrf_k: int = 60) -> DataFrame:
    """query_id, parent, score, rank: parents ranked at each window scale by their best window, then fused by reciprocal rank.

    queries: (query_id, v); scales: name to (id, parent, v)."""
    parts = []
    for name, windows in scales.items():
        hits = vectors.knn(queries, windows.select("id", "v"), max(depth, k) * 4, not_self=False)
        ranked = vectors.parent_pooled(hits.join(windows.select("id", "parent"), "id").select("query_id", "parent", "score"), "query_id", "parent", depth)
        parts.append(ranked.select("query_id", "parent", "rank", F.lit(name).alias("scale")))
    return fusion.rrf(reduce(DataFrame.unionByName, parts), "query_id", "parent", rrf_k, k).select("query_id", "parent", "score", "rank")
