"""python -m siltstone.cli: the functions of the library over tables of a folder.

    list                                     registered queries, those with SQL marked
    sql NAME                                 the DuckDB SQL of a query
    run NAME --data DIR [--out DIR]          a query's rows, shown or written as Parquet
    search TEXT --kb DIR [--limit N]         BM25 over the knowledge base `documents` (id, name, symbol, description)
    status --kb DIR                          row counts by kind
    init-schema --out DIR                    empty canonical tables
    build-graph --kb DIR --out DIR           nodes and edges of the knowledge base
    build-vector --kb DIR --out DIR          a text target by a registered embedder
    vector-search TEXT --store DIR           the nearest records of such a target
    conditions                               routes of each evaluation condition"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evaluation conditions: a name and the routes that it may use.
CONDITIONS: dict[str, tuple[str, ...]] = {}


def condition(name: str, *routes: str) -> None:
    """Registers a condition; its routes must be known. `auto` stands for the routes of a query's kind (fusion.routes_of)."""
    from siltstone.operators.fusion import ROUTES

    if unknown := [r for r in routes if r not in (*ROUTES, "auto")]:
        raise ValueError(f"unknown routes {unknown}")
    CONDITIONS[name] = routes


# The conditions that evaluations compare.
condition("fts", "fts")
condition("blast", "blast")
condition("classical", "fts", "blast")
condition("vector", "vector")
condition("graph", "fts", "graph")
condition("hybrid", "fts", "blast", "graph", "vector")
condition("hybrid_gated", "auto")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser
    for name, positional, options in (
        ("list", (), ()), ("conditions", (), ()), ("sql", ("name",), ()), ("run", ("name",), ("data", "out")), ("search", ("text",), ("kb", "limit")), ("status", (), ("kb",)),
        ("init-schema", (), ("out",)), ("build-graph", (), ("kb", "out")), ("build-vector", (), ("kb", "out", "backend")), ("vector-search", ("text",), ("store", "limit")),
    ):
        command = add(name)
        for a in positional:
            command.add_argument(a)
        for o in options:
            command.add_argument(f"--{o}", required=o in ("data", "kb", "store") or o == "out" and name != "run", type=int if o == "limit" else str, default={"limit": 10, "backend": "hashing"}.get(o))
    return p


def tools() -> list[dict]:
    """The commands as JSON tool descriptors: name, description and parameters."""
    lines = dict(line.strip().split("  ", 1) for line in __doc__.splitlines()[2:] if line.strip())
    about = {usage.split()[0]: text.strip() for usage, text in lines.items()}
    found = []
    for name, command in next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices.items():
        parameters = {a.dest: {"type": "integer" if a.type is int else "string", "required": bool(a.required)} for a in command._actions if a.dest != "help"}
        found.append({"name": name, "description": about[name], "parameters": parameters})
    return found


def kb(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    """Runs a command; prints and returns its rows."""
    from siltstone.operators import corpus, knowledge, text_search, vectors
    from siltstone.plans import catalog
    from siltstone.sources import sinks

    a = parser().parse_args(argv)
    catalog.load()
    rows: list[dict] = []
    if a.command in ("list", "conditions", "sql"):
        rows = {"list": lambda: [{"query": n, "sql": n in catalog.SQL} for n in sorted(catalog.QUERIES)], "conditions": lambda: [{"condition": n, "routes": list(r)} for n, r in CONDITIONS.items()], "sql": lambda: [{"sql": catalog.SQL[a.name]}]}[a.command]()
    else:
        spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
        df = None
        if a.command == "run":
            df = catalog.QUERIES[a.name](spark, a.data)
            if a.out:
                df.write.mode("overwrite").parquet(a.out)
                df = None
        elif a.command == "search":
            q = spark.createDataFrame([(1, a.text)], "query_id int, query string")
            d = kb(spark, a.kb)
            hits = text_search.bm25(d, "id", F.concat_ws(" ", "symbol", "name", "description"), q, "query_id", F.col("query"), a.limit)
            df = hits.join(d.select("id", "kind", "source_id", "symbol", "name"), "id").orderBy("rank")
        elif a.command == "status":
            df = corpus.status(kb(spark, a.kb), "kind").orderBy("kind")
        elif a.command == "init-schema":
            sinks.initialize(spark, a.out)
        elif a.command == "build-graph":
            nodes, edges = knowledge.built(kb(spark, a.kb), {"xrefs": "xref"}, [])
            sinks.sidecars(nodes, edges, a.out)
        elif a.command == "build-vector":
            d = kb(spark, a.kb).select(F.concat_ws(":", F.lit("text"), F.col("id").cast("string")).alias("record_id"), F.concat_ws(" ", "symbol", "name", "description").alias("text"))
            df = sinks.written_target(d.join(vectors.EMBEDDERS.embed(d, "record_id", "text", a.backend).withColumnRenamed("v", "embedding"), "record_id"), a.out, "text", a.backend)
        elif a.command == "vector-search":
            backend = spark.read.parquet(f"{a.store}/text/manifest").first()["backend"]
            store = sinks.read_target(spark, a.store, "text")
            q = vectors.EMBEDDERS.embed(spark.createDataFrame([(1, a.text)], "query_id long, text string"), "query_id", "text", backend)
            hits = vectors.knn(q, store.select(F.col("row_idx").alias("id"), F.col("embedding").alias("v")), a.limit, not_self=False)
            df = hits.join(store.select(F.col("row_idx").alias("id"), "record_id", "text"), "id").select("rank", "record_id", "score", "text").orderBy("rank")
        if df is not None:
            rows = [r.asDict() for r in df.limit(1000).collect()]
    for r in rows:
        print(json.dumps(r, default=str, ensure_ascii=False))
    return rows


if __name__ == "__main__":
    main()
