"""Exact vector search in blocks, and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.text_search import top
from siltstone.sources.shared import numbered

BLOCK = 4096


def normalized(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.when(norm == 0, x).otherwise(F.transform(x, lambda e: e / norm))


def knn(queries: DataFrame, vectors: DataFrame, k: int, not_self: bool = True, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k largest cosines (6 places, ties by id) among vectors (id, v) of each of queries (query_id, v).

    Both sides are dealt into blocks by a hash of the id; a pair of blocks is one matrix product in one task. The k best of
    every block are merged by rank."""
    n, asked = vectors.count(), queries.count()
    columns, bands = max(4, -(-n // block)), max(1, -(-asked // block))
    deal = lambda df, i, mine, m, other, o, asks: df.select(F.col(i).alias("id"), "v", F.lit(asks).alias("asks"), F.pmod(F.xxhash64(i), F.lit(m)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(o - 1))).alias(other))
    both = deal(vectors, "id", "c", columns, "q", bands, False).unionByName(deal(queries, "query_id", "q", bands, "c", columns, True))

    def product(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell["asks"].to_numpy(dtype=bool)
        q, c = cell[asks], cell[~asks].sort_values("id")
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        unit = lambda x: (m := np.array(x.tolist(), dtype=np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, out = c["id"].to_numpy(), []
        m = unit(c["v"]).T
        for at in range(0, len(q), 512):
            s = np.round(unit(q["v"][at : at + 512]) @ m, 6) + 0.0
            for i, row in zip(q["id"].to_numpy()[at : at + 512], s):
                if not_self:
                    row = np.where(ids == i, -np.inf, row)
                best = np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else None
                if best is None:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    best = np.concatenate([np.flatnonzero(row > least), np.flatnonzero(row == least)])[:k]
                best = best[np.isfinite(row[best])]
                out.append((np.full(len(best), i), ids[best], row[best]))
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out)))))

    partial = both.groupBy("c", "q").applyInPandas(product, "query_id long, id long, score double")
    return top(partial, "query_id", [F.desc("score"), "id"], k)


def merged_hits(hits: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The best hit of each record over several query windows: (by[0], by[1], score, ...)."""
    best = hits.groupBy(*by).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("votes"))
    return top(best, by[0], [F.desc("score"), by[1]], limit)


def parent_pooled(hits: DataFrame, by: str, parent: str, limit: int) -> DataFrame:
    """Windows to their parents, by the best window."""
    return merged_hits(hits, [by, parent], limit)


def sequence_rerank(hits: DataFrame, overlap: Column, limit: int, overlap_weight: float = 0.75, vector_weight: float = 0.25, vote_weight: float = 0.0) -> DataFrame:
    """The best window of each parent by a blend of overlap and vector score; vote_weight is a constant addend."""
    score = F.round(overlap_weight * overlap + vector_weight * F.col("score") + vote_weight, 6)
    rows = hits.withColumn("rerank", score).withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy("query_id", "parent")))
    best = top(rows, ["query_id", "parent"], [F.desc("rerank"), "id"], 1, "_w").drop("_w")
    return top(best, "query_id", [F.desc("rerank"), "id"], limit)


def neighbours(candidates: DataFrame, k: int, parent: str | None = None) -> DataFrame:
    """(query_id, id, score, query_parent, parent) without the anchor's own parent, one row a parent, the k best."""
    rows = candidates.where("query_id <> id")
    if parent:
        rows = rows.where(F.col(parent) != F.col(f"query_{parent}"))
        rows = top(rows, ["query_id", parent], [F.desc("score"), "id"], 1, "_p").drop("_p")
    return top(rows, "query_id", [F.desc("score"), "id"], k)


def random_neighbours(anchors: DataFrame, vectors: DataFrame, k: int, seed: str = "7") -> DataFrame:
    """query_id, id, rank: k rows that a hash chooses for each anchor. Every anchor takes a run of the rows in hash order,
    from a place that its own hash sets, so no pairs are made but those returned."""
    n = vectors.count()
    at = lambda c: F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(c).cast("string")), 256), 1, 12), 16, 10).cast("long")
    ordered = numbered(vectors.select("id", at("id").alias("h")), ["h", "id"], "place")
    asked = anchors.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("step"), F.pmod(at("query_id"), F.lit(n)).alias("from")).withColumn("place", F.pmod(F.col("from") + F.col("step"), F.lit(n)))
    return top(asked.join(ordered, "place").where("query_id <> id"), "query_id", ["step"], k).select("query_id", "id", "rank")


def hashed_embedding(df: DataFrame, id_col: str, toks: Column, dims: int = 256) -> DataFrame:
    """(id, v): tokens add +-1 to a dimension that their SHA-256 names; length 1."""
    h = F.sha2(F.col("t"), 256)
    dim = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    parts = df.select(F.col(id_col), F.explode(toks).alias("t")).groupBy(id_col, dim.alias("dim")).agg(F.sum(sign).alias("x"))
    m = parts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"))
    return m.select(id_col, normalized(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("v"))


def pooled(rows: DataFrame, by: str, mode: str = "mean") -> DataFrame:
    """(by, v) from token vectors (by, pos, v, special): mean over ordinary tokens, the last of them, or the first token."""
    if mode == "cls":
        return rows.groupBy(by).agg(F.min_by("v", "pos").alias("v"))
    rows = rows.where("not special")
    if mode == "last":
        return rows.groupBy(by).agg(F.max_by("v", "pos").alias("v"))
    each = rows.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))


class Embedders:
    """Registry of embedders: a name to a function of an iterator of text batches to vector batches."""

    def __init__(self):
        self._of: dict[str, object] = {}
        self._alias: dict[str, str] = {}

    def register(self, name: str, factory, aliases: tuple[str, ...] = ()) -> None:
        """factory(**options) -> Callable[[list[str]], np.ndarray], made once in each worker."""
        self._of[name] = factory
        self._alias |= dict.fromkeys(aliases, name)

    def __contains__(self, name: str) -> bool:
        return self._alias.get(name, name) in self._of

    def names(self) -> list[str]:
        return sorted(self._of)

    def embed(self, df: DataFrame, id_col: str, text: str, name: str, **options) -> DataFrame:
        """(id, v) by the named embedder, in Arrow batches."""
        name = self._alias.get(name, name)
        if name not in self._of:
            raise ValueError(f"unknown embedder {name!r}; known: {', '.join(self.names())}")
        factory = self._of[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = factory(**options)
            for b in batches:
                yield pd.DataFrame({id_col: b[id_col], "v": list(np.asarray(encode(b[text].fillna("").tolist()), dtype=np.float32))})

        return df.select(id_col, text).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, v array<float>")


def hashing(dims: int = 256):
    """The hashing embedder as hashed_embedding() has it: tokens add +-1 to a dimension that their SHA-256 names."""
    import hashlib

    import regex

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            for token in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
                h = hashlib.sha256(token.encode()).hexdigest()
                out[i, int(h[:8], 16) % dims] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    return encode


def kmer_counts(k: int = 3, alphabet: str = "ACGT"):
    """Counts of k-mers over an alphabet, at length 1; other letters break k-mers."""
    place = {c: i for i, c in enumerate(alphabet)}

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(alphabet) ** k))
        for i, text in enumerate(texts):
            x = np.array([place.get(c, -1) for c in text.upper()], dtype=np.int64)
            if len(x) >= k:
                parts = np.stack([x[j : len(x) - k + 1 + j] for j in range(k)])
                code = (parts * len(alphabet) ** np.arange(k - 1, -1, -1)[:, None]).sum(0)[(parts >= 0).all(0)]
                out[i] = np.bincount(code, minlength=out.shape[1])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    return encode


def oriented(df: DataFrame, id_col: str, sequence: str, name: str, orientation: str = "none", embedders: Embedders | None = None) -> DataFrame:
    """(id, v) of DNA sequences: none (as they are), rc (the other strand), rc_mean (the mean of both, at length 1)."""
    from siltstone.functions.sequence import reverse_complement
    from siltstone.operators.evaluation import strand_mean

    embedders = embedders or EMBEDDERS
    forward = embedders.embed(df, id_col, sequence, name)
    if orientation == "none":
        return forward
    other = embedders.embed(df.withColumn(sequence, reverse_complement(F.col(sequence))), id_col, sequence, name)
    if orientation == "rc":
        return other
    if orientation != "rc_mean":
        raise ValueError(f"unknown orientation {orientation!r}")
    return forward.join(other.withColumnRenamed("v", "w"), id_col).select(id_col, strand_mean(F.col("v"), F.col("w")).alias("v"))


#: Embedders that need no model; neural ones are registered by those who have them.
EMBEDDERS = Embedders()
EMBEDDERS.register("hashing", hashing, ("hash", "local"))
EMBEDDERS.register("kmer", kmer_counts, ("3mer", "dna-3mer"))
