"""Operator 7: exact top-k by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: component t is a term of weight floor(64 x), terms of weight 0 are left out. Rows are
dealt into blocks by a hash of the id, queries and candidates alike, and each pair of a query block and a candidate block is
one bounded task: the candidates' postings are laid out by term, the weighted postings of a query's terms are scattered into
the dense score array of the block, and the k best of each query are partitioned off. The blocks' lists are merged by rank.

Block counts follow the row counts, so a task never holds more than about BLOCK rows of either kind, whatever the input.
Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; a shorter vector lacks
the further terms. Scores are exact at any size of weight: rows whose products could pass 63 bits are summed as integers
without a bound, and a returned score that is no long is an error. Rows that share an id each count as candidates, but never
for a query of that id; a query id that occurs twice is asked once, with the vector that sorts first. Ties go to the smaller
id. Further columns aren't read; an empty table has no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  # pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table

SCALE, BLOCK, LEAST_BLOCKS = 64, 32768, 16
#: Scores of a group of queries, in numbers, that stay in cache.
CACHED = 1 << 18
_PARTIAL = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, terms, weights): the usable rows as sparse integer rows; weights are whole doubles."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.when(F.abs(v * SCALE) < float(2**53), F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)  # noqa: E731  # larger ones are whole
    entries = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("t"), whole(v).alias("w"))), lambda e: e["w"] != 0)
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("e"))
    return rows.select("vec_id", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


class Rows:
    """Sparse rows of one task."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.n, self.terms, self.weights = ids, n, terms, weights
        self.row = np.repeat(np.arange(len(ids)), n)
        self.most = np.zeros(len(ids))
        np.maximum.at(self.most, self.row, np.abs(weights))

    @classmethod
    def of(cls, cell: pa.Table) -> Rows:
        lists = [cell.column(c).combine_chunks() for c in ("terms", "weights")]
        n = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(cell.column("vec_id").to_numpy(), n, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists))

    def take(self, rows: np.ndarray) -> Rows:
        first = np.cumsum(self.n) - self.n
        at = np.repeat(first[rows], self.n[rows]) + np.arange(int(self.n[rows].sum())) - np.repeat(np.cumsum(self.n[rows]) - self.n[rows], self.n[rows])
        return Rows(self.ids[rows], self.n[rows], self.terms[at], self.weights[at])


def exact(weights: np.ndarray) -> np.ndarray:
    """Whole doubles as integers without a bound."""
    return np.array([int(w) for w in weights.tolist()], dtype=object)


def best_of_block(q: Rows, c: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of this block for each query, ties to smaller ids."""
    terms = int(max(q.terms.max(initial=-1), c.terms.max(initial=-1))) + 1
    safe = (2.0**62 / max(1, terms)) ** 0.5  # products of such weights add up within 63 bits
    large_q, large_c = q.most >= safe, c.most >= safe
    if not large_q.any() and not large_c.any():
        return _best(q, c, k, terms)
    at = lambda x: np.flatnonzero(x)
    parts = [_best(q.take(at(~large_q)), c.take(at(~large_c)), k, terms), _best(q.take(at(~large_q)), c.take(at(large_c)), k, terms), _best(q.take(at(large_q)), c, k, terms)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _best(q: Rows, c: Rows, k: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(q.ids) or not len(c.ids):
        return (np.zeros(0, dtype=np.int64),) * 3
    c = c.take(np.argsort(c.ids, kind="stable"))
    most, n = float(q.most.max()) * float(c.most.max()) * max(1, terms), len(c.ids)
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    cast = exact if kind is object else lambda w: w.astype(kind)
    order = np.argsort(c.terms, kind="stable")
    cuts = np.searchsorted(c.terms[order], np.arange(terms + 1))
    row, weight = c.row[order], cast(c.weights[order])
    postings = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if 2 * (b - a) > n and kind is not object:  # a list of most of the block is kept whole, zeros included
            whole = np.zeros(n, dtype=kind)
            whole[row[a:b]] = weight[a:b]
            postings.append((None, whole))
        else:
            postings.append((row[a:b], weight[a:b]))
    out: list[tuple] = []
    group = max(1, min(64, CACHED // n))
    scratch, first = np.empty((group, n), dtype=kind), np.append(0, np.cumsum(q.n))
    for at in range(0, len(q.ids), group):
        ids, own = q.ids[at : at + group], slice(first[at], first[min(at + group, len(q.ids))])
        mine, term = np.unique(q.terms[own], return_inverse=True)
        asked = np.zeros((len(ids), len(mine)), dtype=kind)
        asked[q.row[own] - at, term] = cast(q.weights[own])
        scores = np.zeros((len(ids), n), dtype=kind)
        for t, weighted in zip(mine.tolist(), asked.T):
            where, weights = postings[t]
            if where is None:
                np.multiply.outer(weighted, weights, out=scratch[: len(ids)])
                scores += scratch[: len(ids)]
            elif len(where):
                scores[:, where] += np.multiply.outer(weighted, weights)
        for i, s in zip(ids.tolist(), scores):
            there = slice(*np.searchsorted(c.ids, [i, i + 1])) if i < 2**63 - 1 else slice(np.searchsorted(c.ids, i), n)
            keep = np.delete(np.arange(n), there) if there.start < there.stop else None
            own_s = s if keep is None else s[keep]
            if len(own_s) > k:
                least = np.sort(own_s)[len(own_s) - k] if kind is object else np.partition(own_s, len(own_s) - k)[len(own_s) - k]
                over, level = np.flatnonzero(own_s > least), np.flatnonzero(own_s == least)
                chosen = np.concatenate([over, level[: k - len(over)]])  # by id, so ties go to the smaller
            else:
                chosen = np.arange(len(own_s))
            rows = chosen if keep is None else keep[chosen]
            out.append((np.full(len(rows), i, dtype=np.int64), c.ids[rows], np.array([_long(x) for x in s[rows].tolist()], dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _long(score: int) -> int:
    if not -(2**63) <= score < 2**63:
        raise OverflowError(f"inner product {score} is no long")
    return score


def top_k(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query row (`is_query`, a condition on vec_id) against all other rows."""
    rows = quantized(vectors)
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    columns, bands = max(LEAST_BLOCKS, -(-n // block)), max(1, -(-asked // block))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("terms", "weights")).alias("v")).select("vec_id", "v.terms", "v.weights")

    def cells(df: DataFrame, mine: str, n_mine: int, other: str, n_other: int) -> DataFrame:
        dealt = df.withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.lit(n_mine)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    both = cells(rows, "c", columns, "q", bands).withColumn("asks", F.lit(False)).unionByName(cells(queries, "q", bands, "c", columns).withColumn("asks", F.lit(True)))

    def accumulate(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks")
        found = best_of_block(Rows.of(cell.filter(asks)), Rows.of(cell.filter(pa.compute.invert(asks))), k)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    partial = both.groupBy("c", "q").applyInArrow(accumulate, _PARTIAL)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
rows AS (SELECT vec_id, list_transform(e, lambda v: floor(64 * v)) AS w FROM raw),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
