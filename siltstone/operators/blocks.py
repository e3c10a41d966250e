"""Query sets against all rows in blocks: queries are broadcast in blocks of bounded size, rows are scored where they are
read, and only the k best of each query and task are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from siltstone.operators.text_search import top

#: Entries of the queries (tokens, k-mers) in one broadcast block, queries in one block, and cells of a dense score array.
BLOCK_ENTRIES, BLOCK_QUERIES, CELLS = 1_000_000, 50_000, 4_000_000


class Queries:
    """One block: different entries in order, and for each entry the queries that have it, with their weights."""

    def __init__(self, ids: list, entries: list[np.ndarray], weights: list[np.ndarray]):
        self.ids = ids
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        flat = np.concatenate(entries) if entries else np.zeros(0, dtype=np.uint64)
        self.entries, term = np.unique(flat, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.query = np.repeat(np.arange(len(ids)), self.sizes)[order]
        self.weight = (np.concatenate(weights) if weights else np.zeros(0))[order]
        self.counts = np.bincount(term, minlength=len(self.entries))
        self.starts = np.cumsum(self.counts) - self.counts

    def scores(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        """Dense sums of weight times query weight: a row a document, a column a query."""
        m = self.counts[term]
        at = np.repeat(self.starts[term] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        cell = np.repeat(doc, m) * len(self.ids) + self.query[at]
        return np.bincount(cell, np.repeat(weight, m) * self.weight[at], n_docs * len(self.ids)).reshape(n_docs, len(self.ids))


def blocks(rows: Iterator[tuple[object, np.ndarray, np.ndarray]]) -> Iterator[Queries]:
    """Blocks of (id, entries, weights), read one by one."""
    held, n = [], 0
    for row in rows:
        if held and (n + len(row[1]) > BLOCK_ENTRIES or len(held) >= BLOCK_QUERIES):
            yield Queries(*map(list, zip(*held)))
            held, n = [], 0
        held.append(row)
        n += len(row[1])
    if held:
        yield Queries(*map(list, zip(*held)))


class Best:
    """The k best of each query so far, by score and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.kept, self.least = k, [[] for _ in range(n)], np.zeros(n)

    def add(self, ids: list, scores: np.ndarray) -> None:
        """scores: a row for each id, a column for each query; those not over 0 don't count."""
        if not len(ids):
            return
        for q in np.flatnonzero((scores.max(0) >= self.least) & (scores.max(0) > 0)).tolist():
            s = scores[:, q]
            if len(s) > self.k:
                at = np.flatnonzero((s >= max(self.least[q], np.partition(s, len(s) - self.k)[len(s) - self.k])) & (s > 0))
            else:
                at = np.flatnonzero(s > 0)
            best = sorted(self.kept[q] + [(-x, ids[i]) for i, x in zip(at.tolist(), s[at].tolist())])[: self.k]
            self.kept[q] = best
            if len(best) == self.k:
                self.least[q] = -best[-1][0]


def top_k(docs: DataFrame, id_col: str, parts: list[tuple[Queries, Callable]], query_col: str, query_type: DataType, k: int) -> DataFrame:
    """(query, id, score, rank). parts: blocks of queries, each with a function of (queries, batch) that gives for slices of a
    batch the first row and its dense scores, rounded."""
    schema = f"{query_col} {query_type.simpleString()}, {id_col} {docs.schema[id_col].dataType.simpleString()}, score double"
    asked_type, out = to_arrow_type(query_type), None
    for queries, scored in parts:
        shared = docs.sparkSession.sparkContext.broadcast(queries)  # bounded by BLOCK_ENTRIES and BLOCK_QUERIES

        def run(batches: Iterator[pa.RecordBatch], shared=shared, scored=scored) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best, types = Best(len(asked.ids), k), None
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(id_col))
                types = ids.type
                ids = ids.to_pylist()
                for at, scores in scored(asked, batch):
                    best.add(ids[at : at + len(scores)], scores)
            rows = [(asked.ids[q], i, -s) for q, kept in enumerate(best.kept) for s, i in kept]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, asked_type), pa.array(b, types), pa.array(c, pa.float64())], [query_col, id_col, "score"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return top(out, query_col, [F.desc("score"), id_col], k)


def slices(n: int, queries: Queries) -> Iterator[tuple[int, int]]:
    """Runs of rows whose dense scores stay within CELLS."""
    step = max(1, CELLS // max(1, len(queries.ids)))
    return ((a, min(n, a + step)) for a in range(0, n, step))
