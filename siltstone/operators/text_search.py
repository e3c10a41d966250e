"""Full-text search: postings, BM25, LIKE fallback and exact-symbol ranking, for batches of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators import pairs
from siltstone.sources.shared import spread, stored

K1, B = 1.2, 0.75


def top(df: DataFrame, by: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))).where(F.col(rank) <= k)


def document_frequency(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(token, df, idf) over all rows."""
    n = df.count()
    t = df.select(F.explode(F.array_distinct(tokens(text))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(F.col("df"), n))


def frequent_tokens(df: DataFrame, text: Column, k: int) -> DataFrame:
    """(token, n, rank): the k most frequent tokens; only these are ranked."""
    counts = df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))


def idf(df: Column, n: int | Column) -> Column:
    return F.log1p((F.lit(n) - df + 0.5) / (df + 0.5))


def _numbered(words: pa.Array, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's token lists: the row and number of each token that is a query word, and all rows' lengths."""
    lists = batch.column(batch.schema.get_field_index("t"))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(lists.flatten(), value_set=words)
    term = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(term >= 0)
    return np.repeat(np.arange(len(sizes)), sizes)[at], term[at], sizes


def _collection(toks: DataFrame, words: pa.Array) -> tuple[int, float, np.ndarray]:
    """Rows, mean length and document frequencies of the query words; a task sends one row of numbers for all of these."""
    shared = toks.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = shared.value, 0, 0
        df = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            row, term, sizes = _numbered(known, batch)
            n, total = n + len(sizes), total + int(sizes.sum())
            df += np.bincount(np.unique(row * len(known) + term) % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], ["term", "n"])

    sums = {r["term"]: r["n"] for r in toks.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    n = sums.get(-1, 0)
    return n, sums.get(-2, 0) / max(1, n), np.array([sums.get(k, 0) for k in range(len(words))], dtype=np.float64)


def bm25(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_col: str, query_text: Column, k: int = 10) -> DataFrame:
    """query, id, score, rank: BM25 with a log query weight, the k best of each query, ties by id.

    Queries are broadcast in blocks of bounded size. Documents are scored where they are read, so that no token and no pair
    of query and document is shuffled, only k rows a query and task. A first pass counts lengths and document frequencies."""
    from siltstone.operators import blocks

    toks = spread(docs).select(F.col(id_col), tokens(text).alias("t"))
    asked = queries.select(F.col(query_col), tokens(query_text).alias("t"))
    number: dict[str, int] = {}

    def read() -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for q, words in asked.toLocalIterator():
            c = Counter(words)
            yield q, np.array([number.setdefault(w, len(number)) for w in c], dtype=np.uint64), 1 + np.log(np.array(list(c.values()), dtype=np.float64))

    parts = []
    for block in blocks.blocks(read()):
        spelled = list(number)
        words = pa.array([spelled[e] for e in block.entries.tolist()], pa.string())
        n, mean, df = _collection(toks, words)

        def scored(block, batch: pa.RecordBatch, words=words, n=n, mean=mean, df=df) -> Iterator[tuple[int, np.ndarray]]:
            row, term, sizes = _numbered(words, batch)
            both, tf = np.unique(row * max(1, len(words)) + term, return_counts=True)
            row, term = both // max(1, len(words)), both % max(1, len(words))
            w = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / max(mean, 1e-300)))
            for a, b in blocks.slices(len(sizes), block):
                cut = slice(*np.searchsorted(row, [a, b]))
                yield a, np.round(block.scores(row[cut] - a, term[cut], w[cut], b - a), 6)

        parts.append((block, scored))
    return blocks.top_k(toks, id_col, parts, query_col, queries.schema[query_col].dataType, k).select(query_col, id_col, F.round("score", 6).alias("score"), "rank")


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """Different k-mers of a text as 64-bit hashes, in order; none if it is shorter."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ x[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def kmer_jaccard(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_col: str, query_text: Column, size: int = 8, k: int = 5) -> DataFrame:
    """query, id, score, rank: the k largest Jaccard similarities of different k-mers, ties by id, in blocks as bm25()."""
    from siltstone.operators import blocks

    asked = queries.select(F.col(query_col), query_text.alias("t")).where("t is not null")

    def read() -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for q, t in asked.toLocalIterator():
            h = kmer_hashes(t, size)
            yield q, h, np.ones(len(h))

    def scored(block, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        texts = batch.column(batch.schema.get_field_index("t"))
        for a, b in blocks.slices(len(texts), block):
            grams = [kmer_hashes(t or "", size) for t in texts[a:b].to_pylist()]
            n = np.array([len(g) for g in grams], dtype=np.int64)
            flat, doc = np.concatenate(grams), np.repeat(np.arange(b - a), n)
            term = np.minimum(np.searchsorted(block.entries, flat), max(0, len(block.entries) - 1))
            hit = np.flatnonzero(block.entries[term] == flat) if len(block.entries) else np.zeros(0, dtype=np.int64)
            both = block.scores(doc[hit], term[hit], np.ones(len(hit)), b - a)
            yield a, np.round(both / np.maximum(1, n[:, None] + block.sizes[None] - both), 6)

    parts = [(block, scored) for block in blocks.blocks(read())]
    return blocks.top_k(spread(docs).select(F.col(id_col), text.alias("t")), id_col, parts, query_col, queries.schema[query_col].dataType, k)


def like_search(df: DataFrame, words: list[str], cols: list[str], order: list, limit: int) -> DataFrame:
    """Rows where any word is in any column, case-insensitive, in order."""
    found = F.lit(False)
    for w in words:
        for c in cols:
            found = found | F.coalesce(F.col(c).ilike(f"%{w}%"), F.lit(False))
    return df.where(found).orderBy(*order).limit(limit)


def exact_first(df: DataFrame, symbol: str, text: str, query: str, id_col: str, limit: int) -> DataFrame:
    """Rows whose text holds the query, `limit` at most; those whose symbol equals it come first. Only the chosen are ranked."""
    exact = F.when(F.upper(symbol) == query.upper(), 0).otherwise(1)
    first = df.where(F.col(text).ilike(f"%{query}%")).withColumn("tier", exact).orderBy("tier", id_col).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("tier", id_col)))


def fts_query(c: Column) -> Column:
    """A full-text query: white-space tokens in double quotes, quotes in them doubled, joined by OR; NULL without tokens."""
    words = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.nullif(F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR "), F.lit(""))


def graph_scores(query_tokens: DataFrame, token_labels: DataFrame, label_docs: DataFrame, places: int = 15) -> DataFrame:
    """query_id, doc_id, score: query token -> associated label -> documents of the label.

    token_labels has token, label, q, odds_ratio and idf; an association weighs min(-log10 q, 50) ln(1 + odds ratio). Queries of
    equal tokens are one class, and so are documents of equal labels: sums are taken and rounded by class, and pairs only joined."""
    w = F.least(-F.log10(F.greatest("q", F.lit(1e-300))), F.lit(50.0)) * F.log1p("odds_ratio") * F.col("idf")
    queries = stored(pairs.classed(query_tokens, "query_id", "token", "_tokens"), "queries")
    docs = stored(pairs.classed(label_docs, "doc_id", "label", "_labels", repeats=True), "docs")
    asked = queries.select("_tokens").distinct().select("_tokens", F.explode("_tokens").alias("token"))
    labels = asked.join(token_labels, "token").groupBy("_tokens", "label").agg(F.sum(w).alias("w"))
    found = docs.select("_labels").distinct().select("_labels", F.explode("_labels").alias("label"))
    scores = labels.join(found, "label").groupBy("_tokens", "_labels").agg(F.round(F.sum("w"), places).alias("score"))
    return pairs.dealt(queries.join(scores, "_tokens").select("query_id", "_labels", "score"), docs, "_labels").select("query_id", "doc_id", "score")


def normalized_scores(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Positive scores over the largest of the group."""
    most = F.max(score).over(Window.partitionBy(by))
    return df.where(F.col(score) > 0).withColumn(score, F.col(score) / most)
