"""Local alignment: k-mer seeds by an equi-join, then Smith-Waterman on the candidate pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.sequence import kmers
from siltstone.operators.text_search import top

MATCH, MISMATCH, GAP = 2, -1, -2
#: Karlin-Altschul parameters for the scores above.
LAMBDA, K = 0.6, 0.13
RESULT = "score long, identity double, aln_length long, q_start long, q_end long, s_start long, s_end long"


def local_alignment(a: str, b: str) -> tuple[int, float, int, int, int, int, int]:
    """Score, percent identity, alignment length and the 0-based ends of the best local alignment; rows in NumPy.

    Gaps along a row are resolved by a running maximum, since the gap cost is linear."""
    if not a or not b:
        return 0, 0.0, 0, 0, 0, 0, 0
    x, y = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32), np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    h = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int64)
    step = -GAP * np.arange(len(y) + 1)
    for i in range(1, len(x) + 1):
        row = np.maximum(0, np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP))
        h[i, 1:] = row
        h[i] = np.maximum.accumulate(h[i] + step) - step
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, same, length = int(h[i, j]), (int(i), int(j)), 0, 0
    while h[i, j] > 0:
        length += 1
        if h[i, j] == h[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
            same += x[i - 1] == y[j - 1]
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, round(100.0 * same / max(1, length), 6), length, int(i), end[0], int(j), end[1]


def longest_common_substring(a: str, b: str) -> int:
    x, y = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32), np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    run, best = np.zeros(len(y) + 1, dtype=np.int64), 0
    for ch in x:
        run[1:] = np.where(y == ch, run[:-1] + 1, 0)
        best = max(best, int(run.max(initial=0)))
    return best


@F.pandas_udf(T.DoubleType())
def overlap_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 if one text holds the other; else the larger of the longest common substring over the shorter length and the
    containment of 5-mers; 0 for empty texts."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        if not x or not y:
            out.append(0.0)
        elif x in y or y in x:
            out.append(1.0)
        else:
            k = min(5, len(x), len(y))
            p, q = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (x, y))
            out.append(max(longest_common_substring(x, y) / min(len(x), len(y)), len(p & q) / min(len(p), len(q))))
    return pd.Series(out)


def seeds(queries: DataFrame, subjects: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(query_id, subject_id, seeds): pairs that share `least` different k-mers. queries: (query_id, query), subjects:
    (subject_id, subject)."""
    q = queries.select("query_id", F.explode(F.array_distinct(kmers(F.col("query"), k))).alias("g"))
    s = subjects.select("subject_id", F.explode(F.array_distinct(kmers(F.col("subject"), k))).alias("g")).join(q.select("g").distinct(), "g", "left_semi")
    return q.join(s, "g").groupBy("query_id", "subject_id").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least)


def aligned(pairs: DataFrame, queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """Pairs with score, bitscore, evalue, identity, coverage and ends."""

    @F.pandas_udf(RESULT)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_alignment(x, y) for x, y in zip(a, b)], columns=["score", "identity", "aln_length", "q_start", "q_end", "s_start", "s_end"])

    size = subjects.agg(F.sum(F.length("subject")).alias("db"))
    rows = pairs.join(queries, "query_id").join(subjects, "subject_id").withColumn("r", align("query", "subject")).crossJoin(F.broadcast(size))
    bits = (LAMBDA * F.col("r.score") - F.log(F.lit(K))) / F.log(F.lit(2.0))
    shorter = F.least(F.length("query"), F.length("subject"))
    return rows.select("query_id", "subject_id", "r.*", F.round(bits, 6).alias("bitscore"), (F.length("query") * F.col("db") * F.pow(F.lit(2.0), -bits)).alias("evalue"), F.round(F.col("r.aln_length") / shorter, 6).alias("coverage"))


def search(queries: DataFrame, subjects: DataFrame, k: int = 5, limit: int = 5, candidates: DataFrame | None = None, short: int = 30) -> DataFrame:
    """The best alignments of each query, whole database or only the candidate pairs. Short queries seed on smaller k-mers."""
    pairs = candidates
    if pairs is None:
        small = queries.where(F.length("query") < short)
        pairs = seeds(queries.where(F.length("query") >= short), subjects, k)
        pairs = pairs.unionByName(seeds(small, subjects, max(2, k - 2), 1)) if small.limit(1).count() else pairs
    return top(aligned(pairs.select("query_id", "subject_id"), queries, subjects), "query_id", [F.desc("bitscore"), F.desc("identity"), "subject_id"], limit)


def similar_pairs(sequences: DataFrame, k: int, identity: float, coverage: float, per_node: int | None = None) -> DataFrame:
    """(u, v, identity, bitscore): all-against-all alignments over both thresholds, without self pairs. sequences: (id, sequence)."""
    q, s = sequences.select(F.col("id").alias("query_id"), F.col("sequence").alias("query")), sequences.select(F.col("id").alias("subject_id"), F.col("sequence").alias("subject"))
    rows = aligned(seeds(q, s, k).where("query_id < subject_id").select("query_id", "subject_id"), q, s)
    rows = rows.where((F.col("identity") >= identity) & (F.col("coverage") >= coverage)).select(F.col("query_id").alias("u"), F.col("subject_id").alias("v"), "identity", "bitscore", "aln_length")
    if per_node is None:
        return rows
    both = rows.withColumn("node", F.explode(F.array("u", "v")))
    return top(both, "node", [F.desc("bitscore"), F.desc("identity"), F.desc("aln_length"), "u", "v"], per_node).select("u", "v", "identity", "bitscore", "aln_length").distinct()


def alphabet(c):
    """dna if all letters are bases, else protein."""
    return F.when(F.upper(c).rlike("^[ACGTUN]+$"), "dna").otherwise("protein")


def encoded_id(c: Column) -> Column:
    """An id without white space, pipes or commas for FASTA headers: q_ and the id, other characters as % and two hex digits."""
    safe = F.regexp_replace(F.url_encode(c.cast("string")), r"\+", "%20")
    return F.concat(F.lit("q_"), safe)


def decoded_id(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, "^q_", ""))
