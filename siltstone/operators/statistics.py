"""Metrics of rankings and the statistics that judge them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.text_search import top
from siltstone.sources.shared import numbered, stored


def first_match(ranked: DataFrame, by: list[str], matched: Column) -> DataFrame:
    """(by, match_rank): the least rank that matches, NULL without one."""
    return ranked.groupBy(*by).agg(F.min(F.when(matched, F.col("rank"))).alias("match_rank"))


def hits(rank: str = "match_rank", ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """hit_at_k and reciprocal rank columns of a first-match rank."""
    r = F.col(rank)
    return [F.coalesce(r <= k, F.lit(False)).alias(f"hit_at_{k}") for k in ks] + [F.round(F.coalesce(1.0 / r, F.lit(0.0)), 6).alias("rr")]


def hit_summary(rows: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    rate = [F.round(F.avg(F.col(f"hit_at_{k}").cast("double")), 4).alias(f"hit_at_{k}") for k in ks]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), *rate, F.round(F.avg("rr"), 4).alias("mrr"))


def recall_at(ranked: DataFrame, relevant: DataFrame, by: str, item: str, ks: list[int]) -> DataFrame:
    """(by, recall_at_k ...): shares of a query's relevant items in its first k."""
    rows = relevant.select(by, item).distinct().join(ranked.select(by, item, "rank"), [by, item], "left")
    return rows.groupBy(by).agg(*[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks])


def set_metrics(predicted: Column, expected: Column) -> list[Column]:
    """precision, recall, f1 and hit of two arrays as sets; 0 where undefined."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    both = F.size(F.array_intersect(p, e))
    zero = lambda c: F.coalesce(F.try_divide(c[0], c[1]), F.lit(0.0))
    return [F.round(zero((both, F.size(p))), 6).alias("precision"), F.round(zero((both, F.size(e))), 6).alias("recall"), F.round(zero((2.0 * both, F.size(p) + F.size(e))), 6).alias("f1"), (both > 0).alias("hit")]


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!, by a table of the first 256 and by Stirling's series beyond."""
    z = np.maximum(n, 255) + 1.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(n < 256, _SMALL[np.clip(n, 0, 255)], series)


def hypergeometric_tail(population: np.ndarray, successes: np.ndarray, draws: np.ndarray, observed: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """P(X >= observed): sums of exponentials of log binomials, some `most` terms at a time. A row's sum ends 12 standard
    deviations and 50 terms beyond its mean or its observation, where what is left is under 1e-30 of it."""
    N, K, m, x = (np.asarray(a, dtype=np.int64) for a in (population, successes, draws, observed))
    mean = m * K / np.maximum(N, 1)
    sd = np.sqrt(np.maximum(mean * (1 - K / np.maximum(N, 1)), 0.0))
    low = np.maximum(np.maximum(x, m - (N - K)), 0)
    high = np.minimum(np.minimum(K, m), (np.maximum(low, mean) + 12 * sd + 50).astype(np.int64))
    size, out = np.maximum(high - low + 1, 0), np.zeros(len(N))
    ends = np.cumsum(size)
    at = 0
    while at < len(N):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        part = slice(at, end)
        row = np.repeat(np.arange(at, end), size[part])
        k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        lf, Nr, Kr, mr = log_factorial, N[row], K[row], m[row]
        log_p = lf(Kr) - lf(k) - lf(Kr - k) + lf(Nr - Kr) - lf(mr - k) - lf(Nr - Kr - mr + k) - lf(Nr) + lf(mr) + lf(Nr - mr)
        out[part] = np.bincount(row - at, np.exp(log_p), end - at)
        at = end
    return np.where(x <= 0, 1.0, np.minimum(1.0, out))


def hypergeometric(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, population, successes, draws, observed) with p = P(X >= observed)."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, s: pd.Series, d: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_tail(n.to_numpy(), s.to_numpy(), d.to_numpy(), o.to_numpy()))

    return rows.withColumn("p", tail("population", "successes", "draws", "observed"))


#: Ranks in one task of a running minimum over a whole table.
RANKS = 100_000


def benjamini_hochberg(rows: DataFrame, p: str = "p", by: list[str] = (), order: list[str] = ()) -> DataFrame:
    """q = the running least of p m / rank from the largest p down, 1 at most; for each group of `by`, or for all rows.

    All rows are ranked in ranges, and the running minimum is taken in lots of RANKS with the minima of later lots, one number
    a lot, so no task holds the table."""
    if by:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(p, *order))).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")
    ranked = stored(numbered(rows, [p, *order], "_r"), "ranked")
    m = ranked.count()
    raw = ranked.withColumn("_x", F.col(p) * m / (F.col("_r") + 1)).withColumn("_lot", F.floor(F.col("_r") / RANKS))
    lots = sorted((r["_lot"], r["x"]) for r in raw.groupBy("_lot").agg(F.min("_x").alias("x")).collect())
    later = [(k, min([1.0, *(x for _, x in lots[i + 1 :])])) for i, (k, _) in enumerate(lots)]
    rest = F.broadcast(rows.sparkSession.createDataFrame(later, "_lot long, _later double"))
    down = Window.partitionBy("_lot").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.join(rest, "_lot").withColumn("q", F.least("_later", F.min("_x").over(down))).drop("_r", "_x", "_lot", "_later")


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """With half a count added to each cell."""
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def enrichment(value: Column, base: Column) -> Column:
    """Infinity over an empty base, 1 if both are empty."""
    return F.when(base == 0, F.when(value == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))).otherwise(value / base)


def purity(rows: DataFrame, group: str, label: str) -> DataFrame:
    """group, label, n, size, purity: the most frequent label of each group, the smallest of equals."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return top(counts, group, [F.desc("n"), label], 1).drop("rank").join(size, group).withColumn("purity", F.round(F.col("n") / F.col("size"), 6))


def weighted_kappa(rows: DataFrame, a: str, b: str, low: int, high: int, by: list[str] = ()) -> DataFrame:
    """Quadratic-weighted kappa and raw agreement of two integer ratings."""
    w = F.pow((F.col("x") - F.col("y")) / float(high - low), F.lit(2.0))
    keys = list(by)
    cell = rows.groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    seen = cell.groupBy(*keys).agg(F.sum(w * F.col("n")).alias("observed"), F.sum("n").alias("ratings"), F.round(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("agreement"))
    xs, ys = (cell.groupBy(*keys, c).agg(F.sum("n").alias(f"n_{c}")) for c in ("x", "y"))
    chance = (xs.join(ys, keys) if keys else xs.crossJoin(ys)).groupBy(*keys).agg(F.sum(w * F.col("n_x") * F.col("n_y")).alias("expected"))
    both = seen.join(chance, keys) if keys else seen.crossJoin(chance)
    return both.select(*keys, "ratings", "agreement", F.round(F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("observed") * F.col("ratings") / F.col("expected")), 6).alias("kappa"))


def bootstrap(rows: DataFrame, by: str, value: str, samples: int = 2000, seed: int = 1) -> DataFrame:
    """by, n, mean, low, high: percentile interval of the mean (or of a paired difference) per group.

    A Poisson bootstrap: in each sample a value that occurs n times weighs a Poisson(n) draw, seeded by group and value, so
    that samples add up over partitions: a task holds one pair of sums for each group and sample, however many the values."""
    kind = dict(rows.dtypes)[by]
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for g, x, n in zip(b[by], b["x"], b["n"]):
                key = zlib.crc32(f"{g}|{x!r}".encode())
                w = np.random.default_rng([seed, key]).poisson(n, samples)
                s = held.setdefault(g, np.zeros((2, samples)))
                s[0] += w * x
                s[1] += w
        yield pd.DataFrame({by: pd.Series(list(held), dtype=b[by].dtype if held else None), "sums": [s.tobytes() for s in held.values()]})

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        total, weight = np.sum([np.frombuffer(s).reshape(2, samples) for s in sorted(pdf["sums"])], axis=0)
        drawn = weight > 0  # a sample of a small group may be empty
        low, high = np.percentile(total[drawn] / weight[drawn], [2.5, 97.5])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "low": [float(low)], "high": [float(high)]})

    ranges = counts.mapInPandas(sums, f"{by} {kind}, sums binary").groupBy(by).applyInPandas(interval, f"{by} {kind}, low double, high double")
    means = counts.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    return means.join(ranges, by).select(by, "n", "mean", "low", "high")


def stratified_permutation(rows: DataFrame, id_col: str, length: str, label: str, bins: int, replicates: int, seed: str = "1") -> DataFrame:
    """(replicate, id, label): labels dealt anew among rows of similar length, in hash order."""
    placed = stored(numbered(rows.select(id_col, length, label), [length, id_col], "_at"), "strata")
    small, more = divmod(placed.count(), bins)  # the first `more` strata have one row more, as ntile deals them
    front, at = more * (small + 1), F.col("_at")
    strata = placed.withColumn("stratum", F.when(at < front, F.floor(at / (small + 1))).otherwise(more + F.floor((at - front) / max(1, small)))).drop("_at")
    many = strata.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = lambda *c: Window.partitionBy("replicate", "stratum").orderBy(*c)
    draw = F.sha2(F.concat_ws(":", F.lit(seed), "replicate", F.col(id_col)), 256)
    places = many.select("replicate", "stratum", id_col, F.row_number().over(w(id_col)).alias("place"))
    drawn = many.select("replicate", "stratum", label, F.row_number().over(w(draw, id_col)).alias("place"))
    return places.join(drawn, ["replicate", "stratum", "place"]).select("replicate", id_col, label)


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, median, mean, 95th percentile (between neighbours) and most."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.min(value), 6).alias("min_value"), F.round(F.percentile(value, 0.5), 6).alias("median_value"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.percentile(value, 0.95), 6).alias("p95_value"), F.round(F.max(value), 6).alias("max_value")
    )


def composite(rows: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """(profile, total) from (part, median): sums of parts, NULL if one is missing."""
    cols = [F.when(F.count(F.when(F.col("part").isin(parts), 1)) == len(parts), F.sum(F.when(F.col("part").isin(parts), F.col("median")))).alias(name) for name, parts in profiles.items()]
    return rows.agg(*cols).select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n), F.round(F.col(n), 6)) for n in profiles]))).alias("profile", "total"))


def rank_permutation(rows: DataFrame, by: list[str], rank: str, n: int) -> DataFrame:
    """Groups whose ranks aren't 1 to n, each once."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(rank)).alias("ranks")).where(F.col("ranks") != F.sequence(F.lit(1), F.lit(n)).cast("array<int>"))
