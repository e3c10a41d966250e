"""Joins that give all pairs of large groups, dealt evenly, and members of equal sets as one class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key's lot on each side (about), and pairs that a task gives (about).
LOT, PAIRS = 2048, 16_000_000


def dealt(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join by `key` where its result is many times its inputs: each side of a key is cut into lots by a hash of the
    row, each pair of lots is joined where it falls, and tasks are as many as the pairs ask for, however few the keys."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    lots = lambda c: F.ceil(F.col(c) / LOT).cast("int")
    sizes = n(left, "_n").join(n(right, "_m"), key).select(key, lots("_n").alias("_lots"), lots("_m").alias("_others"), (F.col("_n").cast("double") * F.col("_m")).alias("_pairs"))
    found = sizes.agg(F.sum("_pairs").alias("pairs"), F.sum(F.col("_lots").cast("long") * F.col("_others")).alias("cells")).first()
    tasks = max(1, min(int(found["cells"] or 0), max(left.sparkSession.sparkContext.defaultParallelism, int((found["pairs"] or 0) / PAIRS))))

    def cut(df: DataFrame, mine: str, count: str, other: str, others: str) -> DataFrame:
        rows = df.join(sizes.drop("_pairs"), key).withColumn(mine, F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(count)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_lots", "_others").repartition(tasks, key, "_a", "_b")

    return cut(left, "_a", "_lots", "_b", "_others").join(cut(right, "_b", "_others", "_a", "_lots"), [key, "_a", "_b"]).drop("_a", "_b")


def classed(df: DataFrame, member: str, item: str, name: str, repeats: bool = False) -> DataFrame:
    """(member, name): the sorted items of each member; members of equal items are one class. With `repeats` an item counts as
    often as it comes."""
    gather = F.collect_list if repeats else F.collect_set
    return df.groupBy(member).agg(F.array_sort(gather(item)).alias(name))
