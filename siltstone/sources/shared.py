"""Tables and files in the folder that driver and executors share, and rows numbered in order without a single task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "siltstone-shared")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Written and read back, so that lineage stays short and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that there is; an error that names them all if there is none."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_idx") -> DataFrame:
    """Rows with their place (from 0) in a total order. Rows are dealt in ranges and numbered in each; the ranges' sizes, one
    number a range, are added up in front."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in cut.groupBy("_range").count().collect())
    before, total = [], 0
    for k, n in sizes:
        before.append((k, total))
        total += n
    fronts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return cut.withColumn("_rank", rank).join(F.broadcast(fronts), "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_before", "_rank")


def file_order() -> Column:
    """A row's place in its source: file, block, and place in the block's task. For columns of a file scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


#: Scan tasks of an input that may be dealt anew; each reads some 128 MB at most.
SMALL = 32


def spread(df: DataFrame) -> DataFrame:
    """A small input, of fewer scan tasks than there are cores (and than SMALL), dealt to all cores; larger inputs stay as they
    are scanned, so that no more than a few GB are ever shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL) else df
