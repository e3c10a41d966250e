"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import spread

#: Rows of one Arrow batch: at a few KB a text a batch is some MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one of fewer scan tasks than there are cores is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tuned(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, so that a batch of very long texts fits a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one of this machine in local mode (tests); on a
    cluster, where executors couldn't see each other's files there, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of this session's stored() that cleanup() has not deleted yet.
_made: list[str] = []


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. options: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/siltstone-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of stored tables, for cleanup()."""
    return len(_made)


def cleanup(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that stored() has written since a mark(), but for the last `keep`. Call it once the results made of
    them are written: data frames over deleted tables can't be read any more."""
    gone = _made[since : len(_made) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since : since + len(gone)]


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def held_out(doc_id: str, n: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, n) == rest, F.lit(False))


def uniform(col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed only."""
    return F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, most: int, seed: int) -> DataFrame:
    """(doc_id, label, text) of about `most` labelled training rows.

    The sample is drawn among the labels by a hash of the id, so it is of bounded size before it meets the texts and may
    be broadcast; no text is shuffled. Several labels of one document: the largest counts. Labels other than 0 and 1 and
    null ids take no part."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    half = most / max(1, len(counts))
    shares = {k: min(1.0, max(half, most - (sum(counts.values()) - n)) / n) for k, n in counts.items()}
    chosen = rows.where(reduce(lambda a, b: a | b, [(F.col("label") == k) & (uniform("doc_id", seed) < F.lit(share)) for k, share in shares.items()], F.lit(False)))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Nulls as empty texts."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
