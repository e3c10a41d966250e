"""Operator 4: packing by concatenation and cutting.

All documents, in the order of the partitions that tokenized them, form one stream of tokens, each document ended by one
id. Pass one writes the ids with each document's offset in its partition; the prefix sums of the partitions' totals then
give every document its global offset, and pass two cuts at each multiple of the window. Only the last sequence can be
short. A document across a boundary has a piece on each side (`crosses`: the piece ends at a boundary inside it).

Null and empty texts hold the end id alone. Repeated rows are packed each; null ids stay null."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, stored, table, tuned
from siltstone.llm.tokens import tokens, vocabulary_path

WINDOW, END = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, crosses boolean"


def tokenized(documents: DataFrame, path: str, end: int = END) -> DataFrame:
    """(part, doc_id, before, n, ids): before counts the partition's ids before the document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, tok = TaskContext.get().partitionId(), 0, tokens(path)
        tail = np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            ids = [tok.ids(t or "").tobytes() + tail for t in column(batch, "text").to_pylist()]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), column(batch, "doc_id"), pa.array(first), pa.array(n), pa.array(ids, pa.binary())], ["part", "doc_id", "before", "n", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "part int, doc_id long, before long, n long, ids binary")


def starts(rows: DataFrame) -> DataFrame:
    """(part, base): prefix sums of the partitions' totals. One row of 12 bytes for each partition meets the driver."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base = np.cumsum([0] + [r["n"] for r in totals])
    return rows.sparkSession.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, base)], "part int, base long")


def pieces(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cuts the stored stream at every multiple of `window`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, doc = column(batch, "ids"), column(batch, "at").to_numpy(), column(batch, "doc_id").to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                x, g, start = np.frombuffer(ids[i].as_buffer(), dtype="<u2").astype("<u4"), int(at[i]), 0
                while start < len(x):
                    length = min(len(x) - start, window - (g + start) % window)
                    out.append((doc[i], start, length, zlib.crc32(x[start : start + length].tobytes()), len(x), (g + start) // window, (g + start) % window, start + length < len(x)))
                    start += length
            cols = list(zip(*out)) or [()] * 8
            types = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "crosses"])

    return rows.select("doc_id", "at", "ids").mapInArrow(cut, PIECES)


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    rows = stored(tokenized(documents, path or vocabulary_path(), end), "ids")
    # As many rows as there were partitions: of a known size.
    return pieces(rows.join(F.broadcast(starts(rows)), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids"), window)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(tuned(spark), sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that are left."""
    tuned(spark)
    return pack(docs)
