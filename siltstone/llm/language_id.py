"""Operator 1: language identification by error-correcting output codes.

Every learned language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams of the whole
lower-cased text is trained to predict it (logistic loss); a text's language is the codeword of the least weighted loss,
each bit counting by how well it was learned for that language. Two codewords about equally near flag ambiguity.

Texts that are null or hold no letter, and all texts where no language could be learned, get `und` and score 0. Rows with null
languages, texts or ids are predicted but not learned from. Whole texts are read, very long ones too, one at a time. Of
languages at equal loss the first by name is predicted, and the row is ambiguous. Repeated rows each get a row; further columns,
whatever they are called, aren't read, and stay as they are in the stage; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, held_out, sigmoid, table, tuned, uniform

DIMS = 2048
UND = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all splits for up to 6 languages, else the best of 64 random dense codes of 10 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        cols = [[1 if i == 0 else (1 if (m >> (i - 1)) & 1 else -1) for i in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(cols, dtype=float).T
    rng, bits, best, least = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if apart > least:
            best, least = code, apart
    return best


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams (2 to 4) of the whole text, one row a text."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503)
        grams = [two]
        if len(b) > 2:
            grams.append(two[:-1] * np.uint32(31) + b[2:] * np.uint32(2246822519))
        if len(b) > 3:
            grams.append(grams[1][:-1] * np.uint32(37) + b[3:] * np.uint32(3266489917))
        for g in grams:
            out[i] += np.bincount((g ^ (g >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(21), minlength=DIMS)
        total = out[i].sum()
        if total:
            out[i] /= total
    return np.sqrt(out)


class Model:
    """Languages, their codewords, the classifiers' weights and the decoding weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 200):
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        self.w, self.b = np.zeros((DIMS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
        if not bits or not len(x):
            self.weight = np.ones_like(self.code)
            return
        target, share = self.code[y], np.bincount(y, minlength=len(languages)) / len(y)
        each = (1.0 / np.maximum(share[y], 1e-9))[:, None] / len(languages) / len(y)
        mw, vw, mb, vb = (np.zeros_like(a) for a in (self.w, self.w, self.b, self.b))
        for t in range(1, steps + 1):  # Adam on the class-balanced logistic loss of all bits at once
            g = -(target * sigmoid(-target * (x @ self.w + self.b)) * each).astype(np.float32)
            for p, grad, m, v in ((self.w, x.T @ g + 1e-5 * self.w, mw, vw), (self.b, g.sum(0), mb, vb)):
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.999 * v + 0.001 * grad * grad
                p -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        right = np.sign(x @ self.w + self.b) == target
        self.weight = np.stack([right[y == k].mean(0) if (y == k).any() else np.ones(bits) for k in range(len(languages))])
        self.weight /= np.maximum(self.weight.sum(1, keepdims=True), 1e-9)

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each text against each codeword."""
        margin = np.clip(x @ self.w + self.b, -20, 20)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None]))
        return (loss * self.weight[None]).sum(2)

    def predict(self, texts: list[str], gap: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        pred, score, unsure = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        rows = [i for i, t in enumerate(texts) if self.languages and any(map(str.isalpha, t))]
        step = max(1, min(256, 2_000_000 // max(1, self.code.size)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            d = self.losses(features([texts[i] for i in part]))
            best = d.argmin(1)
            p = np.exp(-4.0 * (d - d.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            near = np.sort(d, axis=1)
            for j, i in enumerate(part):
                pred[i], score[i] = self.languages[best[j]], p[j, best[j]]
                unsure[i] = len(self.languages) > 1 and near[j, 1] - near[j, 0] < gap
        return pred, score, unsure


def fit(documents: DataFrame, train, most: int = 8000, least: int = 20, seed: int = 11) -> Model:
    """Learns from a bounded sample: about `most` documents, drawn by a hash of the id alike for each
    language. Every language is learned; many have smaller samples each, but not under `least` documents."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & train)
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.zeros((0, DIMS)), np.zeros(0, dtype=int))
    each = max(least, most // len(counts))
    share = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").where(uniform("doc_id", seed) < F.col("share"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            for at in range(0, len(texts), 256):
                x = features(texts[at : at + 256]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([column(batch, "lang").slice(at, 256), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = chosen.select("text", "lang").mapInArrow(featured, "lang string, x binary").collect()
    got = sorted(((r["lang"], bytes(r["x"])) for r in got))
    languages = sorted({r[0] for r in got})
    at = {k: i for i, k in enumerate(languages)}
    x = np.stack([np.frombuffer(r[1], dtype=np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIMS), dtype=np.float32)
    return Model(languages, x, np.array([at[r[0]] for r in got], dtype=int))


def identify(documents: DataFrame, model: Model, gap: float = 0.05) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: DIMS x bits

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, unsure = shared.value.predict([t or "" for t in column(batch, "text").to_pylist()], gap)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, lang_pred string, score double, ambiguous boolean")


def kept(documents: DataFrame, model: Model, gap: float = 0.05) -> DataFrame:
    """The rows of documents that aren't rejected: those without letters go, and the ambiguous ones, whose two nearest
    languages are less than `gap` apart, however many there are. All columns stay."""
    shared, schema = documents.sparkSession.sparkContext.broadcast(model), documents.schema

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, _, unsure = shared.value.predict([t or "" for t in column(batch, "text").to_pylist()], gap)
            good = np.array([p != UND for p in pred], dtype=bool) & ~unsure
            if not shared.value.languages:  # nothing learned: only texts without letters go
                good = np.array([any(map(str.isalpha, t or "")) for t in column(batch, "text").to_pylist()], dtype=bool)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(filtered, schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(tuned(spark), sf_dir, "documents")
    out = identify(documents, fit(documents, ~held_out("doc_id", 5, 0)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is undetermined go."""
    tuned(spark)
    return kept(docs, fit(docs, ~held_out("doc_id", 5, 0)))
