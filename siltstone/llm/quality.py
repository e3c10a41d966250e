"""Operator 5: quality by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text train a classifier that minimises the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss, over piecewise-linear functions of dense text statistics; where the second term turns negative its
gradient is reversed, as published. The class prior pi is estimated too: a first classifier of positives against unlabelled
texts ranks both, and pi is the least ratio, over score thresholds, of the unlabelled share above to the positives' share
above, each with its sampling error. Negative labels are not used.

Null and empty texts are scored as texts without words. Without positives or unlabelled texts every score is the prior
0.5. Each row of documents gives one row, also rows of repeated or null
ids; null ids are not learned from and never held out. Whole texts are read, very long ones too, one at a time. Of several
labels of one id the largest counts; others than 0 and 1 don't. A score at the threshold counts as reached. Further columns,
whatever they are called, aren't read; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, held_out, labelled_sample, sigmoid, table, tuned, uniform

NAMES = ("log_chars", "word_len", "different", "repeats", "lines_same", "capitals", "digits", "pipes", "symbols", "bangs", "stops", "commas", "spaces", "long_words", "upper_words", "non_ascii", "brackets", "short_words")
_CLASSES = {"digits": b"0123456789", "pipes": b"|", "symbols": b"#$%&*@^~=+<>\\/_", "bangs": b"!?", "stops": b".", "commas": b",;:", "spaces": b" \t\n\r", "brackets": b"()[]{}\"'"}
_CLASS = {k: np.frombuffer(v, dtype=np.uint8) for k, v in _CLASSES.items()}


def features(text: str) -> list[float]:
    b = text.encode("utf-8", "replace")
    if not b:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    n, ws, low = len(b), text.split(), text.lower().split()
    m = max(1, len(ws))
    share = {k: float(count[v].sum()) / n for k, v in _CLASS.items()}
    lines = text.split("\n")
    lengths = np.fromiter(map(len, ws), dtype=np.int32, count=len(ws))
    capitals, wide = float(count[0x41:0x5B].sum()), float(count[0xC0:].sum())
    return [
        float(np.log1p(len(text))), float(lengths.sum()) / m, len(set(low)) / m, sum(map(eq, low, low[1:])) / m, 1 - len(set(lines)) / len(lines),
        capitals / max(1.0, capitals + wide + float(count[0x61:0x7B].sum())), share["digits"], share["pipes"], share["symbols"], share["bangs"], share["stops"], share["commas"], share["spaces"],
        float((lengths > 14).sum()) / m, sum(map(str.isupper, ws)) / m, wide / n, share["brackets"], float((lengths < 4).sum()) / m,
    ]


class Additive:
    """Piecewise-linear functions of each feature, as a linear model over hat functions at quantiles."""

    def __init__(self, x: np.ndarray, knots: int = 12):
        self.knots = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, knots))) for f in range(x.shape[1])]
        self.w, self.b = np.zeros(sum(map(len, self.knots))), 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for f, k in enumerate(self.knots):
            if len(k) == 1:
                parts.append(np.ones((len(x), 1)))
                continue
            v = np.clip(x[:, f], k[0], k[-1])
            at = np.clip(np.searchsorted(k, v, side="right") - 1, 0, len(k) - 2)
            right = (v - k[at]) / (k[at + 1] - k[at])
            hat = np.zeros((len(x), len(k)))
            hat[np.arange(len(x)), at], hat[np.arange(len(x)), at + 1] = 1 - right, right
            parts.append(hat)
        return np.concatenate(parts, axis=1).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.w + self.b

    def train(self, gradient, steps: int, rate: float = 0.3, l2: float = 1e-5) -> None:
        """Adam; gradient(w, b) gives both derivatives."""
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            gw, gb = gradient(self.w, self.b)
            g = np.append(gw + l2 * self.w, gb)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]


def prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """The least ratio of shares above a threshold, with a bound on their sampling errors, at thresholds that keep at
    least `least` of the positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 60))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(20) / 2 / len(positive)) + np.sqrt(np.log(20) / 2 / len(unlabelled))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def risk(p: np.ndarray, u: np.ndarray, pi: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """The two parts of the unbiased risk under logistic loss: of positives, and of negatives as the unlabelled have it less
    what positives make of that. Their sum is the risk; the non-negative one counts the second as 0 where it is negative."""
    zp, zu = p @ w + b, u @ w + b
    return pi * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - pi * float(np.logaddexp(0, zp).mean())


def step(p: np.ndarray, u: np.ndarray, pi: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Derivatives by w and b of what a step descends: the risk, or the negatives' part turned around where it is negative
    (overfitted: climb back)."""
    zp, zu = p @ w + b, u @ w + b
    gp_plus, gp_minus, gu_minus = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if risk(p, u, pi, w, b)[1] >= 0:
        gp, gu = pi * gp_plus - pi * gp_minus, gu_minus
    else:
        gp, gu = pi * gp_minus, -gu_minus
    return p.T @ gp + u.T @ gu, gp.sum() + gu.sum()


def learn(x_p: np.ndarray, x_u: np.ndarray, steps: int = 200) -> tuple[Additive | None, float]:
    """The classifier and the prior from features of positives and unlabelled texts."""
    if len(x_p) < 5 or len(x_u) < 5:
        return None, 0.5
    model = Additive(np.concatenate([x_p, x_u]))
    p, u = model.basis(x_p), model.basis(x_u)
    odd_p, odd_u = np.arange(len(p)) % 2 == 1, np.arange(len(u)) % 2 == 1

    def first(w, b):  # positives against unlabelled texts, on one half
        gp, gu = -sigmoid(-(p[odd_p] @ w + b)), sigmoid(u[odd_u] @ w + b)
        return p[odd_p].T @ gp / len(gp) + u[odd_u].T @ gu / len(gu), gp.mean() + gu.mean()

    model.train(first, steps // 2)
    pi = prior(p[~odd_p] @ model.w + model.b, u[~odd_u] @ model.w + model.b)

    model.w, model.b = np.zeros_like(model.w), float(np.log(pi / (1 - pi)))
    model.train(lambda w, b: step(p, u, pi, w, b), steps)
    return model, pi


def fit(documents: DataFrame, labels: DataFrame, train, most: int = 12_000, seed: int = 3) -> tuple[Additive | None, float]:
    """From bounded samples, drawn by a hash of the id: about `most` / 2 trusted positives and as many unlabelled texts,
    which are drawn among all training rows whether labelled or not."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    def matrix(rows: DataFrame) -> np.ndarray:
        got = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(featured, "doc_id long, x array<double>").collect()
        got.sort(key=lambda r: r["doc_id"])
        return np.array([r["x"] for r in got]).reshape(-1, len(NAMES))

    positive = labelled_sample(documents, labels.where("quality = 1"), "quality", train, most // 2, seed)
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & train)
    unlabelled = rows.where(uniform("doc_id", seed + 1) < min(1.0, most / 2 / max(1, rows.count())))
    return learn(matrix(positive), matrix(unlabelled))


def scored(documents: DataFrame, model: tuple[Additive | None, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, _ = shared.value
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            p = sigmoid(fitted.margin(np.array([features(t) for t in texts]))) if fitted and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels, ~held_out("doc_id", 5, 0))
    return scored(documents, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
