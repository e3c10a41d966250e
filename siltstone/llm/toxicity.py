"""Operator 3: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a short fixed list of insults and words and word beginnings learned from labelled documents: those found in
many different toxic texts and hardly in others. The features of a whole text are lexicon densities and counts, hits near
second-person pronouns, hits written with look-alike characters, capitals, punctuation and obfuscation rates. Lexicon,
trees and calibration learn from separate parts of the labelled training rows, drawn by a hash of the id.

Null and empty texts are scored as texts without words. Without labels of both kinds every score is the share of toxic
labels (0.5 without labels). Each row of documents gives one row, also rows of repeated or null
ids; null ids are not learned from and never held out. Whole texts are read, very long ones too, one at a time. Of several
labels of one id the largest counts; others than 0 and 1 don't. A score at the threshold counts as reached. Further columns,
whatever they are called, aren't read; empty tables give no rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.boosting import Isotonic, Trees
from siltstone.llm.common import column, held_out, labelled_sample, remainder, stored, table, tuned

#: Insults that are in the lexicon from the start.
INSULTS = frozenset("clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split())
#: Second-person pronouns.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros tus".split())
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+")
_INSIDE = re.compile(r"[^\W\d_][0-9@$!|*.\-_]+[^\W\d_]")
_ENDS = ".,;:!?\"'()[]{}<>-_*|#$%&"
PREFIXES = (4, 5, 6)
NAMES = ("log_words", "hits", "density", "stem_density", "weight", "near_you", "you", "hidden", "odd", "capitals", "shouted", "marks", "punctuation", "window", "kinds")


class Lexicon:
    """Weights (log odds) of words, and of word beginnings under their length."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def weight(self, word: str) -> float:
        if (w := self.words.get(word)) is not None:
            return w
        return max((self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n), default=0.0)


class _Weights(dict):
    """Weights of words, each looked up once."""

    def __init__(self, lexicon: Lexicon, most: int = 200_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        w = self.lexicon.weight(word)
        if len(self) < self.most:
            self[word] = w
        return w


def features(text: str, weights: _Weights) -> list[float]:
    low = text.lower()
    ws = _WORD.findall(low)
    n = len(ws)
    if not n:
        return [0.0] * len(NAMES)
    w = list(map(weights.__getitem__, ws))
    hits = [i for i, x in enumerate(w) if x > 0]
    whole = [i for i in hits if ws[i] in weights.lexicon.words]
    you = [i for i, x in enumerate(ws) if x in SECOND_PERSON]
    near, j = 0, 0
    for i in hits:
        while j < len(you) and you[j] < i - 5:
            j += 1
        near += j < len(you) and you[j] <= i + 5
    odd = [y for x in low.split() if not x.isalpha() and not (y := x.strip(_ENDS)).isalpha() and _INSIDE.search(y)]
    hidden = sum(weights[re.sub(r"[^\w]|_", "", x.translate(_LOOKALIKE))] > 0 for x in odd)
    at, most = 0, 0
    for k, i in enumerate(hits):  # most hits within fifty words
        while hits[at] < i - 50:
            at += 1
        most = max(most, k - at + 1)
    letters = max(1, sum(map(len, ws)))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = sum(map(str.isupper, text.split())) if upper > 2 else 0
    marks = text.count("!") + text.count("?")
    return [
        float(np.log1p(n)), float(np.log1p(len(hits))), len(whole) / n, (len(hits) - len(whole)) / n, sum(w) / n, near / max(1, len(hits)), len(you) / n, hidden / n, len(odd) / n,
        upper / letters, shouted / n, marks / n, (len(text) - letters - text.count(" ")) / max(1, len(text)), float(most), float(len({ws[i] for i in hits})),
    ]


def lexicon(rows: DataFrame, least: int = 4, share: float = 0.02, odds: float = 12.0) -> Lexicon:
    """Learns from (label, text) rows of a bounded sample: terms in `least` and in `share` of the toxic texts, `odds` times as
    often as in others. Counts are of different texts, so copies count once."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for label, text in zip(column(batch, "label").to_pylist(), column(batch, "text").to_pylist()):
                ws = set(_WORD.findall(text.lower()))
                counts[label].update(ws | {w[:n] + "*" for w in ws for n in PREFIXES if len(w) > n})
            for label, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "label", "n"])

    texts = rows.select("label", "text").distinct()
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Lexicon(dict.fromkeys(INSULTS, 1.0), {})
    found = texts.mapInArrow(terms, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))
    ratio = ((F.col("n1") + 0.5) / n1) / ((F.col("n0") + 0.5) / n0)
    chosen = found.where((F.col("n1") >= max(least, share * n1)) & (ratio >= odds)).select("term", F.log(ratio).alias("w")).collect()
    words = dict.fromkeys(INSULTS, 3.0) | {r["term"]: float(r["w"]) for r in chosen if not r["term"].endswith("*")}
    return Lexicon(words, {r["term"][:-1]: float(r["w"]) for r in chosen if r["term"].endswith("*")})


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, calibration: Isotonic | None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts: list[str], weights: _Weights) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        p = self.trees.predict(np.array([features(t, weights) for t in texts]))
        return self.calibration.predict(p) if self.calibration else p


def fit(documents: DataFrame, labels: DataFrame, train, most: int = 16_000, seed: int = 5, few: int = 50) -> Model:
    """From about `most` labelled training documents: a half for the lexicon, 3/8 for the trees, 1/8 for calibration.

    If the last part has fewer than `few` rows or one label only, calibration is learned out of fold instead, from the rows of
    both parts: each is scored by trees that haven't seen it, and all of them then make the trees. Only where these rows are of
    one label, so that there is nothing to learn, the trees' constant score stays uncalibrated."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(8))
    rows = stored(labelled_sample(documents, labels, "toxic", train, most, seed).withColumn("part", part), "labelled")  # read three times
    lex = lexicon(rows.where("part < 4"))
    shared = documents.sparkSession.sparkContext.broadcast(lex)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value)
        for batch in batches:
            x = [features(t, weights) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "label"), column(batch, "part"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "part", "x"])

    got = rows.where("part >= 4").select(F.col("doc_id").cast("long"), "label", F.col("part").cast("int"), "text").mapInArrow(featured, "doc_id long, label int, part int, x array<double>").collect()
    got.sort(key=lambda r: r["doc_id"])
    x, y, part = np.array([r["x"] for r in got]).reshape(-1, len(NAMES)), np.array([r["label"] for r in got], dtype=float), np.array([r["part"] for r in got], dtype=int)
    last = part == 7
    if last.sum() >= few and 0 < y[last].sum() < last.sum():
        trees = Trees().fit(x[~last], y[~last])
        return Model(lex, trees, Isotonic().fit(trees.predict(x[last]), y[last]))
    trees = Trees().fit(x, y)
    if not len(y) or y.min() == y.max():
        return Model(lex, trees, None)
    return Model(lex, trees, Isotonic().fit(out_of_fold(x, y), y))


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: int = 5) -> np.ndarray:
    """Each row's score by trees of the other folds, which are dealt alike for each label."""
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        fold[y == label] = np.arange(int((y == label).sum())) % folds
    p = np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any():
            p[fold == k] = Trees().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return p


def scored(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # trees of fixed size and the lexicon

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value.lexicon)
        for batch in batches:
            p = shared.value.score([t or "" for t in column(batch, "text").to_pylist()], weights)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels, remainder("doc_id", 3) != 1)
    return scored(documents, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
