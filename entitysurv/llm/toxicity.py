"""Toxicity by multiple-instance learning: sentences are instances, only documents carry labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowest

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = ".,;:!?\"'()[]{}"


class Model:
    """Noisy-or over logistic sentence scores: the bias and the weights of the features that carry evidence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias


def features(word: str) -> list[str]:
    """A word without outer punctuation gives itself and, if longer, its first four and five characters."""
    w = word.strip(STRIP)
    return [w, *("^" + w[:n] for n in (4, 5) if len(w) > n)] if w else []


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that hold a word: they end after . ! ? or a line end."""
    return [(m.start(), m.end()) for m in SENTENCE.finditer(text) if not m.group().isspace() and m.group()]


def words(sentence: str) -> list[str]:
    return WORDS.findall(sentence.lower())


def evidence(docs: Iterable[set[str]], labels: np.ndarray, least: int, g2: float, lift: float, max_features: int) -> dict[str, float]:
    """Features more frequent in texts of label 1 by a factor of lift with a log-likelihood ratio of g2 or more, the
    strongest first, with the logarithm of that factor (counts plus one half)."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    ones, zeros = Counter(), Counter()
    for d, y in zip(docs, labels, strict=True):
        (ones if y else zeros).update(d)
    found = []
    for k, a in ones.items():
        b = zeros[k]
        if a + b < least:
            continue
        p = (a + b) / (n1 + n0)
        score = 2 * sum(x * math.log(x / e) for x, e in ((a, n1 * p), (b, n0 * p), (n1 - a, n1 - n1 * p), (n0 - b, n0 - n0 * p)) if x)
        if score >= g2 and a / n1 >= lift * b / n0:
            found.append((-score, k, float(math.log((a + 0.5) / (b + 0.5) * n0 / n1))))
    return {k: w for _, k, w in sorted(found)[:max_features]}


def train(texts: list[str], labels: list[int], epochs: int = 300, rate: float = 0.3, l2: float = 1e-4, least: int = 5, g2: float = 28.0, lift: float = 8.0, max_features: int = 4096) -> Model:
    """Fit by Adagrad on whole batches: P(document) = 1 - prod(1 - P(sentence)), logistic loss on document labels.

    Only features with evidence (see there) get a weight; it starts at the logarithm of the feature's lift, and the bias
    so low that a text of thousands of plain sentences still scores near 0. Without texts of both labels every sentence scores the same,
    by the share of label 1 (0 without any text).
    """
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        return Model({}, float(np.log(p / (1 - p))))
    names = evidence(({f for w in set(words(t)) for f in features(w)} for t in texts), y, least, g2, lift, max_features)
    index = {k: i for i, k in enumerate(names)}
    known = _Weights(Model(index, 0.0))
    flat, sent, doc, s = [], [], [], 0
    for d, t in enumerate(texts):
        for a, b in sentences(t) or [(0, 0)]:
            at = sorted(index[f] for f in known.of(t[a:b]))
            flat += at
            sent += [s] * len(at)
            doc.append(d)
            s += 1
    flat, sent, doc = (np.array(x, dtype=np.int64) for x in (flat, sent, doc))
    weights, bias, s2, b2 = np.array(list(names.values())), -10.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(epochs):
        v = np.bincount(sent, weights[flat], minlength=s) + bias
        p = 1 / (1 + np.exp(-v))
        log_clean = np.bincount(doc, -np.logaddexp(0, v), minlength=len(y))
        toxic = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # the loss falls with log_clean by 1 for clean texts and rises by (1 - P) / P for toxic ones
        pull = np.where(y > 0, -(1 - toxic) / toxic, 1.0)[doc] * p / len(y)
        g = np.bincount(flat, pull[sent], minlength=len(names)) + l2 * weights / len(y)
        s2 += g * g
        weights -= rate * g / np.sqrt(s2)
        gb = pull.sum()
        b2 += gb * gb
        bias -= 0.1 * rate * gb / np.sqrt(b2)
    return Model(dict(zip(names, weights.tolist(), strict=True)), float(bias))


class _Weights(dict):
    """word (UTF-8) -> the features with weight that it has; forgotten when `limit` words are held."""

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        # The first three bytes that a word with a feature can have: most words end there.
        heads = [f.removeprefix("^").encode("utf-8", "replace") for f in model.weights]
        marks = STRIP.encode()
        self.heads = {h[:3] for h in heads} | {h + bytes((a,)) for h in heads if len(h) < 3 for a in marks} | {h + bytes((a, b)) for h in heads if len(h) < 2 for a in marks for b in marks}
        self.marks = frozenset(marks)

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        out = tuple(f for f in features(word.decode()) if f in self.model.weights)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out

    def of(self, text: str) -> set[str]:
        """Features with weight in a text; a word is what WORDS finds, which is what splitting bytes at white space gives."""
        heads, marks = self.heads, self.marks
        able = {w for w in text.lower().encode("utf-8", "replace").split() if w[:3] in heads or w[0] in marks}
        return {f for x in map(self.__getitem__, able) for f in x}


def score_text(text: str, weights: _Weights, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, offending sentences as (start, end, probability)); a text without words scores as one empty sentence."""
    model, spans = weights.model, sentences(text) or [(0, 0)]
    v = np.full(len(spans), model.bias)
    if weights.of(text):
        for i, (a, b) in enumerate(spans):
            v[i] += sum(model.weights[f] for f in sorted(weights.of(text[a:b])))
    p = 1 / (1 + np.exp(-v))
    return float(-np.expm1(-np.logaddexp(0, v).sum())), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= least)]


OFFENDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def fit_model(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000, max_bytes: int = 64 << 20, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most max_docs labelled texts, those of the lowest seeded hash of their id, as far as these have
    max_bytes in all (a longer text is left out alone).

    The bounds are on what the classifier is fitted on only; null labels, null ids and null texts are left out of it.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y is not null and _id is not null")
    h = F.xxhash64(F.lit(seed), "_id")
    marks = lowest(marks.groupBy("_id").agg(F.max("_y").alias("_y")), h, max_docs, "_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(marks), "_id")  # max_docs rows of two numbers
    one = rows.groupBy("_id").agg(F.min_by(F.struct("_y", F.octet_length("_text").alias("_size"), F.md5("_text").alias("_key")), F.md5("_text")).alias("x")).select("_id", "x.*")
    sizes = Window.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = one.where(F.col("_size") <= max_bytes).withColumn("_sum", F.sum("_size").over(sizes)).where(F.col("_sum") <= max_bytes).select("_id", "_key", "_y")  # max_docs rows at most
    texts = rows.withColumn("_key", F.md5("_text")).join(F.broadcast(chosen.drop("_y")), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    got = texts.select("_id", "_text", "_y").orderBy(h, "_id").toPandas()
    return train(got["_text"].tolist(), [int(x > 0) for x in got["_y"]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, score (noisy-or of its sentences, 0 to 1), offending (sentences with probability >= 0.5).

    One pass, no shuffle. Null and empty texts score as one sentence without words. Null ids and repeated rows are kept;
    an empty table gives no rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most max_features weights, whatever the input
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def task(batches):
        weights = _Weights(Model(*shared.value))
        for batch in batches:
            found = [score_text(x.as_py() or "", weights) for x in batch.column(1)]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in f] for _, f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, OFFENDING)], ["id", "score", "offending"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,probability:double>>"
    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def filter_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def keep(batches):
        weights = _Weights(Model(*shared.value))
        for batch in batches:
            yield batch.filter(pa.array([score_text(x.as_py() or "", weights)[0] < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
