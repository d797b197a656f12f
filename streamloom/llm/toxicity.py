"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and
their first letters; the document's is the noisy-or of its sentences'. Only the documents'
labels are learnt from, by gradient ascent through the noisy-or, so the model finds out by
itself which sentences offend; scoring names them.

The sample that is learnt from is bounded: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled
documents, the first by a hash of the id, one text each, none over SAMPLE_CHARS characters, and
no more once they come to SAMPLE_TOTAL. One task fits on it; the driver gets the weights alone.
Weights restore the classes' shares. Scoring reads every whole text.

Null and empty texts have no sentence and score 0. Labels that are null, for no document, or
not 0 or 1 are not used; of several for one id the largest counts, and of several texts of a
labelled id the first in text order. Without a label of either class every sentence scores 0.
Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, column, small_batches

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, SAMPLE_TOTAL = 2000, 4000, 100_000, 50_000_000
#: Features kept, and documents of the sample that a feature must be in.
FEATURES, LEAST_DOCS = 8000, 4
PREFIXES = (3, 4, 5, 6)

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")


def features(word: str) -> list[str]:
    """The word itself and its first letters."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of every sentence that has words; offsets in characters."""
    out = []
    for m in _SENTENCE.finditer(text):
        if found := _WORD.findall(m[0].lower()):
            out.append((m.start(), m.end(), found))
    return out


class _Values(dict):
    """The value of each token met, worked out once; forgets all before it grows beyond `most`."""

    def __init__(self, value, most: int = 100_000):
        self.value, self.most = value, most

    def __missing__(self, token: str) -> float:
        if len(self) > self.most:
            self.clear()
        found = self[token] = math.nan if token[0] in ".!?\n" else self.value(token)
        return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        get = self.weights.get
        self.values = _Values(lambda word: sum(get(f, 0.0) for f in features(word)))

    def logits(self, text: str) -> np.ndarray:
        """The logit of every sentence that has words."""
        tokens = _TOKEN.findall(text.lower())
        value = np.fromiter(map(self.values.__getitem__, tokens), float, len(tokens))
        ends = np.isnan(value)
        sentence = np.cumsum(ends)[~ends]
        if not len(sentence):
            return np.zeros(0)
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        return self.bias + np.add.reduceat(value[~ends], starts)


def noisy_or(logits: np.ndarray) -> float:
    """1 - the product of the sentences' chances to be clean."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def gradient(theta: np.ndarray, bags: tuple, y: np.ndarray, weight: np.ndarray, l2: float) -> np.ndarray:
    """Of the weighted log likelihood through the noisy-or, less l2 / 2 times the squared feature weights.

    bags: the sentence and word of each token, each sentence's document, and the word and place of each feature of a word.
    """
    row, word, doc, of_word, place, n_words = bags
    value = np.bincount(of_word, theta[place], n_words)
    z = np.bincount(row, value[word], len(doc)) + theta[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    clean = np.bincount(doc, np.logaddexp(0, z), len(y))  # minus the log of the chance that all are clean
    push = np.where(y > 0, np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-12), -1.0) * weight
    g = push[doc] * p
    out = np.bincount(place, np.bincount(word, g[row], n_words)[of_word], len(theta))
    out[:-1] -= l2 * theta[:-1]
    out[-1] = g.sum()
    return out


def bags_of(texts: Iterable[str], labels: list[int]) -> tuple[list[str], tuple]:
    """The FEATURES that tell the classes apart best by chi square, of those in LEAST_DOCS texts, and the texts as gradient takes them."""
    words: dict[str, int] = {}
    rows, each, doc, within = [], [], [], []
    n_rows = 0
    for d, text in enumerate(texts):
        own = []
        for _, _, found in sentences(text):
            rows.append(np.full(len(found), n_rows, np.int32))
            own += [words.setdefault(w, len(words)) for w in found]
            doc.append(d)
            n_rows += 1
        each.append(np.array(own, np.int32))
        within.append(np.unique(each[-1]))
    names: dict[str, int] = {}
    of = [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
    counts = np.zeros((2, len(names)), np.int64)
    for found, label in zip(within, labels, strict=True):
        held = np.unique(np.fromiter((f for w in found.tolist() for f in of[w]), np.int64))
        counts[label, held] += 1
    k, toxic = counts.sum(axis=0), counts[1]
    n, n_toxic = len(labels), sum(labels)
    chi = (toxic - k * n_toxic / n) ** 2 / (k * (1 - k / (n + 1)))
    spelt = list(names)
    kept = sorted(sorted(np.flatnonzero(k >= LEAST_DOCS).tolist(), key=lambda f: (-chi[f], spelt[f]))[:FEATURES], key=spelt.__getitem__)
    at = {f: i for i, f in enumerate(kept)}
    pairs = np.array([(w, at[f]) for w, fs in enumerate(of) for f in fs if f in at], np.int64).reshape(-1, 2)
    none = [np.zeros(0, np.int32)]
    bags = np.concatenate(rows or none), np.concatenate(each or none), np.array(doc, np.int64), pairs[:, 0], pairs[:, 1], len(words)
    return [spelt[f] for f in kept], bags


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0, rounds: int = 300, rate: float = 0.05, l2: float = 2e-5) -> Model:
    """Full-batch Adam on the noisy-or log likelihood."""
    y = np.array(labels, float)
    if not y.any() or y.all():
        return Model({}, -np.inf)
    kept, bags = bags_of(texts, labels)
    weight = np.where(y > 0, 1.0, clean_weight)
    weight /= weight.sum()
    theta = np.zeros(len(kept) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        up = gradient(theta, bags, y, weight, l2)
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(w) for f, w in zip(kept, theta, strict=False) if abs(w) > 1e-3}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows whose crc32(key as text) mod 5 is not 0, in one task on the bounded sample; the driver gets the weights."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(F.crc32(F.col("k").cast("string")) % 5 != 0)
    marked = marked.groupBy("k").agg(F.max("y").alias("y"))
    there = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(there) < 2:
        return Model({}, -np.inf)
    order = [F.xxhash64("k"), "k"]
    drawn = marked.where("y = 1").orderBy(*order).limit(SAMPLE_TOXIC).union(marked.where("y = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    # the limits bound what is broadcast, and the least text of a key is found before anything is shuffled
    sample = texts.join(F.broadcast(drawn), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, y, total = [], [], 0
        for batch in batches:
            for t, label in zip(column(batch, "t").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                total += len(t)
                if total <= SAMPLE_TOTAL:
                    drawn.append(t)
                    y.append(label)
        toxic = sum(y)
        if toxic and toxic < len(y):
            model = fit(drawn, y, (there[0] / there[1]) / ((len(y) - toxic) / toxic))
            yield batch_of({"feature": ([*model.weights, None], pa.string()), "weight": ([*model.weights.values(), model.bias], pa.float64())})

    found = {r.feature: r.weight for r in small_batches(sample.repartition(1).sortWithinPartitions(*order)).mapInArrow(fitted, "feature string, weight double").collect()}
    return Model({f: w for f, w in found.items() if f is not None}, found.get(None, -np.inf))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """key, score, predicted, n_sentences and offending: start, end and score of each sentence of at least that score. One scan, no shuffle."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            out: list[list] = [[], [], []]
            for t in column(batch, "text"):
                whole = t.as_py() or ""
                z = model.logits(whole)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                worst = np.flatnonzero(p >= offending)
                places = sentences(whole) if len(worst) else []
                out[0].append(noisy_or(z))
                out[1].append(len(z))
                out[2].append([{"start": places[i][0], "end": places[i][1], "score": float(p[i])} for i in worst])
            yield batch_of({"k": (column(batch, "k"), None), "score": (out[0], pa.float64()), "predicted": ([int(s >= 0.5) for s in out[0]], pa.int32()), "n_sentences": (out[1], pa.int64()), "offending": (out[2], spans)})

    kind = rows.schema["k"].dataType.simpleString()
    return small_batches(rows).mapInArrow(scored, f"k {kind}, score double, predicted int, n_sentences long, offending array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("k", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of docs that score under reject, whole; one scan, no shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index(text)]).cast("string"))
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            keep = [noisy_or(model.logits(t.as_py() or "")) < reject for t in column(batch, "text")]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    out = small_batches(df).mapInArrow(kept, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]))
    return out.toDF(*docs.columns)
