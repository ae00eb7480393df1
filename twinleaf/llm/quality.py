"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A document's n-grams are its words and word pairs in two readings: as they are (lower-cased) and as shapes (letter case, length,
last byte, whether the word repeats the one before), so that junk made of words never seen before is recognised too. Each reading
is a sparse vector of n-gram frequencies; a score is its dot product with the weights, computed by gathering weights, never by
building the vector. Weights are trained on the driver on at most about `sample` labelled documents; they are a fixed number of
buckets, so the broadcast has a fixed size. The bias alone starts from the share of label 1 and follows plain adaptive descent.

Edge cases: a null or empty text has only the bias; without labels of both kinds every score is the smoothed share of label 1;
repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import carried, frugal, labelled_sample, ship

U64 = np.uint64
BITS = 18
READINGS = 4
CUT = 0.3


def _buckets(h: np.ndarray, reading: int) -> np.ndarray:
    return (tv.mix(h + U64(reading)) >> U64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each reading: buckets of all n-grams in order, and documents' offsets in them."""
    h, starts, ends, at = tv.words(data, offsets)
    if not len(h):
        return [(np.zeros(0, np.int64), at)] * READINGS
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    n_upper = upper[ends] - upper[starts]
    first_up = (data[starts] >= 65) & (data[starts] <= 90)
    size = ends - starts
    case = np.where(n_upper == 0, 0, np.where(first_up & (n_upper == 1), 1, np.where(n_upper * 2 >= size, 3, 2)))
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[np.minimum(at[:-1], len(h) - 1)] = 0
    last = data[ends - 1].astype(np.int64)
    last[((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)] = 0
    shape = tv.mix((((last * 8 + np.minimum(size // 4, 7)) * 4 + case) * 2 + same).astype(U64))
    out = []
    for k, tokens in enumerate((h, shape)):
        out.append((_buckets(tokens, 2 * k), at))
        # a pair belongs to the document of its first word; pairs across documents go to no one
        inside = np.ones(len(h), bool)
        inside[at[1:][at[1:] > 0] - 1] = False
        pairs = np.zeros(len(h), np.int64)
        pairs[:-1] = _buckets(tv.ngram_hashes(tokens, 2), 2 * k + 1)
        kept = np.concatenate([[0], np.cumsum(inside)])
        out.append((pairs[inside], kept[at]))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for k, (buckets, at) in enumerate(features(data, offsets)):
            n = np.diff(at)
            z += tv.segment_sums(self.weights[k][buckets], at) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[str, int]], epochs: int = 2, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> Model:
    """FTRL-proximal, one document at a time."""
    positive = sum(y for _, y in rows)
    prior = float(np.log((positive + 1) / (len(rows) - positive + 1)))
    if positive in (0, len(rows)):
        return Model(np.zeros((READINGS, 1 << BITS), np.float32), prior)
    vectors = []
    for a, b, data, offsets in tv.slices(pa.array([t for t, _ in rows], pa.large_string())):
        parts = features(data, offsets)
        for i in range(b - a):
            index, value = [], []
            for k, (buckets, at) in enumerate(parts):
                found, n = np.unique(buckets[at[i] : at[i + 1]], return_counts=True)
                index.append(found + (k << BITS))
                value.append(n / np.sqrt(max(at[i + 1] - at[i], 1)))
            vectors.append((np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)))
    size = READINGS << BITS
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = prior, 0.0
    labels = [y for _, y in rows]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = vectors[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            g = (p - labels[i]) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
            bias_n += (p - labels[i]) ** 2
            bias -= 0.05 * (p - labels[i]) / np.sqrt(1 + bias_n)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.reshape(READINGS, -1).astype(np.float32), bias)


@frugal
def _score(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [model.value.scores(data, offsets) for _, _, data, offsets in tv.slices(batch.column(text))]
        score = np.concatenate([*parts, np.zeros(0)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, target: str = "quality", sample: int = 4000):
    """Broadcast model from about `sample` labelled rows at most that `allowed` (over doc_id) lets in."""
    return docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, target, allowed, sample)))


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with `score` appended."""
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    out = plain.mapInArrow(partial(_score, model=model, text=docs.columns.index(text_col)), carried(docs.schema.fields, after="score double"))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), "score")


def keep(docs: DataFrame, model, least: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of docs that score `least` or more, with its columns alone."""
    scored = score(docs, model, text_col)
    plain = scored.toDF(*(f"c{i}" for i in range(len(docs.columns))), "score")
    return plain.where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def digest(docs: DataFrame, model, held_out: Column) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
