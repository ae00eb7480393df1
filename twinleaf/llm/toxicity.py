"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of the hashed embeddings of the word and of its first bytes (so inflected forms meet). Filters of
several widths slide over the words; each filter's largest response in the document feeds a logistic output. Gradients reach only
the positions that held a maximum. Languages are mixture components over frequent word buckets, found in the training texts
without any label; within each the cut of best F1 on texts kept from training is moved to 0.3.

Only texts are read by a score. Weights have a fixed number of buckets and are trained on the driver on at most about `sample`
labelled documents, so the broadcast has a fixed size. Whole texts are scored: maxima are taken over all their words.

Edge cases: a null or empty text has no words and gets the score of all-zero responses; without labels of both kinds every score
is the smoothed share of label 1; repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
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
BITS = 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
#: Sampled rows that languages are found from; their bucket counts stand in the driver's memory.
LANGUAGE_ROWS = 3000
LANG_BITS = 10
#: A bucket learns only if so many training documents have it: what stands in one or two would be learnt by heart.
LEAST_DOCUMENTS = 4
LANGUAGES = 6
CUT = 0.3


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each word: itself, then its first bytes; its bucket for languages; offsets of documents in the words)."""
    kept = tv.ALNUM[data]
    starts, ends = tv.spans(kept, offsets)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((len(PREFIXES) + 1, 0), np.int64), np.zeros(0, np.int64), at
    all_starts = np.tile(starts, len(PREFIXES) + 1)
    all_ends = np.concatenate([ends, *(np.minimum(starts + n, ends) for n in PREFIXES)])
    h = tv.span_hashes(data, all_starts, all_ends, tv.LOWER_TABLE).reshape(len(PREFIXES) + 1, -1)
    salted = np.stack([tv.mix(x + U64(k)) for k, x in enumerate(h)])
    return (salted >> U64(64 - BITS)).astype(np.int64), (h[0] >> U64(64 - LANG_BITS)).astype(np.int64), at


class Model:
    def __init__(self, prior: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.prior = prior
        self.embedding = np.zeros((len(PREFIXES) + 1, 1 << BITS, DIM), np.float32)
        self.filters = {w: (rng.normal(0, 0.3, (w, DIM, FILTERS)) / w).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3  # the first dimension starts as evidence for label 1
        self.shift = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full((len(WIDTHS), FILTERS), 0.3, np.float32)
        self.bias = np.float32(prior)
        self.language = np.zeros((1 << LANG_BITS, 1), np.float32)
        self.move = np.zeros(1, np.float32)
        self.fitted = False

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        x = self.embedding[0][buckets[0]]
        for k in range(1, len(buckets)):
            x = x + self.embedding[k][buckets[k]]
        return x

    def stacked(self) -> np.ndarray:
        """All filters' parts, one row each: widths, positions in the width, filters."""
        return np.concatenate([self.filters[w][j].T for w in WIDTHS for j in range(w)])

    def responses(self, x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each width, filters by words: responses at each word; a window ends with its document."""
        parts = self.stacked() @ x.T
        out, row = [], 0
        for width in WIDTHS:
            r = parts[row * FILTERS : (row + 1) * FILTERS]
            for j in range(1, width):
                moved = parts[(row + j) * FILTERS : (row + j + 1) * FILTERS]
                for end in at[1:-1]:  # what lies in the next document counts as nothing
                    moved[:, end : end + j] = 0
                r[:, : max(len(x) - j, 0)] += moved[:, j:]
            out.append(r)
            row += width
        return out

    def pooled(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Largest rectified responses of each document: documents, widths, filters."""
        out = np.zeros((len(at) - 1, len(WIDTHS), FILTERS), np.float32)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            for k, r in enumerate(self.responses(x, at)):
                out[full, k] = np.maximum(np.maximum.reduceat(r, at[:-1][full], axis=1).T + self.shift[k], 0)
        return out

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, lang, at = word_buckets(data, offsets)
        z = self.bias + (self.pooled(self.embedded(buckets), at) * self.out).sum(axis=(1, 2))
        return z + self.move[self.languages(lang, at)]

    def languages(self, lang: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.stack([tv.segment_sums(self.language[:, k][lang], at) for k in range(self.language.shape[1])])
        return total.argmax(axis=0)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-self.prior)))
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets).astype(np.float64), -30, 30)))


class Corpus:
    """Buckets of training texts."""

    def __init__(self, texts: list[str]):
        self.buckets, self.lang = [], []
        for a, b, data, offsets in tv.slices(pa.array(texts, pa.large_string())):
            buckets, lang, at = word_buckets(data, offsets)
            self.buckets += [buckets[:, at[i] : at[i + 1]].astype(np.int32) for i in range(b - a)]
            self.lang += [lang[at[i] : at[i + 1]].astype(np.int16) for i in range(b - a)]

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.buckets[i] for i in rows]
        return np.concatenate(parts, axis=1).astype(np.int64), np.concatenate([[0], np.cumsum([p.shape[1] for p in parts])])


def evidence(model: Model, corpus: Corpus, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first embedding dimension starts from each bucket's smoothed log odds, so training starts near the words that matter.

    Returns which buckets may learn.
    """
    n1 = max(int(labels[rows].sum()), 1)
    ratio = n1 / max(len(rows) - n1, 1)
    often = np.zeros((len(PREFIXES) + 1, 1 << BITS), bool)
    for k in range(len(PREFIXES) + 1):
        seen = np.zeros((2, 1 << BITS))
        for i in rows:
            seen[labels[i], np.unique(corpus.buckets[i][k])] += 1
        often[k] = seen.sum(axis=0) >= LEAST_DOCUMENTS
        odds = np.log((seen[1] + 0.5 * ratio + 0.05) / (seen[0] * ratio + 0.5 * ratio + 0.05))
        model.embedding[k, :, 0] = np.clip(odds, -2, 4) * often[k] * 0.5
    return often


def descend(model: Model, corpus: Corpus, labels: np.ndarray, rows: np.ndarray, often: np.ndarray, epochs: int, rate: float, seed: int = 2) -> None:
    """Adagrad on the logistic loss, label 1 weighted up."""
    rng = np.random.default_rng(seed)
    weight = min(4.0, (len(rows) - labels[rows].sum()) / max(labels[rows].sum(), 1))
    memory = {"out": np.full_like(model.out, 1e-2), "shift": np.full_like(model.shift, 1e-2), "bias": 1e-2, "embedding": np.full(model.embedding.shape, 1e-2, np.float32)} | {w: np.full_like(f, 1e-2) for w, f in model.filters.items()}

    def step(name, value, grad):
        memory[name] = memory[name] + grad * grad
        return value - rate * grad / np.sqrt(memory[name])

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            buckets, at = corpus.batch(part)
            x = model.embedded(buckets)
            n, full = len(part), np.flatnonzero(np.diff(at) > 0)
            pooled = np.zeros((n, len(WIDTHS), FILTERS), np.float32)
            places = {}
            for k, (width, r) in enumerate(zip(WIDTHS, model.responses(x, at), strict=True)):
                where = np.zeros((n, FILTERS), np.int64)
                for i in full:
                    where[i] = r[:, at[i] : at[i + 1]].argmax(axis=1) + at[i]
                    pooled[i, k] = np.maximum(r[np.arange(FILTERS), where[i]] + model.shift[k], 0)
                places[width] = where
            z = model.bias + (pooled * model.out).sum(axis=(1, 2))
            y = labels[part]
            g = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, weight, 1.0) / n

            active = (pooled > 0) * (model.out * g[:, None, None])  # gradient at each pooled response
            move = np.zeros_like(x)
            grads = {}
            for k, width in enumerate(WIDTHS):
                grads[width] = np.zeros_like(model.filters[width])
                for j in range(width):
                    inside = np.minimum(places[width] + j, len(x) - 1)
                    ok = (places[width] + j < at[1:][:, None]) & (active[:, k] != 0)
                    d, f = np.nonzero(ok)
                    rows_x, a = inside[d, f], active[d, k, f]
                    np.add.at(grads[width][j].T, f, x[rows_x] * a[:, None])
                    np.add.at(move, rows_x, model.filters[width][j].T[f] * a[:, None])
            model.out = step("out", model.out, (pooled * g[:, None, None]).sum(axis=0).astype(np.float32) + 1e-4 * model.out)
            model.shift = step("shift", model.shift, active.sum(axis=0).astype(np.float32))
            model.bias = np.float32(step("bias", model.bias, float(g.sum())))
            for width in WIDTHS:
                model.filters[width] = step(width, model.filters[width], grads[width] + 1e-4 * model.filters[width])
            hit = np.flatnonzero(np.abs(move).sum(axis=1))
            for k in range(len(PREFIXES) + 1):
                spot, inverse = np.unique(buckets[k][hit], return_inverse=True)
                total = np.zeros((len(spot), DIM), np.float32)
                np.add.at(total, inverse, move[hit])
                total *= often[k][spot][:, None]
                memory["embedding"][k][spot] += total * total
                model.embedding[k][spot] -= rate * total / np.sqrt(memory["embedding"][k][spot])


def find_languages(model: Model, corpus: Corpus, rows: np.ndarray, rounds: int = 12) -> None:
    """Mixture of multinomials over word buckets by expectation maximisation, started from texts far apart.

    It is fitted on the first LANGUAGE_ROWS of the sampled rows, which come in the order of a hash.
    """
    counts = np.stack([np.bincount(corpus.lang[i], minlength=1 << LANG_BITS) for i in rows[:LANGUAGE_ROWS]]).astype(np.float64)
    common = np.argsort(-(counts > 0).sum(axis=0), kind="stable")[:300]
    share = counts[:, common] / np.maximum(counts[:, common].sum(axis=1, keepdims=True), 1)
    root = np.sqrt(share)
    centres = [root.mean(axis=0)]
    for _ in range(LANGUAGES):
        near = np.max([root @ c / max(np.linalg.norm(c), 1e-9) for c in centres], axis=0) + (root.sum(axis=1) == 0) * 9
        centres.append(root[int(near.argmin())])
    group = np.argmax([root @ (c / max(np.linalg.norm(c), 1e-9)) for c in centres[1:]], axis=0)
    for _ in range(rounds):
        sums = np.stack([counts[group == k].sum(axis=0) for k in range(LANGUAGES)]) + 0.1
        table = np.log(sums / sums.sum(axis=1, keepdims=True))
        group = (counts @ table.T + np.log(np.bincount(group, minlength=LANGUAGES) + 1)).argmax(axis=1)
    model.language = table.T.astype(np.float32)


def logits_and_languages(model: Model, corpus: Corpus, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z, lang = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    for part in np.array_split(np.arange(len(rows)), max(1, len(rows) // 64)):
        buckets, at = corpus.batch(rows[part])
        z[part] = model.bias + (model.pooled(model.embedded(buckets), at) * model.out).sum(axis=(1, 2))
        lang[part] = model.languages(np.concatenate([corpus.lang[i] for i in rows[part]]).astype(np.int64), at)
    return z, lang


def best_cut(z: np.ndarray, y: np.ndarray) -> float | None:
    """Logit of best F1, in the middle of the gap below the last that it takes in."""
    if min(y.sum(), (1 - y).sum()) < 8:
        return None
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    i = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    return float((z[order[i]] + z[order[min(i + 1, len(z) - 1)]]) / 2)


def calibrate(model: Model, z: np.ndarray, lang: np.ndarray, y: np.ndarray) -> None:
    """Moves each language's cut of best F1 to CUT; a language with few labels keeps the cut of all."""
    target = float(np.log(CUT / (1 - CUT)))
    everything = best_cut(z, y)
    if everything is None:  # the share of label 1 decides
        everything = float(np.quantile(z, 1 - y.mean()))
    own = [best_cut(z[lang == k], y[lang == k]) for k in range(LANGUAGES)]
    model.move = np.array([target - (everything if x is None else x) for x in own], np.float32)


def train(rows: list[tuple[str, int]], epochs: int = 4, rate: float = 0.05, folds: int = 4) -> Model:
    """Cuts come from rows that a model did not learn from: of one fold, or of all folds in turn where labels are few."""
    positive = sum(y for _, y in rows)
    prior = float(np.log((positive + 1) / (len(rows) - positive + 1)))
    model = Model(prior)
    if positive in (0, len(rows)):
        return model
    corpus, labels = Corpus([t for t, _ in rows]), np.array([y for _, y in rows])
    order = np.random.default_rng(0).permutation(len(rows))
    find_languages(model, corpus, order)

    def fitted(learn: np.ndarray) -> Model:
        out = Model(prior)
        out.language, out.move = model.language, np.zeros(LANGUAGES, np.float32)
        descend(out, corpus, labels, learn, evidence(out, corpus, labels, learn), epochs, rate)
        return out

    parts = [x for x in np.array_split(order, folds) if len(x)]
    enough = labels[parts[0]].sum() >= 60
    z, lang, y = [], [], []
    for part in parts[:1] if enough else parts:
        learn = np.setdiff1d(order, part)
        got = logits_and_languages(fitted(learn) if len(learn) else Model(prior), corpus, part)
        z.append(got[0])
        lang.append(got[1])
        y.append(labels[part])
    model = fitted(order)
    calibrate(model, *(np.concatenate(x) for x in (z, lang, y)))
    model.fitted = True
    return model


@frugal
def _score(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [model.value.scores(data, offsets) for _, _, data, offsets in tv.slices(batch.column(text))]
        score = np.concatenate([*parts, np.zeros(0)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, target: str = "toxic", sample: int = 8000):
    """Broadcast model from about `sample` labelled rows at most that `allowed` (over doc_id) lets in."""
    return docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, target, allowed, sample)))


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with `score` appended."""
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    out = plain.mapInArrow(partial(_score, model=model, text=docs.columns.index(text_col)), carried(docs.schema.fields, after="score double"))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), "score")


def digest(docs: DataFrame, model, held_out: Column) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
