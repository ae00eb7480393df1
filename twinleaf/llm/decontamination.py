"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built on the driver and broadcast; documents stream through it in the
tasks that read them, so there is no shuffle. Benchmarks of more words than `shard_words` are split into several
automata, each broadcast to one more pass over the rows, so no broadcast exceeds that bound. An automaton step needs
Python objects, so only runs of words whose neighbouring pairs all occur in the items reach it: every longer match
is inside such a run.

A word is hit if it lies in an occurrence of a window: `window` consecutive item words, or a whole item that is shorter.

Edge cases: null texts and items without words hit nothing; items with equal words are all reported; a null item id is
left out; repeated rows are judged one by one; other columns pass through clean() untouched; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import carried, frugal, ship

U64 = np.uint64
WINDOW = 10


def item_words(text: str | None) -> np.ndarray:
    for _, _, data, offsets in tv.slices(pa.array([text], pa.large_string())):
        return tv.words(data, offsets, tv.ALNUM)[0]
    return np.zeros(0, U64)


class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        items = [(name, h) for name, h in items if len(h)]
        self.names = [name for name, _ in items]
        self.shortest = min((min(len(h), window) for _, h in items), default=0)
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, U64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> U64(44)).astype(np.int64)] = True
        ids = [np.searchsorted(self.vocabulary, h) for _, h in items]
        width = max(len(self.vocabulary), 1)
        self.pairs = np.unique(np.concatenate([w[:-1] * width + w[1:] for w in ids])) if ids else np.zeros(0, np.int64)
        self.goto: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [w.tolist() for w in ids]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.full: dict[int, set[int]] = {}  # windows that end in a state
        self.short: dict[int, list[tuple[int, int]]] = {}  # whole short items that end in it: length, item
        for j, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self.goto[state][word]
                if i + 1 >= window:
                    self.full.setdefault(self._cut(state, window), set()).add(j)
            if len(sequence) < window:
                self.short.setdefault(self._cut(state, len(sequence)), []).append((len(sequence), j))

    def _extend(self, last: int, word: int) -> int:
        goto, link, length = self.goto, self.link, self.length
        at = goto[last].get(word)
        if at is not None:
            return at if length[at] == length[last] + 1 else self._clone(last, word, at)
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in goto[p]:
            goto[p][word] = new
            p = link[p]
        if p != -1:
            q = goto[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = len(self.goto)
        self.goto.append(dict(self.goto[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.goto[p].get(word) == q:
            self.goto[p][word] = copy
            p = self.link[p]
        return copy

    def _cut(self, state: int, size: int) -> int:
        """State of the suffix of `size` words of a match that ends in `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stream(self, sequence: list[int], items: set[int]) -> list[tuple[int, int]]:
        """Hit spans of the sequence (ends exclusive, in order of their ends); adds the items found."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.goto[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.goto[state]:
                state = self.goto[state][word]
                matched += 1
            if matched >= self.window:
                items |= self.full.get(self._cut(state, self.window), frozenset())
                out.append((i + 1 - matched, i + 1))
            if self.short:
                up, most = state, matched
                while up > 0:
                    for size, j in self.short.get(up, ()):
                        if size <= most:
                            items.add(j)
                            out.append((i + 1 - size, i + 1))
                    up = self.link[up]
                    most = self.length[up]
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]:
        """(word starts, word ends, documents' offsets in the words, hit flags, items by document)."""
        h, starts, ends, at = tv.words(data, offsets, tv.ALNUM)
        hit, found = np.zeros(len(h), bool), {}
        if not self.shortest or not len(h):
            return starts, ends, at, hit, found
        ids = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> U64(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[spot] == h[some]
        ids[some[same]] = spot[same]
        known = ids >= 0
        # joined[i]: words i-1 and i of one document stand side by side in an item
        joined = np.zeros(len(h) + 1, bool)
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            keys = ids[both - 1] * len(self.vocabulary) + ids[both]
            spot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[both[self.pairs[spot] == keys]] = True
        joined[at[1:-1]] = False
        joined[0] = joined[-1] = False
        begin = np.flatnonzero(known & ~joined[:-1])
        stop = np.flatnonzero(known & ~joined[1:]) + 1
        for k in np.flatnonzero(stop - begin >= self.shortest):
            a, b = int(begin[k]), int(stop[k])
            items: set[int] = set()
            for x, y in self.stream(ids[a:b].tolist(), items):
                hit[a + x : a + y] = True
            if items:
                found.setdefault(int(np.searchsorted(at, a, "right")) - 1, set()).update(items)
        return starts, ends, at, hit, found


def shards(benchmark: DataFrame, window: int, shard_words: int, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast automata over all items, each of about shard_words words at most (a longer item gets its own)."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    out, held, size = [], [], 0
    for r in rows.toLocalIterator():
        h = item_words(r.t)
        if held and size + len(h) > shard_words:
            out.append(spark.sparkContext.broadcast(Automaton(held, window)))
            held, size = [], 0
        held.append((r.i, h))
        size += len(h)
    return [*out, spark.sparkContext.broadcast(Automaton(held, window))]


_SPANS = "array<struct<a:int,b:int>>"


@frugal
def _mark(batches: Iterator[pa.RecordBatch], automaton, n_rest: int) -> Iterator[pa.RecordBatch]:
    """Columns: text, spans, items, then n_rest others. Adds this automaton's hit word spans and item ids to the lists."""
    machine = automaton.value
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        for first, end, data, offsets in tv.slices(batch.column(0)):
            rest = batch.slice(first, end - first)
            spans, items = rest.column(1).to_pylist(), rest.column(2).to_pylist()
            _, _, at, hit, found = machine.documents(data, offsets)
            for i, ids in found.items():
                flags = np.concatenate([[0], hit[at[i] : at[i + 1]].astype(np.int8), [0]])
                edges = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
                spans[i] = merged([*((x["a"], x["b"]) for x in spans[i]), *map(tuple, edges.tolist())])
                items[i] = sorted({*items[i], *(machine.names[j] for j in ids)})
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), *(rest.column(3 + j) for j in range(n_rest))], ["t", "spans", "items", *(f"c{j}" for j in range(n_rest))])


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def _finish(batches: Iterator[pa.RecordBatch], n_rest: int) -> Iterator[pa.RecordBatch]:
    """Replaces columns 0 to 2 by the text without hit spans and the document's counts."""
    for batch in batches:
        for first, end, data, offsets in tv.slices(batch.column(0)):
            rest = batch.slice(first, end - first)
            starts, ends = tv.spans(tv.ALNUM[data], offsets)
            at = np.searchsorted(starts, offsets)
            n_hit, texts, sha = [], [], []
            for i, (spans, items) in enumerate(zip(rest.column(1).to_pylist(), rest.column(2).to_pylist(), strict=True)):
                text, pos = b"", offsets[i]
                for x in spans:
                    text += data[pos : starts[at[i] + x["a"]]].tobytes()
                    pos = ends[at[i] + x["b"] - 1]
                texts.append(text + data[pos : offsets[i + 1]].tobytes())
                n_hit.append(sum(x["b"] - x["a"] for x in spans))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            n_words = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [*(rest.column(3 + j) for j in range(n_rest)), pa.array(texts, pa.binary()).cast(pa.string()), rest.column(1), rest.column(2), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(sha, pa.string())],
                [*(f"c{j}" for j in range(n_rest)), "text", "spans", "items", "n_words", "n_hit", "items_sha256"],
            )


@frugal
def _mark_and_finish(batches: Iterator[pa.RecordBatch], automaton, n_rest: int) -> Iterator[pa.RecordBatch]:
    """Both steps in one worker."""
    yield from _finish(_mark(batches, automaton, n_rest), n_rest)


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shard_words: int = 1_000_000) -> DataFrame:
    """docs with `text_col` cut by the hit spans, and clean_spans (word numbers), clean_items, n_words, n_hit, items_sha256 appended."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    others = [f for i, f in enumerate(docs.schema.fields) if i != at]
    names = [f"c{i}" for i in range(len(others))]
    out = docs.toDF(*("t" if i == at else names[i - (i > at)] for i in range(len(docs.columns))))
    out = out.select("t", F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"), *names)
    *earlier, last = shards(benchmark, window, shard_words)
    for automaton in earlier:
        out = out.mapInArrow(partial(_mark, automaton=automaton, n_rest=len(names)), carried(others, before=f"t string, spans {_SPANS}, items array<string>"))
    tail = f"text string, spans {_SPANS}, items array<string>, n_words long, n_hit long, items_sha256 string"
    out = out.mapInArrow(partial(_mark_and_finish, automaton=last, n_rest=len(names)), carried(others, after=tail))
    back = [F.col("text").alias(text_col) if i == at else F.col(names[i - (i > at)]).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*back, F.col("spans").alias("clean_spans"), F.col("items").alias("clean_items"), "n_words", "n_hit", "items_sha256")


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = annotate(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("clean_items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without hit spans; rows of which more than max_coverage of the words are hit go altogether."""
    found = annotate(docs, benchmark, text_col, window, **options)
    tail = ["spans", "items", "n_words", "n_hit", "sha"]
    plain = found.toDF(*(f"c{i}" for i in range(len(docs.columns))), *tail)
    return plain.where(F.col("n_hit") <= F.greatest("n_words", F.lit(1)) * F.lit(max_coverage)).drop(*tail).toDF(*docs.columns)
