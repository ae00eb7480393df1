"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored output.

Word counts cover the whole corpus: tasks cut documents into blocks, number each block's distinct words and deal them, with their
training counts, to hash segments; a segment sums the counts and answers each block with those of its words. So every task sees only its
own words' counts, and nothing that grows with the vocabulary is broadcast.

A symbol is the end mark, one of the most frequent words, or the group of all other words of one ending. Symbols lie in classes of
MEMBERS, sorted by ending and frequency. The output factors into p(class | state) * p(member | class, state) * p(word | symbol): both
softmaxes come from the recurrent state, which has read the symbols before. A word's share of its group comes from the corpus counts,
absolutely discounted, and what is discounted is the share of all words of the group never seen in training.

Blocks are then written as symbols with their documents' sums of shares, and training and scoring read that table. The recurrent part
is trained in numpy by truncated backpropagation on all training documents; states are carried from window to window, for PIECE tokens
at most, and reset between documents. It starts from weights learnt on about `sample` shorter ones of them. In each round every task then goes on from the weights
so far over its own documents of the round, a lesson at a time, and the tasks' weights are written out and averaged by tokens. Scoring
runs many documents side by side, each from its first word to its end mark, however many windows that takes.

Edge cases: null and empty texts are their end mark alone; without any training document all counts are 0 and classes are equally likely;
repeated rows count as often as they occur and get equal scores; other columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec as tv
from .shared import discard, frugal, materialise, parallelism, ship

U64, F4 = np.uint64, np.float32
BLOCK = 1 << 21
#: Words and ending groups with a symbol of their own; with the end mark they fill CLASSES classes of MEMBERS.
TOP, ENDINGS = 671, 96
SYMBOLS = 1 + TOP + ENDINGS
CLASSES, MEMBERS = 24, 32
END = U64(0xE2D0F5E2D0F5E2D0)
HIDDEN, EMBEDDED = 16, 12
WINDOW, LANES = 32, 512
#: Rounds of averaging, each over its own share of the training documents, and the tokens that are learnt or scored at a time.
ROUNDS, LESSON = 2, 1 << 22
#: Tokens of a document that training takes with one carried state; scoring carries it to the document's end.
PIECE = 1 << 12
#: Rates of the first weights and of the first round, and characters of the longest text that the first weights learn from.
START_RATE, RATE, START_CHARS = 0.03, 0.01, 1 << 16
#: Bounds of output weights and biases, within which exponentials stay finite.
WEIGHT, BIAS = 2.5, 30.0


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end mark after each document, their endings, documents' offsets)."""
    h, starts, ends, at = tv.words(data, offsets)
    last = tv.LOWER[data[ends - 1]].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, tv.LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64) if len(h) else last
    ending = (tv.mix((before * 256 + last).astype(U64)) % U64(ENDINGS)).astype(np.uint8)
    n = len(offsets) - 1
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))
    hashes, endings = np.full(len(h) + n, END), np.zeros(len(h) + n, np.uint8)
    hashes[place], endings[place] = h, ending
    return hashes, endings, at + np.arange(n + 1)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    got = np.frombuffer(blob, np.uint8).reshape(count, -1)
    out = np.zeros((count, 8), np.uint8)
    out[:, : got.shape[1]] = got
    return out.view("<i8").ravel()


def width_of(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)


@frugal
def _blocks(batches: Iterator[pa.RecordBatch], segments: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each block a row with its documents, and a row for each segment with its distinct words there."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0
    names = ["deal", "seg", "block", "ids", "held", "sizes", "words", "endings", "counts"]
    bounds = np.array([(s << 64) // segments for s in range(segments)], U64)

    def out() -> Iterator[pa.RecordBatch]:
        block = (part << 20) + number
        tokens, endings = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        sizes = np.concatenate([np.diff(x[2]) for x in held])
        apart = pa.concat_arrays([x[4] for x in held])
        words, example, spot = np.unique(tokens, return_index=True, return_inverse=True)
        trained = np.repeat(~apart.to_numpy(zero_copy_only=False), sizes)
        counts = np.bincount(spot[trained], minlength=len(words)).astype("<u4")  # a block has fewer tokens than 2**32
        ending = endings[example]
        ids = pa.concat_arrays([x[3] for x in held])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        empty = pa.nulls(1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([(part + number) % segments], pa.int32()), pa.array([-1], pa.int32()), pa.array([block], pa.int64()), whole(ids), whole(apart), pa.array([sizes.astype("<i8").tobytes()], pa.binary()), pa.array([pack(spot, width_of(len(words)))], pa.binary()), empty, empty], names)
        cuts = np.append(np.searchsorted(words, bounds), len(words))
        rows = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
        none = pa.nulls(len(rows))
        cut = lambda x: pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(rows, pa.int32()), pa.array([block] * len(rows), pa.int64()), none.cast(pa.list_(id_kind)), none.cast(pa.list_(pa.bool_())), none.cast(pa.binary()), cut(words), cut(ending), cut(counts)], names)

    for batch in batches:
        for a, b, data, offsets in tv.slices(batch.column(0)):
            hashes, endings, at = tokenise(data, offsets)
            held.append((hashes, endings, at, batch.column(1).slice(a, b - a).cast(id_kind), batch.column(2).slice(a, b - a)))
            size += len(hashes)
            if size >= BLOCK:
                yield from out()
                held, size, number = [], 0, number + 1
    if held:
        yield from out()


def listed_words(segments: int) -> int:
    """Most frequent words that a segment names. Hashes deal the corpus's most frequent ones evenly: this is 12 deviations above the mean."""
    mean = (TOP + 1) / segments
    return min(TOP + 1, math.ceil(mean + 12 * math.sqrt(mean) + 12))


@frugal
def _sum_counts(batches: Iterator[pa.RecordBatch], listed: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment. Answers each block with its words' training counts; a row of statistics (block -1) for the segment."""
    now, rows = None, []
    names = ["block", "seg", "ids", "held", "sizes", "words", "endings", "counts", "tops"]

    def out() -> pa.RecordBatch:
        words = [np.frombuffer(r[1], U64) for r in rows]
        every, spot = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        pos = 0
        for r, mine in zip(rows, words, strict=True):  # a block has each of its words once
            total[spot[pos : pos + len(mine)]] += np.frombuffer(r[3], "<u4")
            pos += len(mine)
        ending = np.zeros(len(every), np.uint8)
        ending[spot] = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows])
        top = np.lexsort((every, -total))[:listed]
        is_top = np.zeros(len(every), bool)
        is_top[top] = True
        seen = (total > 0) & (every != END)
        mass = np.zeros(ENDINGS, np.int64)
        np.add.at(mass, ending[seen], total[seen])
        stats = np.concatenate([mass, np.bincount(ending[seen], minlength=ENDINGS), [(total == 1).sum(), (total == 2).sum(), total[every == END].sum()]]).astype("<i8")
        tops = np.stack([every[top].view(np.int64), total[top], ending[top].astype(np.int64)], axis=1).astype("<i8")
        result = [(-1, None, stats.tobytes(), None, None, tops.tobytes())]
        pos = 0
        for (block, own, _, _), mine in zip(rows, words, strict=True):
            at = spot[pos : pos + len(mine)]
            marked = np.flatnonzero(is_top[at])
            count = total[at]
            result.append((block, None, None, ending[at].tobytes(), pack(count, width_of(count.max())), np.stack([marked.astype(np.int64), mine[marked].view(np.int64)], axis=1).astype("<i8").tobytes()))
            pos += len(mine)
        none = pa.nulls(len(result))
        block, sizes, stat, endings, counts, marks = ([r[i] for r in result] for i in range(6))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([now] * len(result), pa.int32()), none.cast(pa.list_(id_kind)), none.cast(pa.list_(pa.bool_())), pa.array(sizes, pa.binary()), pa.array(stat, pa.binary()), pa.array(endings, pa.binary()), pa.array(counts, pa.binary()), pa.array(marks, pa.binary())], names)

    for batch in batches:
        segs = batch.column("seg").to_numpy()
        if (segs < 0).any():
            meta = batch.filter(pa.array(segs < 0))
            none = pa.nulls(meta.num_rows).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(meta.column(c) for c in names[:6]), none, none, none], names)
        data = batch.filter(pa.array(segs >= 0)).select(["block", "seg", "words", "endings", "counts"])
        for block, seg, *own in zip(*(c.to_pylist() for c in data.columns), strict=True):
            if seg != now:
                if rows:
                    yield out()
                now, rows = seg, []
            rows.append((block, *own))
    if rows:
        yield out()


def merged(stats: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the segments' numbers, their most frequent words with count and ending) of statistics rows."""
    numbers = sum((np.frombuffer(x, "<i8") for x, _ in stats), np.zeros(2 * ENDINGS + 3, np.int64))
    every = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, "<i8").reshape(-1, 3) for _, x in stats)])
    return numbers, every[np.lexsort((every[:, 0], -every[:, 1]))][: TOP + 1]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stats = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    if stats:
        numbers, tops = merged(stats)
        yield pa.RecordBatch.from_arrays([pa.array([numbers.astype("<i8").tobytes()], pa.binary()), pa.array([tops.astype("<i8").tobytes()], pa.binary())], ["words", "tops"])


class Vocabulary:
    """Corpus totals: symbols, their classes and masses, the discount. Its size does not grow with the corpus."""

    def __init__(self, stats: list[tuple[bytes, bytes]]):
        numbers, every = merged(stats)
        mass, kinds = numbers[:ENDINGS].copy(), numbers[ENDINGS : 2 * ENDINGS].copy()
        once, twice, self.ends = (int(x) for x in numbers[-3:])
        every = every[(every[:, 0] != END.view(np.int64)) & (every[:, 1] > 0)][:TOP]
        self.tokens = int(mass.sum()) + self.ends
        self.distinct = int(kinds.sum()) + (self.ends > 0)
        self.discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        self.mass = np.zeros(SYMBOLS, np.int64)
        self.mass[0], self.mass[1 : 1 + len(every)] = self.ends, every[:, 1]
        np.subtract.at(mass, every[:, 2], every[:, 1])
        np.subtract.at(kinds, every[:, 2], 1)
        self.mass[1 + TOP :], self.kinds = mass, kinds
        by_hash = np.argsort(every[:, 0])
        self.hashes, self.numbers = every[by_hash, 0], 1 + by_hash
        ending = np.concatenate([[-1], every[:, 2], np.full(TOP - len(every), ENDINGS), np.arange(ENDINGS)])
        place = np.empty(SYMBOLS, np.int64)
        place[np.lexsort((np.arange(SYMBOLS), -self.mass, ending))] = np.arange(SYMBOLS)
        self.classes, self.members = place // MEMBERS, place % MEMBERS
        self.exists = np.ones(SYMBOLS, bool)
        self.exists[1 + len(every) : 1 + TOP] = False

    def named(self, symbols: np.ndarray, words: np.ndarray) -> None:
        """Puts the symbols of the end mark and of frequent words (hashes) in place."""
        signed = words.view(np.int64)
        symbols[words == END] = 0
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, signed), len(self.hashes) - 1)
            hit = self.hashes[at] == signed
            symbols[hit] = self.numbers[at[hit]]

    def symbols(self, endings: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = (1 + TOP + endings.astype(np.int64)).astype(np.uint16)
        self.named(out, words)
        return out

    def shares(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its symbol."""
        out = np.zeros(len(symbols))
        own = symbols > TOP
        k, c = symbols[own].astype(np.int64), counts[own]
        out[own] = np.log10(np.where(c > 0, c - self.discount, self.discount * self.kinds[k - 1 - TOP] + 1.0) / (self.mass[k] + 1.0))
        return out


class Model:
    """Gated recurrent unit over symbols, two softmaxes above it. Input SYMBOLS is the start of a document; arrays are (feature, lane)."""

    names = ("embedding", "inward", "inward_bias", "within", "outward", "outward_bias", "member", "member_bias")

    def __init__(self, classes: np.ndarray, members: np.ndarray, mass: np.ndarray | None = None, exists: np.ndarray | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(F4)
        self.classes, self.members = classes.astype(np.int16), members.astype(np.int64)
        self.embedding = rng.normal(0, 0.5, (SYMBOLS + 1, EMBEDDED)).astype(F4)
        self.inward, self.inward_bias = scale(EMBEDDED, 3 * HIDDEN), np.zeros(3 * HIDDEN, F4)
        self.within = scale(HIDDEN, 3 * HIDDEN)
        self.outward, self.member = scale(HIDDEN, CLASSES) * F4(0.3), scale(CLASSES, HIDDEN, MEMBERS) * F4(0.1)
        # without a state, symbols are as likely as they are frequent; places without a symbol are out of the question
        weight = np.zeros((CLASSES, MEMBERS))
        weight[classes, members] = np.where(True if exists is None else exists, (0 if mass is None else mass) + 0.5, 0)
        self.outward_bias = np.log(np.maximum(weight.sum(axis=1) / weight.sum(), 1e-12)).astype(F4)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.member_bias = np.maximum(np.log(np.nan_to_num(weight / weight.sum(axis=1, keepdims=True))), -BIAS).astype(F4)

    def window(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """(state before all and after each step of (steps, lanes); states that steps start from, gates and candidates; embedded inputs).

        fresh marks steps that start from no state."""
        steps, count = inputs.shape
        put_in = self.embedding[inputs.ravel()]
        put = np.ascontiguousarray((np.dot(self.inward.T, put_in.T) + self.inward_bias[:, None]).reshape(3 * HIDDEN, steps, count).transpose(1, 0, 2))
        states = np.empty((steps + 1, HIDDEN, count), put.dtype)
        gates, candidates = np.empty((steps, 3 * HIDDEN, count), put.dtype), np.empty((steps, HIDDEN, count), put.dtype)
        states[0] = state
        befores = []
        recur, any_fresh = np.ascontiguousarray(self.within.T), fresh.any(axis=1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                before = states[t]
                if any_fresh[t]:
                    before = before.copy()
                    before[:, fresh[t]] = 0
                befores.append(before)
                all_ = np.dot(recur, before, out=gates[t])
                g = all_[: 2 * HIDDEN]  # 1 / (1 + exp): reset, then update
                g += put[t, : 2 * HIDDEN]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c = np.multiply(g[:HIDDEN], all_[2 * HIDDEN :], out=candidates[t])
                c += put[t, 2 * HIDDEN :]
                np.tanh(c, out=c)
                after = np.subtract(before, c, out=states[t + 1])
                after *= g[HIDDEN:]
                after += c
        return states, befores, gates, candidates, put_in

    def by_class(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(classes, kind="stable")
        return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))

    def log_symbols(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target symbol; states: (targets, HIDDEN)."""
        classes, members = self.classes[targets], self.members[targets]
        order, cuts = self.by_class(classes)
        out, sorted_states, sorted_members = np.empty(len(states), states.dtype), states[order], members[order]
        inside = np.empty(len(states), states.dtype)
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            d = sorted_states[a:b] @ self.member[k]
            d += self.member_bias[k]
            np.exp(d, out=d)
            inside[a:b] = d[np.arange(b - a), sorted_members[a:b]] / d.sum(axis=1)
        out[order] = inside
        for a in range(0, len(states), 2048):
            d = states[a : a + 2048] @ self.outward
            d += self.outward_bias
            np.exp(d, out=d)
            out[a : a + 2048] *= d[np.arange(len(d)), classes[a : a + 2048]] / d.sum(axis=1)
        return np.log(out)

    def _softmax_step(self, x, weights, bias, aim, share, grad_out):
        """(loss, gradients of weights and bias) of rows x; writes the rows' own gradients. share: what each row counts."""
        d = x @ weights
        d += bias
        np.exp(d, out=d)
        flat, spot = d.reshape(-1), np.arange(len(d)) * d.shape[1] + aim
        whole = d @ np.ones(d.shape[1], d.dtype)
        loss = -float((np.log(flat[spot] / whole) * share).sum())
        d *= (share / whole)[:, None]
        flat[spot] -= share
        np.dot(d, weights.T, out=grad_out)
        return loss, x.T @ d, np.ones(len(d), d.dtype) @ d

    def gradients(self, inputs, fresh, targets, weights, state):
        """(mean loss, gradients, last state): backpropagation through one window; the state before it is taken as given."""
        states, befores, gates, candidates, put_in = self.window(inputs, fresh, state)
        steps, count = inputs.shape
        kind = states.dtype
        rows = np.ascontiguousarray(states[1:].transpose(0, 2, 1)).reshape(-1, HIDDEN)
        aim = targets.ravel()
        classes, members = self.classes[aim], self.members[aim]
        share = (weights.ravel() / max(weights.sum(), 1)).astype(kind)
        out = {n: np.zeros_like(getattr(self, n)) for n in ("outward", "outward_bias", "member", "member_bias")}
        into, loss = np.empty_like(rows), 0.0
        for a in range(0, len(rows), 2048):
            part = slice(a, a + 2048)
            one, dw, db = self._softmax_step(rows[part], self.outward, self.outward_bias, classes[part], share[part], into[part])
            out["outward"] += dw
            out["outward_bias"] += db
            loss += one
        order, cuts = self.by_class(classes)
        sorted_rows, sorted_members, sorted_share, sorted_into = rows[order], members[order], share[order], np.empty_like(rows)
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            one, out["member"][k], out["member_bias"][k] = self._softmax_step(sorted_rows[part], self.member[k], self.member_bias[k], sorted_members[part], sorted_share[part], sorted_into[part])
            loss += one
        into[order] += sorted_into
        into = np.ascontiguousarray(into.reshape(steps, count, HIDDEN).transpose(0, 2, 1))
        d_put, d_all, d_recur = np.empty((steps, 3 * HIDDEN, count), kind), np.empty((3 * HIDDEN, count), kind), np.zeros((3 * HIDDEN, HIDDEN), kind)
        back, q, any_fresh = np.zeros((HIDDEN, count), kind), np.empty((HIDDEN, count), kind), fresh.any(axis=1)
        for t in range(steps - 1, -1, -1):
            r, z, u, c, before = gates[t, :HIDDEN], gates[t, HIDDEN : 2 * HIDDEN], gates[t, 2 * HIDDEN :], candidates[t], befores[t]
            back += into[t]
            dr, dz, dc = (d_put[t, i * HIDDEN : (i + 1) * HIDDEN] for i in range(3))
            np.subtract(z, 1, out=q)
            np.multiply(c, c, out=dc)
            dc -= 1
            dc *= q
            dc *= back
            np.subtract(before, c, out=dz)
            dz *= back
            dz *= z
            dz *= q
            np.subtract(r, 1, out=q)
            q *= r
            np.multiply(dc, u, out=dr)
            dr *= q
            d_all[: 2 * HIDDEN] = d_put[t, : 2 * HIDDEN]
            np.multiply(dc, r, out=d_all[2 * HIDDEN :])
            d_recur += np.dot(d_all, before.T)
            back *= z
            back += np.dot(self.within, d_all)
            if any_fresh[t]:
                back[:, fresh[t]] = 0
        flat = np.ascontiguousarray(d_put.transpose(1, 0, 2)).reshape(3 * HIDDEN, -1)
        out["within"], out["inward"], out["inward_bias"] = d_recur.T, put_in.T @ flat.T, flat.sum(axis=1)
        spot = inputs.ravel()
        out["embedding"] = np.stack([np.bincount(spot, weights=row, minlength=SYMBOLS + 1) for row in np.dot(self.inward, flat)], axis=1).astype(kind)
        return loss, out, states[steps].copy()


def lanes(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal total length, longest lane first."""
    heap = [(0, i) for i in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    total = np.zeros(count, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        load, lane = heapq.heappop(heap)
        out[lane].append(int(i))
        total[lane] = load + sizes[i]
        heapq.heappush(heap, (int(total[lane]), lane))
    return [out[i] for i in np.argsort(-total, kind="stable") if out[i]]


class Grid:
    """Documents side by side: inputs, targets and starts of documents, lane after lane; windows of them."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, rng: np.random.Generator | None = None, piece: int | None = None):
        begins = np.zeros(len(symbols), bool)
        begins[at[:-1]] = True
        if piece:  # longer documents go on in other lanes, from no state but the symbol before
            count = -(-np.diff(at) // piece)
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.append(np.repeat(at[:-1], count) + number * piece, at[-1])
        sizes = np.diff(at)
        # no more lanes than the longest document leaves work for: a step costs much the same for one lane as for a hundred
        count = int(np.clip(sizes.sum() // max(int(sizes.max()), 1024), 16, LANES))
        dealt = lanes(sizes, min(count, len(sizes)))
        order = np.concatenate([x if rng is None else rng.permutation(x) for x in dealt]).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(sizes[order])])
        self.source = np.repeat(at[order] - to[:-1], sizes[order]) + np.arange(to[-1])
        self.targets = symbols[self.source].astype(np.int16)
        self.fresh = np.zeros(len(self.targets), bool)
        self.fresh[to[:-1]] = True
        before = symbols[np.maximum(self.source - 1, 0)].astype(np.int16)
        self.inputs = np.where(begins[self.source], np.int16(SYMBOLS), before)
        self.total = np.array([int(sizes[x].sum()) for x in dealt])
        self.starts = np.cumsum(self.total) - self.total

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(live lanes, places of the window's tokens, which of them there are); lanes come longest first."""
        for a in range(0, int(self.total[0]), WINDOW):
            live = int((self.total > a).sum())
            steps = a + np.arange(min(WINDOW, int(self.total[0]) - a))[:, None]
            ok = steps < self.total[:live]
            yield live, np.where(ok, self.starts[:live] + steps, 0), ok


class Adam:
    """Moments of a model's gradients, and its steps."""

    def __init__(self, model: Model):
        self.first = {n: np.zeros_like(getattr(model, n)) for n in model.names}
        self.second = {n: np.zeros_like(getattr(model, n)) for n in model.names}
        self.step = 0

    def apply(self, model: Model, grads: dict[str, np.ndarray], share: float, pace: float) -> None:
        """share: the tokens that the gradients are a mean of, of those of a full window."""
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = F4(min(1.0, 1.0 / max(size, 1e-9)) * share)
        rate, level = F4(pace / (1 - 0.9**self.step)), F4(1 / (1 - 0.99**self.step))
        for n, g in grads.items():
            g = g * shrink
            self.first[n] *= F4(0.9)
            self.first[n] += F4(0.1) * g
            g *= g
            g *= F4(0.01)
            self.second[n] *= F4(0.99)
            self.second[n] += g
            down = np.sqrt(self.second[n] * level)
            down += F4(1e-6)
            value = getattr(model, n)
            value -= rate * self.first[n] / down
            if n in ("outward", "member"):
                np.clip(value, -WEIGHT, WEIGHT, out=value)
            elif n in ("outward_bias", "member_bias"):
                np.clip(value, -BIAS, BIAS, out=value)


def descend(model: Model, adam: Adam, symbols: np.ndarray, at: np.ndarray, rng: np.random.Generator, pace) -> int:
    """One pass over every token of every document in windows of WINDOW steps, states carried for PIECE tokens; ended lanes drop out. Tokens learnt."""
    grid = Grid(symbols, at, rng, PIECE)
    state, learnt = np.zeros((HIDDEN, len(grid.total)), F4), 0
    for live, spot, ok in grid.windows():
        n = int(ok.sum())
        _, grads, state = model.gradients(grid.inputs[spot], grid.fresh[spot] & ok, grid.targets[spot], ok.astype(F4), state[:, :live])
        adam.apply(model, grads, n / (WINDOW * len(grid.total)), pace(learnt / at[-1]))
        learnt += n
    return learnt


def train(model: Model, symbols: np.ndarray, at: np.ndarray, epochs: int = 3, rate: float = START_RATE) -> Model:
    """Adam over windows of WINDOW steps, states carried; every epoch takes every document from its first word to its end mark."""
    if len(at) < 2:
        return model
    model = copy.deepcopy(model)
    adam = Adam(model)
    for epoch in range(epochs):
        descend(model, adam, symbols, at, np.random.default_rng(epoch), lambda done, epoch=epoch: rate * (1 - (epoch + done) / epochs * 0.8))
    return model


def log_likelihoods(model: Model, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of every symbol of every document, in their order; states last from a document's start to its end."""
    out = np.zeros(len(symbols), F4)
    if len(at) < 2:
        return out
    grid = Grid(symbols, at)
    state = np.zeros((HIDDEN, len(grid.total)), F4)
    for live, spot, ok in grid.windows():
        states, *_ = model.window(grid.inputs[spot], grid.fresh[spot] & ok, state[:, :live])
        state = states[-1]
        rows = np.ascontiguousarray(states[1:].transpose(0, 2, 1)).reshape(-1, HIDDEN)
        there = ok.ravel()
        out[grid.source[spot.ravel()[there]]] = model.log_symbols(rows, grid.targets[spot].ravel())[there]
    return out / F4(np.log(10))


@frugal
def _code(batches: Iterator[pa.RecordBatch], shared, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and segment, a block's documents first. A row for each block: its documents, their numbers that no model changes, its symbols."""
    vocabulary = shared.value
    floor = vocabulary.tokens + 0.1 * (vocabulary.distinct + 1)
    now, meta, parts = None, None, []

    def out() -> pa.RecordBatch:
        ids, apart, sizes, blob = meta
        spot = unpack(blob, int(sizes.sum()))
        counts, symbols = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        at = np.concatenate([[0], np.cumsum(sizes)])
        base = tv.segment_sums(np.log10((counts + 0.1) / floor)[spot], at)
        shares = tv.segment_sums(vocabulary.shares(symbols, counts)[spot], at)
        known = tv.segment_sums((counts > 0).astype(np.float64)[spot], at)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), ids, apart, pa.array([sizes.astype("<i8").tobytes()], pa.binary()), pa.array([np.stack([known, base, shares]).astype("<f8").tobytes()], pa.binary()), pa.array([symbols[spot].astype("<u2").tobytes()], pa.binary())], ["block", "ids", "held", "sizes", "numbers", "symbols"])

    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column("block")[i].as_py()
            if block != now:
                if meta is not None:
                    yield out()
                now, meta, parts = block, None, []
            if batch.column("sizes")[i].is_valid:
                sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i8").astype(np.int64)
                meta = (batch.column("ids").slice(i, 1), batch.column("held").slice(i, 1), sizes, batch.column("words")[i].as_py())
            else:
                endings = np.frombuffer(batch.column("endings")[i].as_buffer(), np.uint8)
                symbols = (1 + TOP + endings.astype(np.int64)).astype(np.uint16)
                marks = np.frombuffer(batch.column("tops")[i].as_buffer(), "<i8").reshape(-1, 2)
                own = symbols[marks[:, 0]]
                vocabulary.named(own, np.ascontiguousarray(marks[:, 1]).view(U64))
                symbols[marks[:, 0]] = own
                parts.append((unpack(batch.column("counts")[i].as_buffer(), len(endings)), symbols))
    if meta is not None:
        yield out()


def coded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(row, sizes of its documents, its symbols)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            yield row, np.frombuffer(row["sizes"].as_buffer(), "<i8").astype(np.int64), np.frombuffer(row["symbols"].as_buffer(), "<u2")


@frugal
def _score(batches: Iterator[pa.RecordBatch], shared, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each document of blocks, a lesson's tokens at a time."""
    model, tokens = shared.value
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        ids, apart = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        sizes, symbols = (np.concatenate([x[i] for x in held]) for i in (2, 4))
        known, base, shares = np.concatenate([x[3] for x in held], axis=1)
        at = np.concatenate([[0], np.cumsum(sizes)])
        score = shares + tv.segment_sums(log_likelihoods(model, symbols, at).astype(np.float64), at)
        return pa.RecordBatch.from_arrays([ids, apart, pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for row, sizes, symbols in coded_rows(batches):
        held.append((row["ids"].values.cast(id_kind), row["held"].values, sizes, np.frombuffer(row["numbers"].as_buffer(), "<f8").reshape(3, -1), symbols))
        if sum(len(x[4]) for x in held) >= LESSON:
            yield out()
            held = []
    if held:
        yield out()


@frugal
def _learn(batches: Iterator[pa.RecordBatch], shared, number: int, rate: float) -> Iterator[pa.RecordBatch]:
    """One row: the weights after the task's documents of the round, and the tokens learnt from."""
    model = copy.deepcopy(shared.value)
    adam, rng = Adam(model), np.random.default_rng([number, TaskContext.get().partitionId()])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = learnt = 0

    def lesson() -> int:
        at = np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]))])
        return descend(model, adam, np.concatenate([x[0] for x in held]), at, rng, lambda _: rate)

    for row, sizes, symbols in coded_rows(batches):
        mine = ~row["held"].values.to_numpy(zero_copy_only=False) & ((np.arange(len(sizes)) + row["block"].as_py()) % ROUNDS == number)
        if mine.any():
            held.append((symbols[np.repeat(mine, sizes)], sizes[mine]))
            size += len(held[-1][0])
        if size >= LESSON:
            learnt += lesson()
            held, size = [], 0
    if held:
        learnt += lesson()
    if learnt:
        flat = np.concatenate([getattr(model, n).ravel() for n in model.names]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([learnt], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["tokens", "weights"])


def learn(coded: DataFrame, model: Model) -> tuple[Model, int]:
    """The model after all training documents, each in one round, and the tokens learnt from."""
    spark, learnt = coded.sparkSession, 0
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        done = materialise(coded.select("block", "held", "sizes", "symbols").mapInArrow(partial(_learn, shared=shared, number=number, rate=RATE / (number + 1)), "tokens long, weights binary"), "weights")
        total, sums = 0, 0.0
        for row in done.toLocalIterator():  # one file's rows at a time
            total, sums = total + row.tokens, sums + row.tokens * np.frombuffer(row.weights, "<f4").astype(np.float64)
        shared.unpersist()
        discard(done)
        if total:
            model, at = copy.deepcopy(model), 0
            for n in model.names:
                old = getattr(model, n)
                setattr(model, n, (sums[at : at + old.size] / total).reshape(old.shape).astype(F4))
                at += old.size
        learnt += total
    return model, learnt


def start_texts(docs: DataFrame, text_col: str, id_col: str, held_out: Column, sample: int) -> list[str]:
    """About `sample` texts at most of START_CHARS at most that are not held out, spread by a hash of their ids: the first weights learn from them."""
    rows = docs.where(~held_out).where(F.length(F.coalesce(text_col, F.lit(""))) <= START_CHARS)
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    got = rows.select(F.xxhash64(id_col).alias("k"), F.coalesce(text_col, F.lit("")).alias("t")).toArrow()
    return [t for _, t in sorted(zip(got["k"].to_pylist(), got["t"].to_pylist(), strict=True))]


def first_model(vocabulary: Vocabulary, texts: list[str]) -> Model:
    symbols, at = [np.zeros(0, np.uint16)], [0]
    for _, _, data, offsets in tv.slices(pa.array(texts, pa.large_string())):
        hashes, endings, cuts = tokenise(data, offsets)
        symbols.append(vocabulary.symbols(endings, hashes))
        at += (cuts[1:] + at[-1]).tolist()
    return train(Model(vocabulary.classes, vocabulary.members, vocabulary.mass, vocabulary.exists), np.concatenate(symbols), np.array(at))


def score(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", sample: int = 1000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    parts = parallelism(spark)
    kind, arrow = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i"), held_out.alias("h"))
    lists = f"ids array<{kind}>, held array<boolean>, sizes binary, words binary, endings binary, counts binary"
    # a segment for each task: rows name their task
    dealt = rows.mapInArrow(partial(_blocks, segments=parts, id_kind=arrow), f"deal int, seg int, block long, {lists}").repartitionById(parts, "deal").sortWithinPartitions("deal", "seg")
    answered = materialise(dealt.mapInArrow(partial(_sum_counts, listed=listed_words(parts), id_kind=arrow), f"block long, seg int, {lists}, tops binary"), "word-counts")
    stats = answered.where("block < 0").select("words", "tops").repartition(math.isqrt(parts) + 1).mapInArrow(_merge, "words binary, tops binary").collect()
    vocabulary = Vocabulary([(bytes(r.words), bytes(r.tops)) for r in stats])
    shared = spark.sparkContext.broadcast(vocabulary)
    blocks = answered.where("block >= 0").repartition(parts, "block").sortWithinPartitions("block", "seg")
    coded = materialise(blocks.mapInArrow(partial(_code, shared=shared, id_kind=arrow), f"block long, ids array<{kind}>, held array<boolean>, sizes binary, numbers binary, symbols binary"), "coded")
    discard(answered)
    model, _ = learn(coded, first_model(vocabulary, start_texts(docs, text_col, id_col, held_out, sample)))
    shared = spark.sparkContext.broadcast((model, vocabulary.tokens))
    out = coded.mapInArrow(partial(_score, shared=shared, id_kind=arrow), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
