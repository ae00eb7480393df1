"""All pairs of rows in the size band, a block of rows against a block in one task. Pairs are made and scored in numpy.

Rows are dealt into blocks of about BLOCK rows of one bucket of sizes, and a block is packed once. Two blocks that can hold pairs meet in one
task: those of one bucket and of neighbouring buckets. So only packed blocks are shuffled, as often as there are blocks they meet, and never
a pair; a task holds two blocks and the pairs of one batch. Sums of doubles are in the order of functions.measures, so values are the same
bit by bit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import measures as m
from ..schema import EVIDENCE
from ..session import ship
from .pairs import BAND, band_bucket

#: Rows of a block, pairs of a batch that a task hands on, tasks at most, and bytes of bit masks that sequences are compared with at a time.
BLOCK = 2048
BATCH = 1 << 18
TASKS = 10_000
MASKS = 1 << 25
#: What a block is in a pair of blocks: alone with itself, of the lower number or bucket, or the other one.
ALONE, FIRST, SECOND = range(3)


def _plain(value):
    """Structs and arrays as tuples, which compare as in Spark."""
    if isinstance(value, dict):
        return tuple(_plain(x) for x in value.values())
    return tuple(_plain(x) for x in value) if isinstance(value, list) else value


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _codes(texts: pa.Array) -> tuple[list, np.ndarray]:
    found = texts.dictionary_encode()
    codes = found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
    return found.dictionary.to_pylist() + [None], codes.astype(np.uint8 if len(found.dictionary) < 255 else np.int32)


def _packed(column: pa.Array):
    """A column as arrays: sequences as (lengths, vocabulary, codes), counters with counts beside the codes, numbers and flags as they are."""
    kind = column.type
    if pa.types.is_map(kind):
        entries = column.take(pa.array(range(len(column))))  # from offset 0
        lengths = np.diff(entries.offsets.to_numpy())
        return (lengths, *_codes(entries.keys), entries.items.to_numpy(zero_copy_only=False))
    if pa.types.is_list(kind):
        return (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), *_codes(column.flatten()))
    if pa.types.is_string(kind):
        return np.array(column.to_pylist(), dtype=object)
    return column.to_numpy(zero_copy_only=False)


def _pack(key, rows: pa.Table, size: str, order: list[str], shown: list[str], parts: dict[int, int]) -> pa.Table:
    """A block, and the numbers of the pairs of blocks it is in, each with what it is there."""
    bucket, part = (k.as_py() for k in key)
    columns = {n: _whole(rows[n]) for n in rows.column_names}
    sink = pa.BufferOutputStream()
    kept = rows.select(shown)
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_table(kept)
    keys = list(zip(*([_plain(x) for x in columns[n].to_pylist()] for n in order), strict=True))
    used = {n: _packed(c) for n, c in columns.items() if n == size or n not in ("bucket", "part", *order, *shown)}
    data = pickle.dumps((sink.getvalue().to_pybytes(), keys, used), protocol=5)
    own, first = {}, 0
    for c in sorted(parts):  # pairs within bucket c, then with the next one
        n, up = parts[c], parts.get(c + 1, 0)
        if c == bucket:
            own |= {first + max(part, j) * (max(part, j) + 1) // 2 + min(part, j): ALONE if part == j else SECOND if part > j else FIRST for j in range(n)}
        first += n * (n + 1) // 2
        if c == bucket:
            own |= {first + part * up + j: FIRST for j in range(up)}
        if c + 1 == bucket:
            own |= {first + i * up + part: SECOND for i in range(n)}
        first += n * up
    met = pa.array([[{"pair": p, "role": r} for p, r in own.items()]], pa.list_(pa.struct([("pair", pa.int64()), ("role", pa.int32())])))
    return pa.table({"met": met, "data": pa.array([data], pa.binary())})


class Block:
    """A block's rows as arrays."""

    def __init__(self, data: bytes):
        shown, self.order, self.columns = pickle.loads(data)
        self.shown = pa.ipc.open_stream(shown).read_all()
        self.n = len(self.order)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def starts(self, name: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self[name][0])])


class Counters:
    """What a counter of rows of y has in common with those of x."""

    def __init__(self, x: Block, y: Block, name: str):
        self.n, self.ends, (_, self.words, self.codes, self.counts) = x.n, y.starts(name), y[name]
        lengths, words, codes, counts = x[name]
        row = np.repeat(np.arange(x.n), lengths)
        by_token = np.argsort(codes, kind="stable")
        at = np.searchsorted(codes[by_token], np.arange(len(words) + 1))
        here = {}
        for i, word in enumerate(words):
            of = by_token[at[i] : at[i + 1]]
            if len(of):
                rows, n = row[of], counts[of].astype(np.int64)
                if 8 * len(of) > x.n:  # a token that many rows have: a place for each row
                    n = np.bincount(rows, n, x.n).astype(np.int64)
                    rows = None
                here[word] = rows, n
        self.having = [here.get(w) for w in self.words]
        self.total = np.bincount(row, counts, x.n).astype(np.int64)
        row = np.repeat(np.arange(y.n), y[name][0])
        self.totals = np.bincount(row, self.counts, y.n).astype(np.int64)

    def ratio(self, j: int, i: np.ndarray) -> np.ndarray:
        """No less than jaccard(), from the totals."""
        n, k = self.total[i], self.totals[j]
        most = np.maximum(n, k)
        return np.where(most == 0, 1.0, np.minimum(n, k) / np.maximum(most, 1))

    def jaccard(self, j: int, i: np.ndarray) -> np.ndarray:
        """Of row j of y with rows i of x."""
        shared = np.zeros(self.n, np.int64)
        for at in range(self.ends[j], self.ends[j + 1]):
            found = self.having[self.codes[at]]
            if found is not None:
                rows, n = found
                if rows is None:
                    shared += np.minimum(n, self.counts[at])
                else:
                    shared[rows] += np.minimum(n, self.counts[at])
        shared = shared[i]
        joint = self.total[i] + self.totals[j] - shared
        return np.where(joint == 0, 1.0, shared / np.maximum(joint, 1))


class Sequences:
    """Longest common subsequences of a row of y with many of x at once: a bit for each place of x's sequences, in words of 64 bits.

    Words below the last use 63 bits; the last bit takes the carry to the next one.
    """

    def __init__(self, x: Block, y: Block, name: str = "stmt_seq"):
        self.n, (lengths, words, codes), starts = x.n, x[name], x.starts(name)
        self.lengths, self.own, self.ends = lengths.astype(np.int64), y[name][0], y.starts(name)
        number = {w: t for t, w in enumerate(words)}
        self.tokens = np.array([number.get(w, -1) for w in y[name][1]], np.int64)[y[name][2]]
        sizes = 1 + np.maximum(0, -(-(self.lengths - 64) // 63))
        self.groups = []
        for width in map(int, np.unique(sizes[self.lengths > 0])):
            rows = np.flatnonzero((sizes == width) & (self.lengths > 0))
            group = Bits(width, rows, self.lengths[rows], codes, starts[rows], len(words))
            kept = 8 * len(words) * width * len(rows) <= MASKS
            self.groups.append((group, [group.mask(t, 0, len(rows)) for t in range(len(words))] if kept else None))

    def ratio(self, j: int, i: np.ndarray) -> np.ndarray:
        """Of row j of y with rows i of x."""
        own, lengths = int(self.own[j]), self.lengths[i]
        if not own:
            return (lengths == 0).astype(np.float64)
        common, wanted = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        wanted[i] = True
        tokens = [int(t) for t in self.tokens[self.ends[j] : self.ends[j + 1]] if t >= 0]
        kinds = set(tokens)
        for group, kept in self.groups:
            step = len(group.rows) if kept else max(1, MASKS // (8 * group.width * max(1, len(kinds))))
            for low in range(0, len(group.rows), step):
                high = min(low + step, len(group.rows))
                rows, full = group.rows[low:high], group.full[:, low:high]
                sub = wanted[rows]
                if not sub.any():
                    continue
                masks = {t: kept[t] if kept else group.mask(t, low, high) for t in kinds}
                if not sub.all():
                    masks, full, rows = {t: mask[:, sub] for t, mask in masks.items()}, full[:, sub], rows[sub]
                common[rows] = _common(full, [masks[t] for t in tokens])
        return np.where(lengths == 0, 0.0, 2 * common[i] / (lengths + own))


class Bits:
    """Places of tokens in sequences that take `width` words each."""

    def __init__(self, width: int, rows: np.ndarray, lengths: np.ndarray, codes: np.ndarray, starts: np.ndarray, kinds: int):
        self.width, self.rows = width, rows
        col = np.repeat(np.arange(len(rows)), lengths)
        place = np.arange(len(col)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token = codes[starts[col] + place]
        word = np.minimum(place // 63, width - 1)
        by = np.argsort(token, kind="stable")  # a token's columns stay in order
        self.ends = np.searchsorted(token[by], np.arange(kinds + 1))
        self.col, self.word, self.bit = col[by], word[by], (np.uint64(1) << (place - 63 * word).astype(np.uint64))[by]
        self.full = np.zeros((width, len(rows)), np.uint64)
        np.bitwise_or.at(self.full, (self.word, self.col), self.bit)

    def mask(self, token: int, low: int, high: int) -> np.ndarray:
        """The token's bits by word and row, of rows from low to high."""
        at, end = self.ends[token], self.ends[token + 1]
        at, end = at + np.searchsorted(self.col[at:end], [low, high])
        out = np.zeros((self.width, high - low), np.uint64)
        np.bitwise_or.at(out, (self.word[at:end], self.col[at:end] - low), self.bit[at:end])
        return out


def _common(full: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Places of x's sequences that are in the longest common subsequence: those whose bits went to 0."""
    width = len(full)
    open_, hit, moved = np.full_like(full, ~np.uint64(0)), np.empty_like(full), np.empty_like(full)
    carry, top, low = np.empty_like(full[0]), np.uint64(63), np.uint64((1 << 63) - 1)
    if width > 1:
        open_[:-1] = low
    for mask in steps:
        np.bitwise_and(open_, mask, out=hit)
        np.add(open_, hit, out=moved)
        for w in range(width - 1):
            np.right_shift(moved[w], top, out=carry)
            np.add(moved[w + 1], carry, out=moved[w + 1])
            np.bitwise_and(moved[w], low, out=moved[w])
        np.bitwise_xor(open_, hit, out=open_)
        np.bitwise_or(open_, moved, out=open_)
    return np.bitwise_count(~open_ & full).sum(axis=0, dtype=np.int64)


#: Takes two blocks; what it returns takes a row of y, rows of x in the band and their size ratios: (rows that are left, their values).
Score = Callable[[Block, Block], Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]]


def size_ratios(x: Block, y: Block):
    return lambda j, i, ratio: (i, [ratio])


def jaccards(x: Block, y: Block):
    counters = Counters(x, y, "node_types")
    return lambda j, i, ratio: (i, [counters.jaccard(j, i)])


def lcs_ratios(x: Block, y: Block):
    sequences = Sequences(x, y)
    return lambda j, i, ratio: (i, [sequences.ratio(j, i)])


def similarities(x: Block, y: Block, threshold: float, sequences: bool = True):
    """similarity and its six measures of pairs that reach the threshold; without sequences: `bound`, what equal sequences would make of it."""
    nodes, calls = Counters(x, y, "node_types"), Counters(x, y, "call_names")
    lcs = Sequences(x, y) if sequences else None
    weights = m.SIMILARITY_WEIGHTS

    def total(values: list) -> np.ndarray:
        out = weights[0] * values[0]
        for w, v in zip(weights[1:], values[1:], strict=True):
            out = out + w * v
        return out

    def row(j: int, i: np.ndarray, ratio: np.ndarray):
        of = lambda name: (x[name][i], y[name][j])
        n, k = of("param_count")
        params = 1.0 - np.abs(n - k) / np.maximum(np.maximum(n, k), 1)
        (p, q), (r, s) = of("has_yield"), of("has_await")
        traits = 1.0 - np.where(p != q, 0.35, 0.0) - np.where(r != s, 0.25, 0.0)
        signature = np.maximum(0.0, np.minimum(1.0, 0.7 * params + 0.3 * traits))
        (p, q), (r, s) = of("is_wrapper"), of("wrapper_target")
        same = np.zeros(len(i), bool) if s is None else np.asarray(r == s, bool)
        wrapper = np.where(p & q, np.where(same, 0.5 + 0.35, 0.5), np.where(p | q, 0.25, 0.0))
        (p, q), (r, s) = of("returns_lambda"), of("curry_depth")
        curry = np.where(p & q, np.where(r == s, 0.8, 0.6), np.where(p | q, 0.4, 0.0))
        values = [nodes.ratio(j, i), 1.0, calls.ratio(j, i), signature, wrapper, curry]

        def left(found: np.ndarray, score: np.ndarray):
            return found[score], [v if isinstance(v, float) else v[score] for v in values]

        i, values = left(i, total(values) >= threshold)
        values[0], values[2] = nodes.jaccard(j, i), calls.jaccard(j, i)
        bound = total(values)
        if lcs is None:
            return i[bound >= threshold], [bound[bound >= threshold]]
        i, values = left(i, bound >= threshold)
        values[1] = lcs.ratio(j, i)
        score = total(values)
        i, values = left(i, score >= threshold)
        return i, [score[score >= threshold], *values]

    return row


def _batch(x: Block, y: Block, rows: list[tuple], both: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """rows: (row of y, rows of x, which of them come before it, values)."""
    js = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]) + x.n
    i, before = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    sides = [both.take(pa.array(np.where(before, *at))) for at in ((i, js), (js, i))]
    columns = [_whole(c) for side in sides for c in side.columns]
    values = [pa.array(np.concatenate(v)) for v in zip(*(r[3] for r in rows), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *values], schema=schema)


def _between(x: Block, y: Block, size: str, score: Score, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    same = x is y
    place = {k: p for p, k in enumerate(sorted({*x.order, *y.order}))}
    here, there = (np.array([place[k] for k in b.order], np.int64) for b in (x, y))
    both = pa.concat_tables([x.shown, y.shown]).combine_chunks()
    sizes, row, waiting, n = x[size].astype(np.int64), score(x, y), [], 0
    for j in range(y.n):
        k = int(y[size][j])
        ratio = np.minimum(sizes, k) / np.maximum(np.maximum(sizes, k), 1)
        before = here < there[j]
        fits = (ratio >= BAND) & (before if same else here != there[j])
        i = np.flatnonzero(fits)
        if len(i):
            i, values = row(j, i, ratio[i])
        if len(i):
            waiting.append((j, i, before[i], values))
            n += len(i)
        if n >= BATCH:
            yield _batch(x, y, waiting, both, schema)
            waiting, n = [], 0
    if n:
        yield _batch(x, y, waiting, both, schema)


def _meet(batches: Iterator[pa.RecordBatch], size: str, score: Score, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks come by pair, the first one before the second. One whose other block has no rows has no pairs there."""
    pair, first = None, None
    for batch in batches:
        for number, role, data in zip(batch["pair"].to_pylist(), batch["role"].to_pylist(), batch["data"], strict=True):
            block = Block(data.as_py())
            if role == ALONE:
                yield from _between(block, block, size, score, schema)
            elif role == FIRST:
                pair, first = number, block
            elif pair == number:
                yield from _between(first, block, size, score, schema)


def block_pairs(rows: DataFrame, size: str, order: list[str], shown: list[str], score: Score, values: list[str]) -> DataFrame:
    """a_ and b_ of the columns shown, and the values of pairs in the band; a is before b in the order. Rows without a place in it have no pairs."""
    spark = rows.sparkSession
    ship(spark)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(f"{s}_{n}", kinds[n]) for s in "ab" for n in shown] + [StructField(v, DoubleType()) for v in values])
    placed = rows.dropna(subset=[size, *order]).withColumn("bucket", band_bucket(F.col(size)).cast("long"))
    parts = {r.bucket: -(-r["count"] // BLOCK) for r in placed.groupBy("bucket").count().collect()}  # a number for each factor of 2.5 in size
    if not parts:
        return spark.createDataFrame([], schema)
    met = sum(n * (n + 1) // 2 + n * parts.get(c + 1, 0) for c, n in parts.items())
    of = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in parts.items() for x in pair)), F.col("bucket"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(*order), of))

    def pack(key, block):
        return _pack(key, block, size, order, shown, parts)

    blocks = dealt.groupBy("bucket", "part").applyInArrow(pack, "met array<struct<pair:long,role:int>>, data binary")
    sides = blocks.select(F.explode("met").alias("m"), "data").select("m.pair", "m.role", "data")
    tasks = min(met, TASKS)
    dealt = sides.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "role")
    return dealt.mapInArrow(partial(_meet, size=size, score=score, schema=to_arrow_schema(schema)), schema)


#: What similarities() reads of a function row.
READ = ("node_types", "stmt_seq", "call_names", "param_count", "has_yield", "has_await", "is_wrapper", "wrapper_target", "returns_lambda", "curry_depth")


def similar(functions: DataFrame, threshold: float, shown: list[str], sequences: bool = True) -> DataFrame:
    """a_ and b_ of the columns shown, a scanned before b, with `similarity` and the six measures of pairs that reach the threshold.

    Without sequences: with `bound`, of pairs that would reach it if their sequences were equal.
    """
    slim = functions.select(*dict.fromkeys([*shown, "scan_key", "lineno", "stmt_count", *READ]))
    score = partial(similarities, threshold=threshold, sequences=sequences)
    return block_pairs(slim, "stmt_count", ["scan_key", "lineno"], shown, score, ["similarity", *EVIDENCE] if sequences else ["bound"])


def candidates(functions: DataFrame, threshold: float) -> DataFrame:
    """a, b: function rows that reach the threshold, a scanned before b. Rows are fetched for those pairs only."""
    keys = similar(functions, threshold, ["rel", "lineno"])
    full = functions.select("rel", "lineno", F.struct(*functions.columns).alias("f"))
    left = full.select(F.col("rel").alias("a_rel"), F.col("lineno").alias("a_lineno"), F.col("f").alias("a"))
    right = full.select(F.col("rel").alias("b_rel"), F.col("lineno").alias("b_lineno"), F.col("f").alias("b"))
    return keys.join(left, ["a_rel", "a_lineno"]).join(right, ["b_rel", "b_lineno"]).select("a", "b")
