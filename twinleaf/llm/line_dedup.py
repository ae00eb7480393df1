"""Line deduplication with two Bloom filters.

1. Each task hashes its documents' normalised lines and deals the distinct hashes, packed, to hash segments.
2. For each segment one task sets a once-seen filter; what that filter has already seen goes into a
   twice-seen filter. Only the twice-seen filter is kept.
3. A second pass sends only lines that the twice-seen filter suspects to an exact count by text,
   pre-aggregated in each task, so a line in a third of all documents is one row a task.
4. A last pass removes the lines that the count condemns.

The filters can only suspect too much, never too little, so results are exact. Their joint size is bounded
by `filter_bytes`: beyond it they hold fewer bits a key and suspect more.

Edge cases: a null or empty text is one empty line; blank lines have an empty key, shorter than any
`min_chars` of at least 1, and always stay; each row is a document, so repeated rows count separately; other
columns pass through apply() untouched whatever their names; an empty table gives an empty one.
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
from .shared import carried, frugal, materialise, parallelism, ship

U64 = np.uint64
PROBES = 4


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Lines of documents: start, end, key start, key end, key hash, eligible; offsets of documents in them."""
    s, e, at = tv.lines(data, offsets)
    a, b = tv.strip(data, s, e)
    h = tv.span_hashes(data, a, b, tv.LOWER_TABLE)
    # code points are bytes that do not continue a character
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return s, e, a, b, h, heads[b] - heads[a] >= max(min_chars, 1), at


def _distinct_in_documents(h: np.ndarray, ok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of the first line of each key in each document."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, owner))
    order = order[ok[order]]
    if not len(order):
        return order
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order[first]


@frugal
def _deal_hashes(batches: Iterator[pa.RecordBatch], bits: int, min_chars: int, flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values = np.repeat(values, np.minimum(counts, 2))  # twice in this task is enough for the second filter
        cuts = np.searchsorted(values >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
        rows = [(s, values[cuts[s] : cuts[s + 1]].tobytes()) for s in range(1 << bits) if cuts[s] < cuts[s + 1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["seg", "hashes"])

    for batch in batches:
        for _, _, data, offsets in tv.slices(batch.column(0)):
            _, _, _, _, h, ok, at = line_keys(data, offsets, min_chars)
            held.append(h[_distinct_in_documents(h, ok, at)])
            size += len(held[-1])
            if size >= flush:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def probes(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Filter positions of hashes, one row for each probe."""
    step = (tv.mix(h + U64(77)) | U64(1))[None, :]
    return ((h[None, :] + np.arange(1, PROBES + 1, dtype=U64)[:, None] * step) % U64(n_bits)).astype(np.int64)


class Bloom:
    """Plain Bloom filter over 64-bit hashes."""

    def __init__(self, n_bits: int, bits: np.ndarray | None = None):
        self.n_bits = max(64, int(n_bits))
        self.bits = np.zeros(self.n_bits // 8 + 1, np.uint8) if bits is None else bits

    def add(self, h: np.ndarray) -> None:
        p = probes(h, self.n_bits).ravel()
        np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        p = probes(h, self.n_bits)
        return ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


@frugal
def _twice_seen(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment; a filter of twice-seen keys for each."""
    now, blobs = None, []

    def out() -> pa.RecordBatch | None:
        total = sum(map(len, blobs)) // 8
        once, again = Bloom(16 * total), []
        for blob in blobs:
            h = np.frombuffer(blob, U64)
            # within one blob a key stands at most twice, side by side
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            again.append(h[same | once.has(h)])
            once.add(h[~same])
        hits = np.unique(np.concatenate(again)) if again else np.zeros(0, U64)
        if not len(hits):
            return None
        twice = Bloom(min(16 * len(hits), 8 * segment_bytes))
        twice.add(hits)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.n_bits], pa.int64()), pa.array([twice.bits.tobytes()], pa.binary())], ["seg", "n_bits", "bits"])

    for batch in batches:
        for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seg != now:
                if blobs and (done := out()) is not None:
                    yield done
                now, blobs = seg, []
            blobs.append(blob)
    if blobs and (done := out()) is not None:
        yield done


def suspects(h: np.ndarray, bits: int, filters: dict[int, tuple[int, bytes]]) -> np.ndarray:
    """Which hashes the twice-seen filters of their segments hold."""
    seg = (h >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    out = np.zeros(len(h), bool)
    cuts = np.flatnonzero(np.diff(seg[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        found = filters.get(int(seg[order[a]]))
        if found is not None:
            rows = order[a:b]
            out[rows] = Bloom(found[0], np.frombuffer(found[1], np.uint8)).has(h[rows])
    return out


def _key(data: np.ndarray, a: int, b: int) -> bytes:
    return tv.LOWER[data[a:b]].tobytes()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


@frugal
def _suspected_lines(batches: Iterator[pa.RecordBatch], bits: int, min_chars: int, filters, with_id: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in tv.slices(batch.column(0)):
            _, _, a, b, h, ok, at = line_keys(data, offsets, min_chars)
            rows = _distinct_in_documents(h, ok, at)
            rows = rows[suspects(h[rows], bits, filters.value)]
            keys = pa.array([_key(data, a[i], b[i]) for i in rows], pa.binary())
            if with_id:
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[rows] + first
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner)), keys], ["id", "key"])
            else:
                yield pa.RecordBatch.from_arrays([keys], ["key"])


class Rewriter:
    """Removes condemned lines from texts."""

    def __init__(self, digests: set[bytes], hashes: np.ndarray, min_chars: int):
        self.digests, self.hashes, self.min_chars = digests, np.sort(hashes), min_chars

    def condemned(self, data: np.ndarray, h: np.ndarray, ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for i in np.flatnonzero(ok & (self.hashes[at] == h)):
                out[i] = _digest(_key(data, a[i], b[i])) in self.digests
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(lines, dropped lines, kept text) of each document."""
        s, e, a, b, h, ok, at = line_keys(data, offsets, self.min_chars)
        gone = self.condemned(data, h, ok, a, b)
        lost = np.concatenate([[0], np.cumsum(gone)])
        for i in range(len(offsets) - 1):
            lo, hi = at[i], at[i + 1]
            n = int(lost[hi] - lost[lo])
            if n:
                text = b"\n".join(data[s[j] : e[j]].tobytes() for j in range(lo, hi) if not gone[j])
            else:
                text = data[offsets[i] : offsets[i + 1]].tobytes()
            yield int(hi - lo), n, text


def _hash_of_keys(keys: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    return tv.span_hashes(data, ends - np.array([len(k) for k in keys], np.int64), ends, tv.LOWER_TABLE) if keys else np.zeros(0, U64)


@frugal
def _rewrite(batches: Iterator[pa.RecordBatch], min_chars: int, condemned) -> Iterator[pa.RecordBatch]:
    """Replaces column 0 by the kept text; appends line counts. condemned: broadcast keys, or None if column 1 lists each row's."""
    fixed = None
    if condemned is not None:
        keys = condemned.value
        fixed = Rewriter({_digest(k) for k in keys}, _hash_of_keys(keys), min_chars)
    for batch in batches:
        for first, end, data, offsets in tv.slices(batch.column(0)):
            if fixed is not None:
                done = list(fixed(data, offsets))
            else:
                done = []
                for i, keys in enumerate(batch.column(1).slice(first, end - first).to_pylist()):
                    keys = keys or []
                    one = Rewriter({_digest(k) for k in keys}, _hash_of_keys(keys), min_chars)
                    done += one(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            rest = batch.slice(first, end - first)
            n, lost, text = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(rest.column(j) for j in range(1 if condemned is not None else 2, rest.num_columns)), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())],
                [*(f"c{j}" for j in range(rest.num_columns - (1 if condemned is not None else 2))), "text", "n_lines", "n_dropped"],
            )


def repeated_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, filter_bytes: int = 32 << 20) -> DataFrame:
    """Normalised lines (`key` binary) of at least min_chars code points in at least min_docs rows, with `n_docs`."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2: the twice-seen filter decides what is counted")
    return _condemned(docs, text_col, min_docs, min_chars, filter_bytes)[0]


def _condemned(docs: DataFrame, text_col: str, min_docs: int, min_chars: int, filter_bytes: int):
    spark = docs.sparkSession
    ship(spark)
    bits = max(4, (4 * parallelism(spark) - 1).bit_length())
    texts = docs.select(F.col(text_col).alias("t"))
    dealt = texts.mapInArrow(partial(_deal_hashes, bits=bits, min_chars=min_chars), "seg int, hashes binary")
    twice = dealt.repartition(parallelism(spark), "seg").sortWithinPartitions("seg").mapInArrow(partial(_twice_seen, segment_bytes=max(64, filter_bytes >> bits)), "seg int, n_bits long, bits binary")
    # at most filter_bytes: every segment's filter is cut to its share
    filters = spark.sparkContext.broadcast({r.seg: (r.n_bits, bytes(r.bits)) for r in twice.collect()})
    lines = texts.mapInArrow(partial(_suspected_lines, bits=bits, min_chars=min_chars, filters=filters, with_id=False), "key binary")
    found = lines.groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return materialise(found, "repeated-lines"), bits, filters


def apply(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, filter_bytes: int = 32 << 20, list_bytes: int = 16 << 20) -> DataFrame:
    """docs with `text_col` rewritten, and `n_lines`, `n_dropped` appended (under these names, twice if docs has them).

    The condemned keys are broadcast if they take at most `list_bytes`; beyond that each document's suspected lines
    are joined to them by key, grouped by id and joined back, with the same result.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2: the twice-seen filter decides what is counted")
    spark = docs.sparkSession
    found, bits, filters = _condemned(docs, text_col, min_docs, min_chars, filter_bytes)
    size = found.agg(F.coalesce(F.sum(F.length("key") + 48), F.lit(0)).alias("b")).first().b
    names = [f"c{i}" for i in range(len(docs.columns) - 1)]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[("t" if i == at else names[i - (i > at)]) for i in range(len(docs.columns))])
    kinds = [f for i, f in enumerate(docs.schema.fields) if i != at]
    schema = carried(kinds, after="text string, n_lines long, n_dropped long")
    if size <= list_bytes:
        keys = spark.sparkContext.broadcast([bytes(r.key) for r in found.select("key").collect()])
        out = plain.select("t", *names).mapInArrow(partial(_rewrite, min_chars=min_chars, condemned=keys), schema)
    else:
        key_id = plain.columns[docs.columns.index(id_col)]
        lines = plain.select("t", F.col(key_id).cast("string").alias("id")).mapInArrow(partial(_suspected_lines, bits=bits, min_chars=min_chars, filters=filters, with_id=True), "id string, key binary")
        # a document's list is no longer than the document itself
        lists = lines.join(found.select("key"), "key").groupBy("id").agg(F.collect_set("key").alias("keys"))
        joined = plain.join(lists, plain[key_id].cast("string").eqNullSafe(lists["id"]), "left")
        out = joined.select("t", "keys", *names).mapInArrow(partial(_rewrite, min_chars=min_chars, condemned=None), schema)
    back = [F.col("text").alias(text_col) if i == at else F.col(names[i - (i > at)]).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*back, "n_lines", "n_dropped")


def rewrite(docs: DataFrame, **options) -> DataFrame:
    """docs with texts rewritten, with its columns alone."""
    out = apply(docs, **options)
    return out.toDF(*(f"c{i}" for i in range(len(out.columns)))).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's SHA-256."""
    return apply(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
