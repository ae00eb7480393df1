"""Token ids in Arrow files of fixed-size-list batches.

A file holds the ids of consecutive documents (ascending id) as equal-length sequences: column `ids` is a fixed-size list of
the smallest unsigned type that holds the vocabulary, column `mask` says which places are filled (only a file's last sequence
has others). Batches have a fixed number of rows, so sequence k is row k % rows of batch k // rows, and reading it copies
nothing. Beside each file an index file holds doc_id, start in the file, and n_tokens.

Documents are tokenised where they are read and dealt, as ids, to ranges of doc_id whose bounds come from a sample of doc_id alone.
Each range becomes a file. Tasks write under names of their own and report them, so a file of a lost or repeated task is never read.

Edge cases: a null or empty text has its end id alone; a null doc_id comes first; rows of one id are ordered by their ids, then
they are equal and their order cannot be seen; an empty table gives no files and no rows.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import fresh_path, frugal, materialise, parallelism, ship

END_ID = 2
SEQUENCE = 2048
BATCH_ROWS = 512


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system that executors reach without the JVM (file, hdfs, s3, gs), and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return pyarrow.fs.LocalFileSystem(), uri


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes full batches."""

    def __init__(self, sink, kind: np.dtype, size: int):
        self.kind, self.size = kind, size
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), size)), ("mask", pa.list_(pa.bool_(), size))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        block = self.size * BATCH_ROWS
        if self.n >= block:
            flat = np.concatenate(self.held)
            full = self.n - self.n % block
            for k in range(0, full, block):
                self._write(flat[k : k + block], np.ones(block, bool))
            self.held, self.n = [flat[full:]], self.n - full

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.size) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            rows = -(-self.n // self.size)
            ids = np.zeros(rows * self.size, self.kind)
            mask = np.zeros(rows * self.size, bool)
            ids[: self.n], mask[: self.n] = flat, True
            self._write(ids, mask)
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.size = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches

    def flat(self, batch: int) -> np.ndarray:
        """Filled ids of a batch, without a copy."""
        got = self.reader.get_batch(batch)
        ids, mask = got.column("ids").flatten().to_numpy(), got.column("mask").flatten()
        return ids if mask[-1].as_py() else ids[: mask.true_count]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got, row = self.reader.get_batch(k // BATCH_ROWS), k % BATCH_ROWS
        return got.column("ids")[row].values.to_numpy(), got.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def read(self, start: int, n: int) -> np.ndarray:
        """ids[start:start + n] of the file."""
        block, parts = self.size * BATCH_ROWS, []
        while n > 0:
            part = self.flat(start // block)[start % block : start % block + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


@frugal
def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: list) -> Iterator[pa.RecordBatch]:
    kind = id_type(tokens.ChunkedTokenizer.at(path).tokenizer.get_vocab_size())
    for batch in batches:
        ranges = [0 if x is None else bisect.bisect_right(bounds, x) for x in batch.column(1).to_pylist()]
        for a, b, ids, at in tokens.encoded(batch.column(0), path, end_id):
            flat = ids.astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ranges[a:b], pa.int32()), batch.column(1).slice(a, b - a), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["range", "doc_id", "ids"])


class RangeFile:
    """The file of one range, with its index."""

    def __init__(self, folder: str, number: int, kind: np.dtype, size: int):
        self.number, self.kind = number, kind
        self.fs, self.path = file_system(f"{folder}/{number:08d}-{uuid.uuid4().hex}.arrow")
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = SequenceWriter(self.sink, kind, size)
        self.keys: list[pa.Array] = []
        self.counts: list[int] = []

    def add(self, keys: pa.Array, blobs: pa.Array) -> None:
        self.keys.append(keys)
        for blob in blobs:
            ids = np.frombuffer(blob.as_buffer(), self.kind)
            self.counts.append(len(ids))
            self.writer.add(ids)

    def close(self) -> pa.RecordBatch:
        self.writer.close()
        self.sink.close()
        n = np.array(self.counts, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(self.keys), "start": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n)})
        with self.fs.open_output_stream(self.path + ".index") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index, max_chunksize=1 << 16)
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int32()), pa.array([self.path.rpartition("/")[2]]), pa.array([int(n.sum())], pa.int64()), pa.array([len(n)], pa.int64())], ["range", "name", "n_tokens", "n_docs"])


@frugal
def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, then doc_id."""
    file = None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if file is None or file.number != numbers[a]:
                if file is not None:
                    yield file.close()
                file = RangeFile(folder, int(numbers[a]), id_type(vocabulary), size)
            file.add(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a))
    if file is not None:
        yield file.close()


def range_bounds(docs: DataFrame, id_col: str, ranges: int) -> list:
    """Cuts of ids into ranges of about as many rows, from a sample of about 50 ids a range."""
    ids = docs.select(F.col(id_col).alias("i")).where("i IS NOT NULL")
    total = ids.count()
    if not total:
        return []
    share = min(1.0, 50 * ranges / total)
    got = sorted(r.i for r in (ids if share == 1 else ids.sample(share, seed=7)).collect())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


@frugal
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
            file = SequenceFile(uri)
            fs, path = file_system(uri)
            with fs.open_input_file(path + ".index") as source:
                index = pa.ipc.open_file(source)
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(file.read(int(s), int(m)).astype("<u4")) for s, m in zip(start, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> list[dict]:
    """Writes the files; one entry for each in order: uri, first (ids of all files before it), n_tokens, n_docs."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "token-files")
    kind = docs.schema[id_col].dataType.simpleString()
    bounds = range_bounds(docs, id_col, 3 * parallelism(spark))
    ids = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i")).mapInArrow(partial(_tokenise, path=tokenizer_path, end_id=end_id, bounds=bounds), f"range int, doc_id {kind}, ids binary")
    dealt = ids.repartition(parallelism(spark), "range").sortWithinPartitions("range", "doc_id", "ids")
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    report = materialise(dealt.mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary, size=sequence), "range int, name string, n_tokens long, n_docs long"), "token-report")
    out, first = [], 0
    for r in sorted(report.collect(), key=lambda r: r.range):  # one row for each file
        out.append({"uri": f"{folder}/{r.name}", "first": first, "n_tokens": r.n_tokens, "n_docs": r.n_docs})
        first += r.n_tokens
    return out


def read(spark, files: list[dict], id_type_name: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    ship(spark)
    rows = spark.createDataFrame([(f["uri"], f["first"]) for f in files], "uri string, first long")
    return rows.repartition(max(1, len(files))).mapInArrow(_read, f"doc_id {id_type_name}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read(docs.sparkSession, write(docs, tokenizer_path, **options), docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
