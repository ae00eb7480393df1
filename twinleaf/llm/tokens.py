"""Token ids of whole texts, through the tokenizers library and a cache of chunks.

A byte-level BPE whose pattern splits at white space gives each chunk (an optional space and the solid run after it, or
white space) the same ids wherever it stands. Chunks are found and hashed in numpy; a worker keeps the ids of the chunks it
has met and asks the library only for new ones. Tokenizers of another make, and texts with a special token's string or white
space outside ASCII, go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textvec as tv
from .shared import operator_cache

U64 = np.uint64
CACHE_CHUNKS = 1_200_000
#: Bytes taken at a time: every slice merges its new chunks into the cache, so slices are larger than elsewhere.
TOKEN_SLICE = 1 << 20
#: Unicode white space outside ASCII, and the bytes that it starts with in UTF-8.
WIDE_SPACE = "[\u0085   -     　]"
#: Control bytes that some patterns count as white space and some do not.
ODD_BYTES = [0x0B, 0x1C, 0x1D, 0x1E, 0x1F]


class ChunkedTokenizer:
    """encode(): ids of a slice of texts; one instance lives as long as its Python worker works for one operator."""

    _loaded: dict[str, ChunkedTokenizer] = operator_cache({})

    @classmethod
    def at(cls, path: str) -> ChunkedTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        self.chunked = (
            made["model"]["type"] == "BPE"
            and made.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
            and not made["model"].get("dropout")
            and not made["model"].get("continuing_subword_prefix")
            and not made["model"].get("end_of_word_suffix")
        )
        self.specials = [x["content"] for x in made.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.id_bytes = np.zeros(size, np.int64)
        if self.chunked:
            for token, i in made["model"]["vocab"].items():
                self.id_bytes[i] = len(token)  # a byte-level token has one character for each byte
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.first = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of texts in them)."""
        n = len(texts)
        if not self.chunked:
            each = self._whole(texts.to_pylist())
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        odd = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        for special in self.specials:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False).astype(bool)
        flagged = np.isin(data, ODD_BYTES)
        if flagged.any():
            odd[np.unique(np.searchsorted(offsets, np.flatnonzero(flagged), "right") - 1)] = True
        if not odd.any():
            return self._chunks(data, offsets)
        plain = texts.filter(pa.array(~odd))
        each = dict(zip(np.flatnonzero(odd).tolist(), self._whole(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        for _, _, some, cuts in tv.slices(plain, 1 << 62):
            ids, at = self._chunks(some, cuts)
            each |= {int(i): ids[at[k] : at[k + 1]] for k, i in enumerate(np.flatnonzero(~odd))}
        return np.concatenate([each[i] for i in range(n)]), np.concatenate([[0], np.cumsum([len(each[i]) for i in range(n)], dtype=np.int64)])

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = chunk_spans(data, offsets)
        h = tv.span_hashes(data, starts, ends, tv.RAW_TABLE)
        unique, example, spot = np.unique(h, return_index=True, return_inverse=True)
        self._learn(data, unique, starts[example], ends[example])
        at = np.searchsorted(self.keys, unique)[spot]
        first, count = self.first[at].astype(np.int64), self.count[at].astype(np.int64)
        ends_out = np.cumsum(count)
        place = np.arange(ends_out[-1]) - np.repeat(ends_out - count - first, count)
        text_at = np.searchsorted(starts, offsets)
        return self.ids[place], np.concatenate([[0], ends_out])[text_at]

    def _learn(self, data: np.ndarray, unique: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) > CACHE_CHUNKS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != unique) if len(self.keys) else np.arange(len(unique))
        if not len(new):
            return
        # new chunks form one text; a newline before each that does not start with a space keeps it apart
        solid = tv.NOT_SPACE[data[ends[new] - 1]]
        spaced = data[starts[new]] == 0x20
        pieces, kinds = [], []
        blanks: list[int] = []
        for k, i in enumerate(new):
            if solid[k]:
                if not spaced[k]:
                    pieces.append(b"\n")
                    kinds.append(-1)
                pieces.append(data[starts[i] : ends[i]].tobytes())
                kinds.append(k)
            else:
                blanks.append(k)
        ids = self._whole([b"".join(pieces).decode()])[0] if pieces else np.zeros(0, np.uint32)
        ends_by_id = np.cumsum(self.id_bytes[ids])
        ends_by_piece = np.cumsum([len(x) for x in pieces], dtype=np.int64)
        cut = np.searchsorted(ends_by_id, ends_by_piece) + 1
        if len(cut) and not np.array_equal(ends_by_id[cut - 1], ends_by_piece):
            raise AssertionError("a token crosses chunks")
        begin = np.concatenate([[0], cut[:-1]])
        first, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        kinds = np.array(kinds, np.int64)
        real = kinds >= 0
        base = len(self.ids)
        first[kinds[real]] = begin[real] + base
        count[kinds[real]] = cut[real] - begin[real]
        parts = [self.ids, ids]
        base += len(ids)
        for k, each in zip(blanks, self._whole([data[starts[new[k]] : ends[new[k]]].tobytes().decode() for k in blanks]) if blanks else [], strict=True):
            first[k], count[k] = base, len(each)
            parts.append(each)
            base += len(each)
        self.ids = np.concatenate(parts)
        where = np.searchsorted(self.keys, unique[new])
        self.keys = np.insert(self.keys, where, unique[new])
        self.first = np.insert(self.first, where, first.astype(np.int32))
        self.count = np.insert(self.count, where, count.astype(np.int32))


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that cover the bytes: a solid run with the one space before it, and what is left of white space.

    White space before a solid run splits into all but its last character, and that character; the last joins the run if it
    is a space. At a text's end white space stays whole.
    """
    n = len(data)
    solid = tv.NOT_SPACE[data]
    texts = offsets[:-1][offsets[:-1] < n]
    begin = np.zeros(n + 1, bool)
    begin[texts] = True
    begin[n] = True
    inside = ~begin[1:n]  # positions 1..n-1 in the same text as the one before
    after_solid = solid[:-1] & inside
    # white space after a solid run starts a chunk
    begin[1:n] |= after_solid & ~solid[1:]
    # the last white space before a solid run starts a chunk (alone, or with the run if it is a space)
    last_blank = ~solid[:-1] & solid[1:] & inside
    begin[: n - 1] |= last_blank
    # a run after other white space than a space starts its own chunk
    begin[1:n] |= last_blank & (data[:-1] != 0x20)
    starts = np.flatnonzero(begin[:n])
    return starts, np.append(starts[1:], n)


def encoded(batch_texts: pa.Array, path: str, end_id: int, limit: int = TOKEN_SLICE):
    """(first row, end row, ids with end_id after each text, offsets of texts in them) of slices."""
    tokenizer = ChunkedTokenizer.at(path)
    texts = pc.fill_null(batch_texts.cast(pa.large_string()), "")
    for a, b, data, offsets in tv.slices(texts, limit):
        ids, at = tokenizer.encode(texts.slice(a, b - a), data, offsets)
        out = np.full(len(ids) + b - a, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(at))] = ids
        yield a, b, out, at + np.arange(b - a + 1)
