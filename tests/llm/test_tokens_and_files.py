import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from twinleaf.llm import packing, token_files, tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_library_ids(name):
    rng = random.Random(1)
    alphabet = " \n\t ab'sé.,1 　|\x0b\x1c don't  é中😀<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "\n\n", "<|endoftext|>", " <|endoftext|> a", "word " * 3000]
    path = public_tokenizers.path(name)
    got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in tokens.encoded(pa.array(texts), path, 2, 2000) for i in range(b - a)]
    assert got == [x + [2] for x in library_ids(texts, path)]


def test_forgetting_the_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 5)
    texts = [f"some words {i} and, more words{i % 7}" for i in range(200)]
    got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in tokens.encoded(pa.array(texts), PATH, 2, 300) for i in range(b - a)]
    assert got == [x + [2] for x in library_ids(texts)]


def expected(rows):
    ids = [np.array(x + [2], "<u4") for x in library_ids([r.text for r in rows])]
    return list(zip([r.doc_id for r in rows], ids, strict=True))


def test_files_round_trip(awkward):
    # rows of one id have the same text, and null comes first
    rows = sorted(expected(awkward.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for d, ids in rows:
        want.append((str(d), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.round_trip(awkward, PATH, sequence=64).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_random_access_reads_equal_length_sequences(awkward):
    files = token_files.write(awkward, PATH, sequence=64)
    every = dict.fromkeys(range(0))
    flat = []
    for entry in files:
        file = token_files.SequenceFile(entry["uri"])
        part = []
        for k in range(-(-entry["n_tokens"] // 64)):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 64
            part.append(ids[mask])
        part = np.concatenate(part)
        assert len(part) == entry["n_tokens"] and np.array_equal(part, file.read(0, entry["n_tokens"]))
        flat.append(part)
    assert sum(map(len, flat)) == sum(len(ids) for _, ids in expected(awkward.collect())) and not every


def test_clashing_columns_change_nothing(awkward, clashing):
    told = lambda docs: sorted(map(str, token_files.round_trip(docs, PATH, sequence=64).collect()))
    assert told(clashing) == told(awkward)


def test_no_rows_no_files(nothing):
    assert token_files.write(nothing, PATH) == []
    assert token_files.round_trip(nothing, PATH).collect() == []


def test_packing_places_every_token_once(awkward):
    docs = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = dict(expected(docs.collect()))
    rows = packing.pack(docs, PATH, capacity=256).collect()
    places, pieces = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    for d, own in pieces.items():
        end = 0
        for i, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (i, end) and (length == 256 or i == 0)
            end += length
        assert end == len(ids[d])
    assert set(pieces) == set(ids)
    assert len(places) <= -(-sum(map(len, ids.values())) // 256) + 2


def test_packing_edge_cases(nothing, awkward, clashing):
    assert packing.pack(nothing, PATH).collect() == []
    assert packing.pack(clashing, PATH).count() == packing.pack(awkward, PATH).count()


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1024: 5}, {600: 7, 500: 3, 424: 9}, {513: 10}, {341: 30, 342: 30, 1: 100}])
def test_configurations_cover_exactly(histogram):
    used = {}
    for copies, times in packing.configurations(histogram, 1024)[0]:
        assert times > 0 and sum(s * n for s, n in copies.items()) <= 1024
        for s, n in copies.items():
            used[s] = used.get(s, 0) + n * times
    assert used == histogram


def test_packing_is_about_as_dense_as_best_fit():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1, 4000).astype(int) + 1, 1023), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    rooms, best = np.zeros(1025, int), 0
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            free = np.flatnonzero(rooms[s:])
            if len(free):
                rooms[s + free[0]] -= 1
                rooms[free[0]] += 1
            else:
                best += 1
                rooms[1024 - s] += 1
    assert sum(n for _, n in packing.configurations(histogram, 1024)[0]) <= best * 1.005 + 1


def test_the_program_covers_all_and_places_most_pieces():
    rng = np.random.default_rng(4)
    lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1, 16000).astype(int) + 1, 1024), return_counts=True)
    covered = np.zeros(len(lengths))
    for places, copies, amount in packing.fractional(lengths, counts, 1024):
        assert copies @ lengths[places] <= 1024
        covered[places] += amount * copies
    assert (covered >= counts * (1 - 1e-6)).all()
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    out, rounded = packing.configurations(histogram, 1024)
    short = sum(n for s, n in histogram.items() if s < 1024)
    assert sum(sum(c.values()) * n for c, n in out[:rounded] if 1024 not in c) >= 0.9 * short
    assert sum(n for _, n in out) <= -(-sum(s * n for s, n in histogram.items()) // 1024) * 1.001 + 2


def test_knapsack_and_fill_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 12, 4))
        values = rng.random(len(sizes))
        room = int(rng.integers(1, 20))

        def best(i, left, price, most):
            if i == len(sizes):
                return 0.0
            return max(price[i] * n + best(i + 1, left - n * sizes[i], price, most) for n in range(min(left // sizes[i], most[i]) + 1))

        values_of, pick = packing.knapsack(values, sizes, room)
        held = packing.taken(pick, sizes, room)
        assert sum(sizes[i] * n for i, n in held.items()) <= room
        want = best(0, room, values, [99] * len(sizes))
        assert abs(sum(values[i] * n for i, n in held.items()) - want) < 1e-9 and abs(values_of[room] - want) < 1e-9
        left = rng.integers(0, 3, len(sizes))
        got = packing.fill(sizes, left, room)
        assert (got <= left).all() and got @ sizes == round(best(0, room, sizes, left))


def test_hot_lengths_are_split_by_task(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words in all").alias("text")).repartition(7)
    rows = packing.pack(docs, PATH, capacity=32).collect()
    n = len(library_ids(["same words in all"])[0]) + 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == -(-500 // (32 // n))
