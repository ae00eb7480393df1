import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from twinleaf.llm import textvec as tv

TEXT = st.text(alphabet="aB zé\n\t\x0b 中.|", max_size=30)


def one(text):
    return next(iter(tv.slices(pa.array([text], pa.large_string()))))[2:]


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    got = []
    for a, b, data, offsets in tv.slices(pa.array(texts, pa.large_string()), limit):
        _, starts, ends, at = tv.words(data, offsets)
        got += [[data[starts[k] : ends[k]].tobytes().decode() for k in range(at[i], at[i + 1])] for i in range(b - a)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_lines_and_keys(texts):
    for a, b, data, offsets in tv.slices(pa.array(texts, pa.large_string())):
        s, e, at = tv.lines(data, offsets)
        x, y = tv.strip(data, s, e)
        for i in range(b - a):
            lines = texts[a + i].split("\n")
            assert [data[s[k] : e[k]].tobytes().decode() for k in range(at[i], at[i + 1])] == lines
            assert [data[x[k] : y[k]].tobytes().decode() for k in range(at[i], at[i + 1])] == [l.strip("\x20\x09\x0a\x0b\x0c\x0d") for l in lines]


def test_equal_words_hash_alike_and_others_do_not():
    texts = ["The cat", "a the CAT sat", "é É"]
    h = np.concatenate(tv.text_hashes(texts))
    the, cat, a, the2, cat2, sat, low, high = h
    assert the == the2 and cat == cat2 and low != high
    assert len({int(x) for x in (the, cat, a, sat, low, high)}) == 6


def test_nulls_count_as_empty():
    assert [x[2].tobytes() for x in tv.slices(pa.array([None, "x"]))] == [b"x"]
    assert list(tv.slices(pa.array([], pa.string()))) == []


def test_ngrams():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(tv.ngram_hashes(h, 5)) == 3 and len(tv.ngram_hashes(h[:4], 5)) == 0
    assert len(set(tv.ngram_hashes(h, 2).tolist())) == 6
