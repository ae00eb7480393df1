import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinleaf.llm import gru_lm
from twinleaf.llm.shared import split_key

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\nend"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(gru_lm, "BLOCK", 3000)


def test_counts_and_base_scores_against_brute_force(awkward, small_blocks):
    rows = [r for r in awkward.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = tokens(r.text)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want.append((str(r.doc_id), held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), total, round(base, 5)))
    got = gru_lm.score(awkward, split_key("doc_id", 10) == 0, sample=30).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_empty_table(nothing):
    assert gru_lm.score(nothing, split_key("doc_id", 10) == 0).collect() == []


def test_no_training_rows(spark):
    from pyspark.sql import functions as F

    rows = gru_lm.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [r.train_tokens for r in rows] == [0, 0] and all(r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def plain_model(seed=3):
    place = np.random.default_rng(9).permutation(gru_lm.SYMBOLS)
    return gru_lm.Model(place // gru_lm.MEMBERS, place % gru_lm.MEMBERS, seed=seed)


def test_a_models_probabilities_sum_to_one():
    model = plain_model()
    states = np.random.default_rng(0).normal(size=(5, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.SYMBOLS)
    for x in states:
        assert abs(np.exp(model.log_symbols(np.repeat(x[None], len(every), axis=0), every)).sum() - 1) < 1e-4


def random_vocabulary(rng, n=3000):
    words = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    total = rng.zipf(1.6, len(words)).astype(np.int64)
    ending = rng.integers(0, 5, len(words)).astype(np.uint8)
    stats = []
    for own in np.array_split(np.arange(len(words)), 3):  # as three segments
        top = own[np.lexsort((words[own], -total[own]))][: gru_lm.TOP + 1]
        mass = np.bincount(ending[own], weights=total[own], minlength=gru_lm.ENDINGS).astype(np.int64)
        numbers = np.concatenate([mass, np.bincount(ending[own], minlength=gru_lm.ENDINGS), [(total[own] == 1).sum(), (total[own] == 2).sum(), 0]])
        stats.append((numbers.astype("<i8").tobytes(), np.stack([words[top].view(np.int64), total[top], ending[top].astype(np.int64)], axis=1).astype("<i8").tobytes()))
    return words, total, ending, gru_lm.Vocabulary(stats)


def test_shares_of_a_symbol_sum_to_one():
    words, total, ending, v = random_vocabulary(np.random.default_rng(2))
    assert v.tokens == total.sum() and v.distinct == len(words)
    symbols = v.symbols(ending, words)
    frequent = words[np.lexsort((words.view(np.int64), -total))][: gru_lm.TOP]
    assert set(words[(symbols > 0) & (symbols <= gru_lm.TOP)].tolist()) == set(frequent.tolist())
    known = 10 ** v.shares(symbols, total)
    for k in range(5):
        own = symbols == 1 + gru_lm.TOP + k
        new = 10 ** v.shares(np.array([1 + gru_lm.TOP + k], np.uint16), np.array([0]))[0]
        assert abs(known[own].sum() + new - 1) < 1e-9


def test_symbols_have_places_of_their_own():
    _, _, _, v = random_vocabulary(np.random.default_rng(3), 200)
    assert len({*zip(v.classes.tolist(), v.members.tolist())}) == gru_lm.SYMBOLS
    model = gru_lm.Model(v.classes, v.members, v.mass, v.exists)
    absent = np.flatnonzero(~v.exists)
    assert len(absent) and np.exp(model.log_symbols(np.zeros((len(absent), gru_lm.HIDDEN), np.float32), absent)).max() < 1e-9


def test_scores_follow_one_document_at_a_time():
    rng = np.random.default_rng(1)
    model = plain_model()
    sizes = np.array([1, 3, 70, 200, 5, 33, 64, 32])
    at = np.concatenate([[0], np.cumsum(sizes)])
    symbols = rng.integers(0, gru_lm.SYMBOLS, at[-1]).astype(np.uint16)
    together = gru_lm.log_likelihoods(model, symbols, at)
    sigmoid = lambda x: 1 / (1 + np.exp(x))
    h = gru_lm.HIDDEN
    for i in range(len(sizes)):
        state, out, previous = np.zeros(h), [], gru_lm.SYMBOLS
        for c in symbols[at[i] : at[i + 1]].astype(int):  # the equations, a token at a time
            put, own = model.embedding[previous] @ model.inward + model.inward_bias, state @ model.within
            reset, keep = sigmoid(put[:h] + own[:h]), sigmoid(put[h : 2 * h] + own[h : 2 * h])
            state = keep * state + (1 - keep) * np.tanh(put[2 * h :] + reset * own[2 * h :])
            k, m = model.classes[c], model.members[c]
            outer, inner = np.exp(state @ model.outward + model.outward_bias), np.exp(state @ model.member[k] + model.member_bias[k])
            out.append(np.log10(outer[k] / outer.sum() * inner[m] / inner.sum()))
            previous = c
        assert np.allclose(together[at[i] : at[i + 1]], out, atol=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    model = plain_model()
    for n in model.names:
        setattr(model, n, getattr(model, n).astype(np.float64))
    inputs, targets = rng.integers(0, gru_lm.SYMBOLS, (5, 3)), rng.integers(0, gru_lm.SYMBOLS, (5, 3))
    fresh = rng.random((5, 3)) < 0.2
    weights, state = np.ones((5, 3)), rng.normal(size=(gru_lm.HIDDEN, 3))
    _, grads, _ = model.gradients(inputs, fresh, targets, weights, state.copy())
    for n in model.names:
        x = getattr(model, n)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in x.shape)
            if n == "embedding":
                at = (int(inputs[0, 0]), at[1])
            elif n.startswith("member"):
                at = (int(model.classes[targets[1, 1]]), *at[1:])
            keep, step = x[at], 1e-5
            x[at] = keep + step
            up = model.gradients(inputs, fresh, targets, weights, state.copy())[0]
            x[at] = keep - step
            down = model.gradients(inputs, fresh, targets, weights, state.copy())[0]
            x[at] = keep
            assert abs((up - down) / (2 * step) - grads[n][at]) < 1e-5


def test_training_beats_word_frequencies_on_held_out_order():
    rng = random.Random(0)
    symbols, at = [], [0]
    for _ in range(300):
        own = [rng.randint(1, 5)]
        while len(own) < 30:
            own.append(own[-1] % 5 + 1 if rng.random() < 0.9 else rng.randint(1, 5))
        symbols += [*own, 0]
        at.append(len(symbols))
    symbols, at = np.array(symbols, np.uint16), np.array(at)
    model = gru_lm.train(plain_model(), symbols[: at[250]], at[:251], epochs=12)
    test = slice(at[250], at[300])
    got = gru_lm.log_likelihoods(model, symbols[test], at[250:] - at[250]).mean()
    share = np.bincount(symbols[: at[250]], minlength=gru_lm.SYMBOLS) / at[250]
    assert got > np.log10(share[symbols[test]]).mean() + 0.2


def test_training_takes_long_documents_to_their_end(monkeypatch):
    seen = []
    plain = gru_lm.Model.gradients
    monkeypatch.setattr(gru_lm, "PIECE", 1000)
    monkeypatch.setattr(gru_lm.Model, "gradients", lambda self, inputs, fresh, targets, weights, state: seen.append((int(weights.sum()), int(fresh.sum()), int(((inputs == gru_lm.SYMBOLS) & (weights > 0)).sum()))) or plain(self, inputs, fresh, targets, weights, state))
    sizes = np.array([5] * 60 + [4000, 900])
    at = np.concatenate([[0], np.cumsum(sizes)])
    gru_lm.train(plain_model(), np.random.default_rng(0).integers(0, 9, at[-1]).astype(np.uint16), at, epochs=2)
    assert sum(n for n, _, _ in seen) == 2 * at[-1]
    assert sum(n for _, n, _ in seen) == 2 * (len(sizes) + 3) and sum(n for _, _, n in seen) == 2 * len(sizes)


def test_numbers_are_packed_without_loss():
    for largest in (0, 255, 1 << 24, (1 << 40) + 7):
        x = np.array([0, largest // 3, largest])
        assert gru_lm.unpack(gru_lm.pack(x, gru_lm.width_of(largest)), 3).tolist() == x.tolist()
    assert gru_lm.unpack(b"", 0).tolist() == []


def test_clashing_columns_change_nothing(awkward, clashing):
    key = split_key("doc_id", 10) == 0
    cut = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in gru_lm.score(df, key, sample=0).collect())
    assert cut(clashing) == cut(awkward)


def test_weights_are_learnt_from_all_training_documents(spark, monkeypatch):
    """From a first model of no document at all, so that what is learnt comes from the rounds alone."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for i in range(60):
        own = [rng.randint(0, 4)]
        while len(own) < 3000:
            own.append((own[-1] + 1) % 5 if rng.random() < 0.9 else rng.randint(0, 4))
        rows.append((None if i == 7 else i, " ".join("abcde"[x] for x in own)))
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), split_key("doc_id", 10) == 0
    monkeypatch.setattr(gru_lm, "LESSON", 20000)
    seen = []
    plain = gru_lm.learn
    monkeypatch.setattr(gru_lm, "learn", lambda *a: seen.append(plain(*a)) or seen[-1])
    mean = (F.sum("score") / F.sum("n_tokens")).alias("m")
    got = gru_lm.score(docs, held, sample=0).agg(mean, (F.sum("base_score") / F.sum("n_tokens")).alias("base"), F.max("train_tokens").alias("n")).first()
    assert seen[0][1] == got.n > 100000
    monkeypatch.setattr(gru_lm, "learn", lambda coded, model: (model, 0))
    start = gru_lm.score(docs, held, sample=0).agg(mean).first()
    assert got.m > start.m + 0.4  # of 0.69 at the start, where symbols are as likely as frequent
    assert got.m > got.base
