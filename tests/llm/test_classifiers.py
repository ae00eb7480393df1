import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinleaf.llm import quality, toxicity
from twinleaf.llm import textvec as tv
from twinleaf.llm.shared import split_key

from .conftest import prose


def scores(model, texts):
    return np.concatenate([model.scores(d, o) for _, _, d, o in tv.slices(pa.array(texts, pa.large_string()))])


def corpus(kind, n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, bad = prose(rng, rng.randint(20, 120)).split(), i % 4 == 0
        if bad and kind == "toxic":
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "blackguardly", "blackguards"]))
        if bad and kind == "quality":
            text = " | ".join(text).split() if i % 8 else [w for w in text for _ in range(6)]
        rows.append((" ".join(text), int(bad) if kind == "toxic" else int(not bad)))
    return rows


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(module, kind):
    model = module.train(corpus(kind))
    test = corpus(kind, 200, seed=9)
    got = scores(model, [t for t, _ in test])
    assert ((got >= 0) & (got <= 1)).all()
    assert ((got >= module.CUT) == np.array([y for _, y in test])).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_do_not_depend_on_what_a_text_is_batched_with(module):
    model = module.train(corpus("toxic" if module is toxicity else "quality"))
    texts = [t for t, _ in corpus("quality", 30, seed=5)] + ["", None, "one", "a b"]
    alone = [scores(model, [t])[0] for t in texts]
    assert np.allclose(alone, scores(model, texts), atol=1e-5)


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("rows", [[], [("a b", 1)], [("a b", 0), ("c", 0)], [("", 1), ("", 0)], [("x", 1), ("y", 0)]])
def test_few_or_one_sided_labels(module, rows):
    got = scores(module.train(rows), ["a b c", "", None])
    assert np.isfinite(got).all() and ((got >= 0) & (got <= 1)).all()


U64 = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mixed(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & U64
    return h ^ h >> 33


def word_hash(word):
    """Of lower-cased bytes, one at a time."""
    h = sum(int(tv.RAW_TABLE[c]) * pow(ODD, i, 1 << 64) for i, c in enumerate(word.lower()))
    return mixed((h + len(word) * 0xD1B54A32D192ED03) & U64)


AWKWARD = ["", None, " \n", "one", "Two Words", "two words", "a\x0bb a a A a", "don't É école x1 10", "x" * 70 + " tail", "It's | it's | IT'S ..."]


def naive_toxicity(model, text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    x = []
    for w in words:
        parts = [w, *(w[:n] for n in toxicity.PREFIXES)]
        x.append(sum(model.embedding[k][mixed((word_hash(p) + k) & U64) >> 64 - toxicity.BITS].astype(float) for k, p in enumerate(parts)))
    z = float(model.bias)
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x[i + j] @ model.filters[width][j][:, f]) for j in range(width) if i + j < len(x)) for i in range(len(x))]
            z += max(max(at) + model.shift[k, f], 0) * model.out[k, f] if at else 0
    lang = [sum(float(model.language[word_hash(w) >> 64 - toxicity.LANG_BITS, k]) for w in words) for k in range(model.language.shape[1])]
    return 1 / (1 + np.exp(-(z + model.move[int(np.argmax(lang))])))


def naive_grams(text):
    """For each reading, a list of buckets: words, word pairs, shapes, shape pairs."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, shape = [word_hash(w) for w in words], []
    for i, w in enumerate(words):
        upper = sum(65 <= c <= 90 for c in w)
        case = 0 if not upper else 1 if upper == 1 and 65 <= w[0] <= 90 else 3 if upper * 2 >= len(w) else 2
        last = 0 if w[-1:].isalpha() or w[-1] >= 128 else w[-1]
        shape.append(mixed(((last * 8 + min(len(w) // 4, 7)) * 4 + case) * 2 + (i > 0 and h[i] == h[i - 1])))
    pairs = lambda v: [mixed((x * ODD + y * ODD * ODD + 2) & U64) for x, y in zip(v, v[1:], strict=False)]
    return [[mixed((x + k) & U64) >> 64 - quality.BITS for x in v] for k, v in enumerate((h, pairs(h), shape, pairs(shape)))]


def naive_quality(model, text):
    z = model.bias
    for k, grams in enumerate(naive_grams(text)):
        z += sum(float(model.weights[k][g]) for g in grams) / max(len(grams), 1) ** 0.5
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize(("module", "kind", "naive"), [(toxicity, "toxic", naive_toxicity), (quality, "quality", naive_quality)])
def test_scores_against_a_word_at_a_time(module, kind, naive):
    model = module.train(corpus(kind, 200))
    texts = AWKWARD + [t for t, _ in corpus(kind, 12, seed=8)]
    assert np.allclose(scores(model, texts), [naive(model, t) for t in texts], atol=1e-4)


def test_training_against_a_coordinate_at_a_time():
    """Follow-the-regularised-leader with a dictionary of coordinates."""
    rows, alpha, beta, l1, l2 = corpus("quality", 24), 0.1, 1.0, 0.02, 1.0
    z, n = defaultdict(float), defaultdict(float)
    good = sum(y for _, y in rows)
    bias, seen = np.log((good + 1) / (len(rows) - good + 1)), 0.0

    def weight(c):
        return 0.0 if abs(z[c]) <= l1 else -(z[c] - np.sign(z[c]) * l1) / ((beta + n[c] ** 0.5) / alpha + l2)

    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            x = {(k, g): c / len(grams) ** 0.5 for k, grams in enumerate(naive_grams(rows[i][0])) for g, c in Counter(grams).items()}
            w = {c: weight(c) for c in x}
            error = 1 / (1 + np.exp(-(bias + sum(w[c] * v for c, v in x.items())))) - rows[i][1]
            for c, v in x.items():
                g = error * v
                z[c] += g - ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / alpha * w[c]
                n[c] += g * g
            seen += error**2
            bias -= 0.05 * error / (1 + seen) ** 0.5
    model = quality.train(rows)
    assert np.isclose(model.bias, bias, atol=1e-5)
    got = {(k, g): model.weights[k][g] for k, g in zip(*np.nonzero(model.weights), strict=True)}
    want = {c: weight(c) for c in z if weight(c)}
    assert all(abs(got.get(c, 0) - want.get(c, 0)) < 1e-4 for c in {*got, *want}) and got


@pytest.mark.parametrize("module", [toxicity, quality])
def test_columns_of_any_type_are_carried(spark, module):
    docs = spark.createDataFrame([(1, "a b", ((1, "x"), {"k": [2.5]}))], "doc_id long, text string, extra struct<`in ner-1`:struct<`a b`:int,`c:d`:string>,m:map<string,array<double>>>")
    model = spark.sparkContext.broadcast(module.train(corpus("toxic", 40)))
    got = module.score(docs, model)
    assert got.drop("score").schema == docs.schema and got.drop("score").collect() == docs.collect()


def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(60)] + [(5, None, None), (None, 1, True), (7, 0, False), (7, 1, True)]
    return spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "modulus", "rest"), [(toxicity, 4, 2), (quality, 5, 0)])
def test_awkward_tables(spark, awkward, clashing, nothing, module, modulus, rest):
    held_out = split_key("doc_id", modulus) == rest
    model = module.fit(awkward, labels(spark), ~held_out)
    rows = module.digest(awkward, model, held_out).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows if r.doc_id is not None)
    assert module.digest(nothing, model, held_out).collect() == []
    assert module.score(clashing, model).columns == [*clashing.columns, "score"]
    assert module.score(clashing, model).count() == clashing.count()
    module.fit(nothing, labels(spark), ~held_out)


def test_labels_held_out_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus("quality", 200))], "doc_id long, text string")
    true = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus("quality", 200))], "doc_id long, quality int")
    held_out = split_key("doc_id", 5) == 0
    wrong = true.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, ~held_out).value for x in (true, wrong))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_keep_returns_the_columns_it_got(spark, clashing):
    model = quality.fit(clashing, labels(spark), F.lit(True))
    assert quality.keep(clashing, model).columns == clashing.columns
