import random
import re

import pytest

from twinleaf.llm import jaccard_join
from twinleaf.llm.components import components

from .conftest import DOCUMENTS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(id, size, smallest linked id) of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    least = {r: (None if None in ids else min(ids)) for r, ids in low.items()}
    return sorted((str(d), len(sets[i]), str(least[root(i)])) for i, (d, _) in enumerate(rows))


def got(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.components_of(docs).collect())


def test_against_brute_force(awkward):
    assert got(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_in_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    rows, d = [], 0
    for _ in range(6):
        words = prose(rng, rng.choice([20, 60, 150])).split()
        shared = prose(rng, 25)
        for _ in range(rng.randint(2, 25)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 4)}"
            if rng.random() < 0.3:
                words = copy
            rows.append((d, " ".join(copy) + (" " + shared if rng.random() < 0.5 else "")))
            d += 1
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_one_of_each_group_stays(awkward, clashing):
    kept = jaccard_join.deduplicate(awkward).collect()
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    # a group's smallest id stays, once; rows without words stay as they are
    texts = {str(r.doc_id): r.text for r in awkward.collect()}
    expected = sorted({d for d, n, c in want if n and d == c} | {d for d, n, _ in want if not n})
    assert sorted(str(r.doc_id) for r in kept) == expected
    assert all(texts[str(r.doc_id)] == r.text for r in kept)
    assert jaccard_join.deduplicate(clashing).columns == clashing.columns


def test_empty_table(spark, nothing):
    assert got(nothing) == []
    assert got(spark.createDataFrame([(1, None, "", "", 0)], DOCUMENTS)) == [("1", 0, "1")]


def test_prefix_filter_keeps_every_similar_pair():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 40)
        x = set(rng.sample(range(50), n))
        y = set(x)
        for _ in range(rng.randint(0, 4)):
            y.discard(rng.choice(sorted(y))) if rng.random() < 0.5 and len(y) > 1 else y.add(rng.randrange(50))
        if 100 * len(x & y) >= 80 * len(x | y):
            px, py = (set(sorted(s)[: jaccard_join.prefix_size(len(s))]) for s in (x, y))
            assert px & py


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 200)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(7)}}


def test_bounds_of_bitmaps():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 1 << 50, 300).astype(np.uint64)
        y = np.concatenate([x[: rng.integers(0, 300)], rng.integers(0, 1 << 50, 40).astype(np.uint64)])
        apart = int(np.bitwise_count((jaccard_join.parity(np.unique(x)) ^ jaccard_join.parity(np.unique(y))).view(np.uint64)).sum())
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))
