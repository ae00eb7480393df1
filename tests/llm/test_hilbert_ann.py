import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleaf.llm import hilbert_ann


def brute(rows, k):
    vectors = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors.setdefault(i, []).append(np.array(v, float))
    flat = [(i, v) for i, own in vectors.items() for v in own]
    ids = np.array([i for i, _ in flat])
    m = np.stack([v for _, v in flat])
    out = {}
    for n, (i, v) in enumerate(flat):
        if i % 20 == 0:
            score = (m * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != n][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in hilbert_ann.neighbours(df, F.col("vec_id") % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 2
    x = (centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_small_tables_are_exact_with_copies_ties_and_bad_vectors(spark):
    rows = vectors(150)
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # copies, some of them queries
    rows += [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (360, [1.0, None] + [0.0] * 14), (380, [float("inf")] * 16), (400, [1.0, 2.0]), (420, [-x for x in rows[3][1]])]
    got, want = found(spark, rows), brute([r for r in rows if r[1] is None or len(r[1]) == 16], 20)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], atol=1e-9)


def test_scores_that_only_rounding_tells_apart():
    """Many more points than k whose inner products differ in the last bits."""
    rng = np.random.default_rng(2)
    one = rng.normal(size=16)
    points = np.stack([rng.permutation(one) for _ in range(300)] + [rng.normal(size=16) - 1 for _ in range(50)])
    ids = rng.permutation(len(points))
    queries = np.stack([np.full(16, 0.1), np.full(16, 1 / 3), one])
    for q, (near, scores) in zip(queries, hilbert_ann.nearest(queries, points, ids, 5), strict=True):
        exact = (points * q).sum(axis=1)
        want = np.lexsort((ids, -exact))[:5]
        assert near.tolist() == ids[want].tolist() and scores.tolist() == exact[want].tolist()


def test_clashing_columns_change_nothing(spark):
    plain = spark.createDataFrame(vectors(60), "vec_id long, embedding array<float>")
    more = plain.select("*", *(F.lit(1).alias(c) for c in ("id", "vector", "cls", "ids", "asked", "near", "score", "rank", "query_id")))
    told = lambda rows: sorted(map(str, hilbert_ann.neighbours(rows, F.col("vec_id") % 20 == 0).collect()))
    assert told(more) == told(plain)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "SMALLEST", 32)
    rows = vectors(3000, seed=3)
    got, want = found(spark, rows), brute(rows, 20)
    share = np.mean([len({i for i, _ in got[q]} & {i for i, _ in near}) / 20 for q, near in want.items()])
    assert share >= 0.9 and all(len(x) == 20 for x in got.values())


def test_few_candidates_and_none(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]) == {0: [(1, 0.5)]}
    assert found(spark, []) == {} and found(spark, [(20, [1.0])]) == {}
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == {}


@pytest.mark.parametrize(("dim", "bits"), [(2, 3), (3, 2)])
def test_the_curve_visits_neighbouring_cells_in_turn(dim, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
    keys = hilbert_ann.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
