import pickle
import random

import pyarrow as pa
import pytest

from twinleaf.functions import measures as m
from twinleaf.operators import blocks

LENGTHS = (0, 1, 2, 62, 63, 64, 65, 126, 127, 128, 129, 189, 190, 191, 254, 300)


def users(seed, count, tokens="abcde"):
    """(id, tokens) with runs, so that carries go through whole words."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        n = rng.choice(LENGTHS)
        kinds = tokens if i % 3 else tokens[:1]
        out.append((i, [rng.choice(kinds) for _ in range(n)]))
    return out


def jaccard(a, b):
    low, high = (sum(f(a.count(t), b.count(t)) for t in {*a, *b}) for f in (min, max))
    return low / high if high else 1.0


def in_band(rows):
    return [(x, y) for x in rows for y in rows if x[0] < y[0] and min(len(x[1]), len(y[1])) / max(len(x[1]), len(y[1]), 1) >= 0.4]


@pytest.mark.parametrize("score, value, read", [(blocks.size_ratios, lambda a, b: min(len(a), len(b)) / max(len(a), len(b)), "n"), (blocks.jaccards, jaccard, "node_types"), (blocks.lcs_ratios, m._lcs_ratio, "stmt_seq")])
def test_all_pairs_of_many_blocks(spark, monkeypatch, score, value, read):
    """Every pair once, in as many tasks as blocks meet, and not the whole of a bucket in one."""
    monkeypatch.setattr(blocks, "BLOCK", 9)
    rows = users(5, 90)
    df = spark.createDataFrame([(i, len(s), s, {t: s.count(t) for t in s}) for i, s in rows] + [(None, 3, ["a"], {"a": 3})], "user_id long, n int, stmt_seq array<string>, node_types map<string,int>")
    met = blocks.block_pairs(df.select("user_id", "n", *({read} - {"n"})), "n", ["user_id"], ["user_id"], score, ["value"])
    assert sorted(met.collect()) == [(x[0], y[0], value(x[1], y[1])) for x, y in in_band(rows)]
    tasks = met.rdd.glom().map(len).collect()
    assert len(tasks) > 20 and max(tasks) <= 400  # two blocks of up to 20 rows


@pytest.mark.parametrize("room", [1 << 25, 1 << 11])
def test_sequences_of_any_length_at_once(monkeypatch, room):
    """Words and their carries, and masks that do not fit at a time."""
    monkeypatch.setattr(blocks, "MASKS", room)

    def block(rows):
        seqs = pa.array([s for _, s in rows], pa.list_(pa.string()))
        shown = pa.BufferOutputStream()
        pa.ipc.new_stream(shown, pa.schema([])).close()
        return blocks.Block(pickle.dumps((shown.getvalue().to_pybytes(), [(i,) for i, _ in rows], {"stmt_seq": blocks._packed(seqs)})))

    left, right = users(1, 60, "abcdefgh"), users(2, 40, ["b", "a", "z", None])
    found = blocks.Sequences(block(left), block(right))
    for j, (_, t) in enumerate(right):
        for i in (list(range(60)), list(range(0, 60, 7)), []):
            got = found.ratio(j, blocks.np.array(i, blocks.np.int64))
            assert got.tolist() == [m._lcs_ratio(left[k][1], t) for k in i]


def test_no_rows(spark):
    df = spark.createDataFrame([], "user_id long, n int")
    assert blocks.block_pairs(df, "n", ["user_id"], ["user_id"], blocks.size_ratios, ["value"]).collect() == []
