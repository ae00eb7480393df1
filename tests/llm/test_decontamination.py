import hashlib
import random
import re

import numpy as np
import pytest

from twinleaf.llm import decontamination as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items, window=10):
    wins = {}
    for name, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def items():
    rng = random.Random(9)
    from tests.llm.conftest import prose

    long = prose(rng, 40)
    rows = [(1, long), (2, long[20:120] + " tail words"), (3, "a b c d"), (4, None), (5, ""), (6, "one"), (7, "one"), (8, "it's THE it's the it's the it's the it's the it's the it's the"), (None, "no id here")]
    return rows, long


@pytest.mark.parametrize("shard_words", [1_000_000, 12])
def test_against_brute_force(spark, awkward, shard_words):
    rows, long = items()
    mixed = [(200, "lead in " + long + " follow up"), (201, " ".join(long.split()[:9])), (202, "x " + " ".join(long.split()[5:25]).upper() + ", y"), (203, "it's the " * 9)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string"))
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.digest(docs, bench, shard_words=shard_words).collect())
    every = docs.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(every, brute([r.text for r in every], [x for x in rows if x[0] is not None]), strict=True))
    assert got == want


def test_clean_removes_spans_and_whole_copies(spark):
    rows, long = items()
    docs = spark.createDataFrame([(1, f"{'q ' * 60}before {long} after"), (2, long), (3, "clean text stays")], "doc_id long, text string").selectExpr("*", "1 AS n_hit", "2 AS spans")
    out = dc.clean(docs, spark.createDataFrame(rows[:1], "item_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns
    assert set(got) == {1, 3} and long not in got[1] and got[1].startswith("q ") and got[1].endswith("after") and got[3] == "clean text stays"


def test_clashing_columns_change_nothing(spark, awkward, clashing):
    bench = spark.createDataFrame(items()[0], "item_id long, text string")
    bench = bench.selectExpr("*", "1 AS i", "2 AS t", "3 AS spans")
    told = lambda docs: sorted(map(str, dc.digest(docs, bench).collect()))
    assert told(clashing) == told(awkward)


def test_columns_of_any_type_are_carried(spark):
    docs = spark.createDataFrame([(1, "one", (1, [2]))], "doc_id long, text string, extra struct<`a b`:int,`c-d`:array<int>>")
    out = dc.clean(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert out.schema == docs.schema and out.collect() == docs.collect()


def test_empty_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.digest(awkward, none).collect())
    assert dc.digest(nothing, none).collect() == []


def test_random_automata_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.randint(1, 4)
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        machine = dc.Automaton([(str(j), np.array(s, np.uint64) + np.uint64(1)) for j, s in enumerate(seqs)], window)
        text = [rng.randint(0, 2) for _ in range(15)]
        ids = [int(np.searchsorted(machine.vocabulary, x + 1)) if x + 1 in machine.vocabulary else 99 for x in text]
        found = set()
        hit = {k for a, b in machine.stream(ids, found) for k in range(a, b)}
        want, who = set(), set()
        for j, s in enumerate(seqs):
            n = min(window, len(s))
            for i in range(len(s) - n + 1):
                for p in range(len(text) - n + 1):
                    if text[p : p + n] == s[i : i + n]:
                        want |= set(range(p, p + n))
                        who.add(j)
        assert hit == want and found == who
