import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from twinleaf.plans import catalog, corpora, engine
from twinleaf.sources.tables import from_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def canon(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    at = [want.columns.index(c) for c in names]
    assert canon(rows) == canon(tuple(r[i] for i in at) for r in want.fetchall())


def events():
    got = duckdb.sql(f"SELECT user_id, list(event_type ORDER BY ts, event_id, event_type) FROM '{SF}/events.parquet' GROUP BY 1").fetchall()
    return dict(got)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_and_scores_against_brute_force(spark):
    users = events()
    ratio = {(x, y): 2 * lcs(users[x], users[y]) / (len(users[x]) + len(users[y])) for x in users for y in users if x < y}
    band = {(x, y): r for (x, y), r in ratio.items() if min(len(users[x]), len(users[y])) / max(len(users[x]), len(users[y])) >= 0.4}
    assert {(r.a, r.b): r.ratio for r in catalog.lcs_ratio(spark, SF).collect()} == band
    want = {}
    for (x, y), stmt in band.items():
        counts = [{t: u.count(t) for t in u} for u in (users[x], users[y])]
        keys = set(counts[0]) | set(counts[1])
        low, high = (sum(f(c.get(k, 0) for c in counts) for k in keys) for f in (min, max))
        k = [len(c) for c in counts]
        sig = 0.7 * (1 - abs(k[0] - k[1]) / max(k)) + 0.3
        score = 0.4 * (low / high) + 0.2 * stmt + 0.15 * (low / high) + 0.1 * sig + 0.1 * 0.0 + 0.05 * 0.0
        if score >= 0.6:
            want[x, y] = score
    assert {(r.a, r.b): r.similarity for r in catalog.near_scores(spark, SF).collect()} == want


def test_entry_module(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_streams_of_sources(spark, tmp_path):
    from twinleaf.streaming.functions import function_stream

    spark.createDataFrame([("a.py", "def f(): return 1\n"), ("b.py", "def (\n")], "path string, src string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, src string").parquet(str(tmp_path / "in"))
    job = function_stream(stream, features=False).select("path", "qualname", "error").writeStream.format("memory").queryName("fns").start()
    job.processAllAvailable()
    job.stop()
    rows = {r.path: r for r in spark.table("fns").collect()}
    assert rows["a.py"].qualname == "f" and rows["b.py"].error.startswith("SyntaxError")


def test_near_queries_take_every_function(spark, tmp_path):
    """Brute force in Python: many parts of one type and brand; links of kinds add up to all pairs."""
    types = ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO", "STANDARD"]
    rows = [(k, types[k % 3 if k < 20 else k % 6], f"Brand#{k % 2}", 50 if k % 11 == 0 else 1 + k % 4) for k in range(1, 41)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    good = sorted((f"pkg/brand_{b[-1]}/m{k}.py", t) for k, t, b, n in rows if n != 50)
    want = {(x[0], y[0]) for x in good for y in good if x[0] < y[0] and x[1] == y[1]}
    sf = str(tmp_path)
    scan = engine.Scan(corpora.generated(spark.read.parquet(f"{sf}/part.parquet")), canonical=False)
    assert {(r.a.path, r.b.path) for r in engine.near_matches(scan, 0.8).collect()} == want
    near = catalog.QUERIES["near_pairs"](spark, sf).collect()
    assert sum(r.links for r in near) == len(want) and {(r.a, r.b) for r in near} <= want
    got = {r.path: (r.kind, r.links) for r in catalog.QUERIES["near_members"](spark, sf).collect()}
    assert got == {p: (min(q for q, u in good if u == t), sum(u == t for _, u in good) - 1) for p, t in good}
    counts = catalog.QUERIES["report_summary"](spark, sf).first()
    assert counts.asDict() == {"exact_groups": 6, "near_matches": len(want), "abstract_candidates": len(want), "scan_errors": 40 - len(good), "plugin_errors": 0}


def test_kinds_stand_for_all_similar_pairs(spark):
    """Functions of many shapes, some alike across kinds: expanded kinds are the pairs of near_matches."""
    bodies = ["    return normalize(x, 1)", "    return normalize(x, 2)", "    y = f(x)\n    return y", "    y = f(x)\n    z = f(y)\n    return z", "    y = f(x)\n    z = g(y)\n    return z", "    for i in x:\n        yield i", "    return lambda t: (x, t)"]
    rows = [(f"m{i}.py", f"def f{i}(x):\n{bodies[i % len(bodies)]}\n") for i in range(30)]
    scan = engine.Scan(from_table(spark.createDataFrame(rows, "path string, src string")), canonical=False)
    kind = {r.path: r.like.path for r in engine.near_members(scan, 0.6).collect()}
    similar = {(r.a.path, r.b.path): r.links for r in engine.near_kinds(scan, 0.6).collect()}
    kinds = {frozenset((kind[a], kind[b])) for a, b in similar}
    pairs = {(r.a.path, r.b.path) for r in engine.near_matches(scan, 0.6).collect()}
    every = [(a, b) for a, _ in rows for b, _ in rows if a < b]
    assert pairs == {(a, b) for a, b in every if frozenset((kind[a], kind[b])) in kinds}
    assert sum(similar.values()) == len(pairs) and len(kinds) > len(set(kind.values()))
    assert {r.path: r.links for r in engine.near_members(scan, 0.6).collect()} == {a: sum(a in p for p in pairs) for a, _ in rows}
