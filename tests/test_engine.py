from textwrap import dedent

import pytest
from pyspark.sql import functions as F

from twinleaf.operators.plugins import BUILT_IN, ColumnPlugin, Finding, PythonPlugin, texts
from twinleaf.plans import engine
from twinleaf.plans.engine import Scan
from twinleaf.sources.tables import from_table

REPO = {
    "pkg/z.py": """
        def add_all(rows):
            total = 0
            for row in rows:
                if row > 1:
                    total += row
            return total
        def broken_pair(a):
            global x
    """,
    "pkg/a/x.py": """
        def sum_up(items):
            result = 0
            for item in items:
                if item > 5:
                    result += item
            return result
        def broken_pair(b):
            global x
    """,
    "pkg/wrap.py": """
        def first(a):
            return clean(a, 1)
        def second(b):
            return clean(b, 2)
        def prefix(p):
            return lambda s: p + s
        def suffix(q):
            return lambda s: s + q
    """,
    "pkg/effects.py": """
        def save(path, rows):
            with open(path, 'w') as fh:
                for row in rows:
                    fh.write(row)
        def store(target, lines):
            with open(target, 'w') as out:
                for line in lines:
                    out.write(line)
        def one(rows):
            for row in rows:
                print(row)
        def two(rows):
            for row in rows:
                yield row
    """,
    "pkg/bad.py": "def broken(:\n",
    "pkg/worse.py": "x = '\x00'",
    "pkg/__init__.py": "def in_init(a):\n    return helper(a)\n",
}


def table(spark, files):
    return spark.createDataFrame([(p, dedent(s)) for p, s in files.items()], "path string, src string")


@pytest.fixture(scope="module")
def scan(spark):
    return Scan(from_table(table(spark, REPO)), normal=(True, True))


@pytest.fixture(scope="module")
def near(scan):
    return {(r.a.qualname, r.b.qualname): r for r in engine.near_matches(scan, 0.75).collect()}


def test_errors_are_rows_in_scan_order(scan):
    first, second = scan.error_messages()
    assert first.startswith("pkg/bad.py: SyntaxError: ") and second.startswith("pkg/worse.py: SyntaxError: ")
    assert scan.error_messages(1) == [first]
    assert scan.functions().where("path = 'pkg/__init__.py'").count() == 1


def test_strict_raises_for_the_first_bad_file(spark):
    strict = Scan(from_table(table(spark, REPO)), strict=True)
    with pytest.raises(RuntimeError, match=r"Failed to parse/read pkg/bad.py: SyntaxError"):
        engine.exact_groups(strict)


def test_exact_groups(spark, scan):
    groups = engine.exact_groups(scan, include_canonical=True).collect()
    assert [g["count"] for g in groups] == sorted((g["count"] for g in groups), reverse=True)
    members = {tuple(o.qualname for o in g.occurrences) for g in groups}
    assert ("sum_up", "add_all") in members and ("save", "store") in members and ("first", "second") in members
    assert all(g.canonical.startswith(("FunctionDef", "AsyncFunctionDef")) and len(g.hash) == 64 for g in groups)
    assert engine.exact_groups(scan, 3).collect() == []
    assert all(g.canonical is None for g in engine.exact_groups(scan).collect())
    plain = Scan(from_table(table(spark, REPO)))
    assert {tuple(o.qualname for o in g.occurrences) for g in engine.exact_groups(plain).collect()} == {("broken_pair", "broken_pair")}


def test_near_pairs(near):
    row = near["add_all", "sum_up"]  # a file of a directory is scanned before its subdirectories
    assert row.similarity_score == 0.85 and row.a.path == "pkg/z.py"
    assert row.suggested_refactor_kind == "parameterize_constant" and "literal_specialization" in row.pattern_labels
    assert ("broken_pair", "broken_pair") not in near  # no statement, no pair
    assert near["first", "second"].suggested_refactor_kind == "merge_into_single_function_with_param"
    assert near["prefix", "suffix"].suggested_refactor_kind == "introduce_partial"
    risky = near["save", "store"]
    assert risky.risk_flags == ["ambient_dependency_diff", "possible_side_effects"] and risky.suggested_refactor_kind == "extract_common_helper"
    assert risky.metadata.side_effects.calls == ["fh.write", "open", "out.write"] and risky.metadata.wrapper is None
    assert ("one", "two") not in near
    assert all(0 <= r.similarity_score <= 1 and 0 <= r.refactorability_score <= 1 for r in near.values())


def test_ranking_and_top_k(scan):
    rows = engine.near_matches(scan, 0.5).collect()
    keys = [(-r.refactorability_score, -r.similarity_score, r.a.path, r.a.lineno, r.b.path, r.b.lineno) for r in rows]
    assert keys == sorted(keys) and len(rows) > 4
    assert engine.near_matches(scan, 0.5, 3).collect() == rows[:3]
    assert engine.near_matches(scan, 0.5, 0).collect() == []
    worth = [r for r in rows if r.suggested_refactor_kind != "leave_separate"]
    assert engine.abstract_candidates(scan, 0.5).collect() == worth
    assert engine.abstract_candidates(scan, 0.5, 4).collect() == [r for r in rows[:4] if r.suggested_refactor_kind != "leave_separate"]


@pytest.mark.parametrize(("call", "text"), [(lambda s: engine.exact_groups(s, 1), "min_count"), (lambda s: engine.near_matches(s, 1.5), "threshold"), (lambda s: engine.near_matches(s, 0.5, -1), "top_k")])
def test_guards(scan, call, text):
    with pytest.raises(ValueError, match=text):
        call(scan)


def test_bounds_lose_no_pair(spark, scan):
    """Every pair of the nested loop that reaches the threshold is there."""
    from twinleaf.functions import measures as m
    from twinleaf.schema import EVIDENCE, OCCURRENCE

    rows = scan.functions().collect()
    key = lambda r: ([tuple(x) for x in r.scan_key], r.lineno)
    rows.sort(key=key)
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if min(a.stmt_count, b.stmt_count) / max(a.stmt_count, b.stmt_count, 1) < 0.4:
                continue
            jac = lambda x, y: (sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})) if x or y else 1.0
            sig = max(0.0, min(1.0, 0.7 * (1 - abs(a.param_count - b.param_count) / max(a.param_count, b.param_count, 1)) + 0.3 * (1.0 - (0.35 if a.has_yield != b.has_yield else 0) - (0.25 if a.has_await != b.has_await else 0))))
            wrap = (0.85 if a.wrapper_target == b.wrapper_target else 0.5) if a.is_wrapper and b.is_wrapper else 0.25 if a.is_wrapper or b.is_wrapper else 0.0
            curry = (0.8 if a.curry_depth == b.curry_depth else 0.6) if a.returns_lambda and b.returns_lambda else 0.4 if a.returns_lambda or b.returns_lambda else 0.0
            score = 0.4 * jac(a.node_types, b.node_types) + 0.2 * m._lcs_ratio(a.stmt_seq, b.stmt_seq) + 0.15 * jac(a.call_names, b.call_names) + 0.1 * sig + 0.1 * wrap + 0.05 * curry
            if score >= 0.6:
                want.add((a.path, a.lineno, b.path, b.lineno, score))
    scored = engine.scored_pairs(scan.functions().select("rel", "scan_key", *OCCURRENCE, *(c for c in scan.rows.columns if c in m.__dict__ or c in ("node_types", "stmt_seq", "call_names", "has_yield", "has_await", "is_wrapper", "wrapper_target", "returns_lambda", "curry_depth", "stmt_count"))), 0.6)
    assert {(r.a.path, r.a.lineno, r.b.path, r.b.lineno, r.similarity) for r in scored.collect()} == want and len(EVIDENCE) == 6


def _shout(a, b, evidence):
    if a["name"] == "first":
        raise KeyError("first")
    return {"labels": ["loud", "loud"], "suggestion": "shout", "delta": 0.5, "metadata": {"n": len(a["source"].splitlines())}} if a["name"] == "prefix" else None


def test_plugins_merge_in_order_and_fail_alone(spark):
    quiet = ColumnPlugin("quiet", lambda a, b, e: Finding(a("name") == "prefix", texts("hush"), suggestion="hush", metadata={"at": a("lineno")}))
    scan = Scan(from_table(table(spark, REPO)), canonical=False, source=True)
    rows = engine.near_matches(scan, 0.75, None, (PythonPlugin("loud", _shout), quiet, *BUILT_IN)).persist()
    got = {(r.a.qualname, r.b.qualname): r for r in rows.collect()}
    row = got["prefix", "suffix"]
    assert row.suggested_refactor_kind == "shout" and {"loud", "hush"} <= set(row.pattern_labels) and row.pattern_labels.count("loud") == 1
    assert row.metadata.custom == {"loud": '{"n": 2}'} and row.metadata.quiet.at == 6 and row.refactorability_score == 1.0
    failed = got["first", "second"]
    assert failed.plugin_errors == ["loud: KeyError: 'first'"] and "wrapper" in failed.pattern_labels and failed.metadata.custom == {}
    assert [r.message for r in engine.plugin_errors(rows).collect()] == ["loud: KeyError: 'first'"]
    with pytest.raises(ValueError, match="source=True"):
        engine.near_matches(Scan(from_table(table(spark, REPO))), 0.8, None, (PythonPlugin("loud", _shout),))


def test_empty_sources(spark):
    scan = Scan(from_table(table(spark, {"a.txt": "x"})))
    assert engine.exact_groups(scan).collect() == [] and engine.near_matches(scan).collect() == [] and scan.error_messages() == []
    assert engine.near_matches(scan).agg(F.count("*")).first()[0] == 0


def test_the_plan_pushes_bounds_below_the_sequences(spark, scan):
    from twinleaf.schema import FEATURES, OCCURRENCE

    plan = engine.scored_pairs(scan.functions().select("rel", "scan_key", *OCCURRENCE, *FEATURES), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")  # the join and its bounds run first, below the function
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_registry_takes_classes_and_instances(spark, tmp_path):
    import json

    from twinleaf.operators.plugins import Registry
    from twinleaf.plans import sinks

    registry = Registry()

    @registry.register
    class Tag:
        name = "tag"

        def analyze(self, a, b, evidence):
            return {"labels": ["tagged"], "metadata": {"shape": evidence["shape_similarity"]}}

    quiet = registry.register(ColumnPlugin("never", lambda a, b, e: Finding(F.lit(False), texts("x"))))
    assert [p.name for p in registry.plugins[-2:]] == ["tag", "never"] and registry.plugins[-1] is quiet
    scan = Scan(from_table(table(spark, REPO)), canonical=False, source=True)
    rows = engine.near_matches(scan, 0.75, None, registry.plugins)
    assert all("tagged" in r.pattern_labels and "x" not in r.pattern_labels for r in rows.collect())
    sinks.save(rows.select("a", "abstract_template", "metadata"), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == rows.count() and all("abstract_template" in x and json.loads(x["metadata"]["custom"]["tag"])["shape"] > 0 for x in lines)


def test_kept_parts_split_groups(spark):
    files = {"a.py": "def f(x):\n    'one'\n    return 1\n", "b.py": "def f(x):\n    'two'\n    return 1\n"}
    assert engine.exact_groups(Scan(from_table(table(spark, files)))).count() == 1
    assert engine.exact_groups(Scan(from_table(table(spark, files)), keep=frozenset(["docstrings"]))).count() == 0
    with pytest.raises(ValueError, match="unknown parts"):
        Scan(from_table(table(spark, files)), keep=frozenset(["x"]))
