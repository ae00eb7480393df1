from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinleaf.functions import explain
from twinleaf.functions import measures as m
from twinleaf.operators import pairs
from twinleaf.schema import EVIDENCE, FEATURES, OCCURRENCE, ddl

EMPTY = {"map<string,int>": {}, "array<string>": [], "boolean": False, "int": 0, "string": None}


def function(**given_):
    return {n: EMPTY[k] for n, k in (OCCURRENCE | FEATURES).items()} | {"qualname": "q"} | given_


def frame(spark, rows):
    """rows: (a, b, evidence)."""
    kind = ddl(OCCURRENCE | FEATURES)
    flat = [(function(**a), function(**b), *(dict.fromkeys(EVIDENCE, 0.5) | {"wrapper_score": 0.0, "curry_score": 0.0} | e).values()) for a, b, e in rows]
    return spark.createDataFrame(flat, f"a struct<{kind}>, b struct<{kind}>, " + ", ".join(f"{n} double" for n in EVIDENCE))


A, B, E = m.side("a"), m.side("b"), lambda n: F.col(n)


def values(spark, rows, column):
    df = frame(spark, [(r + ({},))[:3] for r in rows]).coalesce(1)
    return [r.v for r in df.select(column.alias("v")).collect()]


def test_scalar_scores(spark):
    wrap = lambda t: {"is_wrapper": True, "wrapper_target": t}
    rows = [(wrap("f"), wrap("f")), (wrap("f"), wrap("g")), (wrap(None), wrap(None)), (wrap("f"), {}), ({}, {})]
    assert values(spark, rows, m.wrapper_score(A, B)) == [0.85, 0.5, 0.5, 0.25, 0.0]
    curry = lambda d: {"returns_lambda": True, "curry_depth": d}
    assert values(spark, [(curry(1), curry(1)), (curry(1), curry(2)), (curry(1), {}), ({}, {})], m.curry_score(A, B)) == [0.8, 0.6, 0.4, 0.0]
    rows = [({"param_count": 2}, {"param_count": 2}), ({"param_count": 4}, {"param_count": 2}), ({"has_yield": True}, {"has_await": True}), ({}, {"param_count": 9})]
    assert values(spark, rows, m.signature_similarity(A, B)) == [1.0, 0.7 * 0.5 + 0.3, 0.7 + 0.3 * (1 - 0.35 - 0.25), 0.7 * 0 + 0.3]
    assert values(spark, [({"stmt_count": 2}, {"stmt_count": 5}), ({}, {})], m.size_ratio(A, B)) == [0.4, 0.0]


COUNTERS = st.dictionaries(st.sampled_from("abcd"), st.integers(1, 5))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(COUNTERS, COUNTERS), min_size=1, max_size=20))
def test_counters(spark, both):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(both)], "i int, a map<string,int>, b map<string,int>")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", m.counter_jaccard(a, b).alias("j"), m.counter_jaccard(b, a).alias("k"), m.counter_distance(a, b).alias("d"), m.key_difference(a, b).alias("x"), m.total_ratio(m.total(a), m.total(b)).alias("t")).orderBy("i").collect()
    for (x, y), r in zip(both, got, strict=True):
        keys = {*x, *y}
        low, high = (sum(f(x.get(k, 0), y.get(k, 0)) for k in keys) for f in (min, max))
        assert r.j == r.k == (low / high if high else 1.0) and r.t >= r.j
        assert r.d == high - low and r.x == len({*x} ^ {*y})


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=80))
def test_lcs(a, b):
    assert m.lcs_length(a, b) == m.lcs_length(b, a) == lcs(a, b)


def test_lcs_ratio(spark):
    df = spark.createDataFrame([(0, list("abc"), list("axc")), (1, [], []), (2, ["a"], [])], "i int, a array<string>, b array<string>")
    assert [r.v for r in df.select("i", m.lcs_ratio("a", "b").alias("v")).orderBy("i").collect()] == [4 / 6, 1.0, 0.0]


def test_rounding_is_pythons(spark):
    numbers = [0.00005, 0.12345, 2.67505, 0.85, 1 / 3, 0.00015, 0.99995]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)] + [(9, None)], "i int, x double")
    assert [r.v for r in df.select("i", m.round4(F.col("x")).alias("v")).orderBy("i").collect()] == [round(x, 4) for x in numbers] + [None]


def test_notes(spark):
    rows = [
        ({}, {}),
        ({"param_count": 1, "has_await": True, "has_yield": True, "raises": 1, "is_wrapper": True, "wrapper_target": "f", "literals": 2, "control_count": 3}, {"control_count": 1}),
        ({"wrapper_target": "f"}, {"literals": 1, "control_count": 1}),
    ]
    every = ["parameter count differs (1 vs 0)", "async behavior differs", "generator behavior differs", "exception behavior differs", "wrapper targets differ", "literal density differs", "control-flow complexity differs"]
    assert values(spark, rows, explain.difference_notes(A, B)) == [[], every, []]


def test_risks(spark):
    names = {c: 1 for c in "abcdef"}
    rows = [({}, {}), ({"external_names": names, "has_await": True, "raises": 2}, {"raises": 1, "side_effect_calls": ["print"], "has_yield": True}), ({"external_names": {c: 1 for c in "abcde"}}, {})]
    every = ["ambient_dependency_diff", "async_boundary_diff", "exception_behavior_diff", "possible_side_effects", "return_shape_diff"]
    assert values(spark, rows, explain.risk_flags(A, B)) == [[], every, []]


def test_labels(spark):
    e = lambda **x: {"shape_similarity": 0.0, "stmt_similarity": 0.0, "call_similarity": 0.6, "signature_similarity": 0.0} | x
    lit = {"literal_tokens": {"int:1": 1}, "literals": 1}
    rows = [
        ({}, {}, e(wrapper_score=0.5)),
        ({}, {}, e(curry_score=0.4)),
        ({}, {}, e(shape_similarity=0.9, call_similarity=0.85)),
        (lit, {"literal_tokens": {"int:2": 1}, "literals": 1}, e(shape_similarity=0.85)),
        (lit, {"literals": 4}, e(shape_similarity=0.85)),
        ({}, {}, e(shape_similarity=0.8, stmt_similarity=0.8)),
        ({"param_count": 1}, {}, e(signature_similarity=0.8, call_similarity=0.4)),
        ({"param_count": 2}, {}, e(signature_similarity=0.8, call_similarity=0.4)),
    ]
    assert values(spark, rows, explain.pattern_labels(A, B, E)) == [["wrapper"], ["partial_application"], ["renamed_locals"], ["literal_specialization"], [], ["extract_helper_candidate"], ["same_shape_different_dependencies"], []]


def test_summary_and_template(spark):
    many = {f"c{i}": 1 for i in range(9)}
    rows = [({"stmt_seq": ["Return", "If", "If"], "call_names": many}, {"stmt_seq": ["If", "Return"], "call_names": many}), ({"stmt_seq": ["If"]}, {"stmt_seq": ["For"]})]
    assert values(spark, rows, explain.shared_summary(A, B)) == ["shared statements: If, Return; shared calls: c0, c1, c2, c3, c4, c5", "shared AST shape without strong call overlap"]
    for label, wanted in (("wrapper", True), ("literal_specialization", True), ("extract_helper_candidate", True), ("renamed_locals", False)):
        got = values(spark, [({"qualname": "x"}, {"qualname": "y"})], explain.template(A, B, F.array(F.lit(label)), F.lit("s")))
        assert got == ["def shared_helper(...):\n    # candidate abstraction for x and y\n    # s\n    ..." if wanted else None]


def test_suggestion_cascade(spark):
    cases = [
        (["wrapper"], [], {"wrapper_score": 0.5}, "merge_into_single_function_with_param"),
        (["wrapper", "partial_application"], [], {"wrapper_score": 0.4}, "introduce_partial"),
        (["extract_helper_candidate"], [], {}, "extract_common_helper"),
        (["extract_helper_candidate", "literal_specialization"], ["possible_side_effects"], {}, "parameterize_constant"),
        (["renamed_locals"], ["return_shape_diff"], {}, "leave_separate"),
        (["renamed_locals"], ["exception_behavior_diff"], {}, "move_to_utils"),
    ]
    texts = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    for labels, risks, e, want in cases:
        assert values(spark, [({}, {}, e)], explain.suggestion(texts(labels), texts(risks), E)) == [want]
    full = dict.fromkeys(EVIDENCE, 1.0)
    assert values(spark, [({}, {}, full)], explain.refactorability(texts(["extract_helper_candidate"]), texts([]), E)) == [1.0]
    assert values(spark, [({}, {}, dict.fromkeys(EVIDENCE, 0.0))], explain.refactorability(texts([]), texts(["a"]), E)) == [0.0]


def test_band_join_is_the_nested_loop(spark):
    import random

    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 2, 3, 5, 8, 20, 50, 125, 126, 313]) if rng.random() < 0.5 else rng.randint(0, 400) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int")
    want = sorted((i, j) for i in range(150) for j in range(i + 1, 150) if min(sizes[i], sizes[j]) / max(sizes[i], sizes[j], 1) >= 0.4)
    for parts in (1, 7):
        got = pairs.band_self_join(df, "n", (A("i") < B("i")) & (F.least(A("n"), B("n")) / F.greatest(A("n"), B("n"), F.lit(1)) >= 0.4), parts)
        assert sorted((r.a.i, r.b.i) for r in got.collect()) == want
