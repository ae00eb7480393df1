"""Queries over whole tables that exercise each operator, and DuckDB SQL with the same result."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import explain, measures as m
from ..functions.ranking import global_rank
from ..operators import blocks, pairs
from ..operators.parse import parse
from ..operators.plugins import BUILT_IN, PythonPlugin
from ..schema import EVIDENCE
from ..sources.tables import scan_key
from . import corpora, engine, policy, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


NAME = "lower(replace(p_brand, '#', '_'))"
PATH = f"'pkg/' || {NAME} || '/m' || p_partkey || '.py'"


def by_type(**values: str) -> str:
    return "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "part")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(corpora.generated(parts(spark, sf_dir))).where("error IS NULL")


FUNCTION_NAME = by_type(SMALL="'total_'", MEDIUM="'wrap_'", LARGE="'make_'", ECONOMY="'fetch_'", PROMO="'gen_'", STANDARD="'save_'") + " || p_partkey"


@query(f"""SELECT {PATH} AS path, {FUNCTION_NAME} AS qualname, CASE p_type WHEN 'ECONOMY' THEN 'async def' ELSE 'def' END AS kind,
  CAST(1 AS INTEGER) AS lineno, CAST({by_type(SMALL='6', MEDIUM='2', LARGE='2', ECONOMY='3', PROMO='4', STANDARD='4')} AS INTEGER) AS end_lineno,
  CAST(0 AS INTEGER) AS col_offset, CAST(CASE p_type WHEN 'STANDARD' THEN 2 ELSE 1 END AS INTEGER) AS param_count, FALSE AS is_method
FROM part WHERE p_size <> 50""")
def scan_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(corpora.generated(parts(spark, sf_dir)), features=False).where("error IS NULL")
    return rows.select("path", "qualname", "kind", "lineno", "end_lineno", "col_offset", "param_count", "is_method")


@query(f"SELECT {PATH} AS path, 'SyntaxError' AS kind FROM part WHERE p_size = 50")
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(corpora.generated(parts(spark, sf_dir)), features=False).where("error IS NOT NULL")
    return rows.select("path", F.substring_index("error", ":", 1).alias("kind"))


MIXED_PATH = f"CASE WHEN p_size % 2 = 0 THEN 'pkg/m' || p_partkey || '.py' ELSE {PATH} END"


@query(f"""SELECT path, row_number() OVER (ORDER BY deep, path) AS rank FROM (SELECT {MIXED_PATH} AS path, p_size % 2 AS deep FROM part)""")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's place in the walk: files of a directory come before its subdirectories."""
    rows = parts(spark, sf_dir).select(F.expr(MIXED_PATH).alias("path"))
    return global_rank(rows.withColumn("key", scan_key(F.col("path"))), ["key"]).select("path", "rank")


EXCLUDED_PATH = "'pkg/' || CASE p_size % 5 WHEN 0 THEN 'venv/' WHEN 1 THEN 'build/x/' WHEN 2 THEN '' ELSE 'venv2/' END || 'm' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.pyi' ELSE '.py' END"


@query(f"SELECT {EXCLUDED_PATH} AS path FROM part WHERE p_size % 5 > 1 AND p_size % 3 <> 0 AND p_size <> 50")
def scan_excluded_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(corpora.generated(parts(spark, sf_dir), path=F.expr(EXCLUDED_PATH)), features=False).where("error IS NULL").select("path")


def held_in_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the functions in a class, a third under an `if`, a third plain; each with an inner function."""
    code = F.lit("def outer(x):\n    def inner(y):\n        return y\n    return inner\n")
    moved = F.replace(code, F.lit("\n"), F.lit("\n    "))
    src = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("class Box:\n    "), moved)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("if True:\n    "), moved)).otherwise(code)
    return corpora.generated(parts(spark, sf_dir), src=F.rtrim(src))


@query(f"SELECT {PATH} AS path, 'outer' AS qualname, FALSE AS is_method FROM part WHERE p_size % 3 = 2")
def scan_top_level_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(held_in_classes(spark, sf_dir), top_level_only=True, features=False).select("path", "qualname", "is_method")


@query(f"""SELECT {PATH} AS path, CASE p_size % 3 WHEN 0 THEN 'Box.' ELSE '' END || q AS qualname, p_size % 3 = 0 AND q = 'outer' AS is_method
FROM part, (VALUES ('outer'), ('outer.inner')) v(q) WHERE p_size % 3 <> 1""")
def scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(held_in_classes(spark, sf_dir), features=False).select("path", "qualname", "is_method")


@query(f"""SELECT {PATH} AS path, CAST({by_type(SMALL='27', MEDIUM='10', LARGE='14', ECONOMY='18', PROMO='21', STANDARD='33')} AS BIGINT) AS nodes,
  CAST({by_type(SMALL='15', MEDIUM='8', LARGE='9', ECONOMY='12', PROMO='15', STANDARD='15')} AS BIGINT) AS kinds,
  {by_type(SMALL="''", MEDIUM="'normalize'", LARGE="''", ECONOMY="'client.get'", PROMO="''", STANDARD="'fh.write,open,str'")} AS calls,
  {by_type(SMALL=f"{NAME} || ',item,values'", MEDIUM=f"{NAME} || ',normalize'", LARGE=f"{NAME} || ',text'", ECONOMY=f"{NAME} || ',client,resp'", PROMO=f"{NAME} || ',values'", STANDARD=f"{NAME} || ',fh,open,path,rows,str'")} AS names
FROM part WHERE p_size <> 50""")
def feat_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return functions(spark, sf_dir).select("path", m.total(F.col("node_types")).cast("long").alias("nodes"), F.size("node_types").cast("long").alias("kinds"), keys("call_names").alias("calls"), keys("external_names").alias("names"))


STATEMENTS = by_type(SMALL="'Assign,For,Return,If,AugAssign'", MEDIUM="'Return'", LARGE="'Return'", ECONOMY="'Assign,Return'", PROMO="'For,If,Expr,Yield'", STANDARD="'With,For,Expr'")


@query(f"SELECT {PATH} AS path, {STATEMENTS} AS statements FROM part WHERE p_size <> 50")
def feat_stmt_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", F.array_join("stmt_seq", ",").alias("statements"))


@query(f"""SELECT {PATH} AS path, p_type = 'PROMO' AS has_yield, p_type = 'ECONOMY' AS has_await,
  CAST({by_type(SMALL='2', MEDIUM='0', LARGE='0', ECONOMY='0', PROMO='2', STANDARD='2')} AS INTEGER) AS control_count,
  CAST({by_type(SMALL='1', MEDIUM='1', LARGE='1', ECONOMY='1', PROMO='0', STANDARD='0')} AS INTEGER) AS returns, CAST(0 AS INTEGER) AS raises,
  CAST({by_type(SMALL='2', MEDIUM='1', LARGE='1', ECONOMY='1', PROMO='2', STANDARD='2')} AS INTEGER) AS literals,
  CAST({by_type(SMALL='5', MEDIUM='1', LARGE='1', ECONOMY='2', PROMO='4', STANDARD='3')} AS INTEGER) AS stmt_count
FROM part WHERE p_size <> 50""")
def feat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", "has_yield", "has_await", "control_count", "returns", "raises", "literals", "stmt_count")


@query(f"""SELECT {PATH} AS path, p_type = 'MEDIUM' AS is_wrapper, CASE p_type WHEN 'MEDIUM' THEN 'normalize' END AS wrapper_target,
  CAST(CASE p_type WHEN 'MEDIUM' THEN 1 ELSE 0 END AS INTEGER) AS fixed_args, CAST(CASE p_type WHEN 'MEDIUM' THEN 1 ELSE 0 END AS INTEGER) AS passthrough_args
FROM part WHERE p_size <> 50""")
def feat_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", "is_wrapper", "wrapper_target", "fixed_args", "passthrough_args")


@query(f"SELECT {PATH} AS path, p_type = 'LARGE' AS returns_lambda, CAST(CASE p_type WHEN 'LARGE' THEN 1 ELSE 0 END AS INTEGER) AS curry_depth FROM part WHERE p_size <> 50")
def feat_curry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", "returns_lambda", "curry_depth")


@query(f"""SELECT {PATH} AS path, 'int:' || p_size AS token, CAST(1 AS INTEGER) AS n FROM part WHERE p_size <> 50
UNION ALL SELECT {PATH}, CASE p_type WHEN 'STANDARD' THEN 'str:w' ELSE 'int:0' END, CAST(1 AS INTEGER) FROM part WHERE p_size <> 50 AND p_type IN ('SMALL', 'PROMO', 'STANDARD')""")
def feat_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", F.explode("literal_tokens").alias("token", "n"))


@query(f"SELECT {PATH} AS path, CASE p_type WHEN 'STANDARD' THEN 'fh.write,open' ELSE '' END AS calls FROM part WHERE p_size <> 50")
def feat_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("path", F.array_join("side_effect_calls", ",").alias("calls"))


def group_rows(spark: SparkSession, sf_dir: str, normal: tuple[bool, bool], min_count: int = 2) -> DataFrame:
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), normal=normal, features=False)
    found = engine.exact_groups(scan, min_count, shown=("path",))
    return found.select("count", F.md5(F.array_join(F.transform("occurrences", lambda o: o.path), ",")).alias("members"))


def group_sql(keys: str, min_count: int = 2) -> str:
    return f"SELECT count(*) AS count, md5(string_agg({PATH}, ',' ORDER BY {PATH})) AS members FROM part WHERE p_size <> 50 GROUP BY {keys} HAVING count(*) >= {min_count}"


@query(group_sql("p_type, p_size, p_brand"))
def canonical_groups_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(spark, sf_dir, (False, False))


@query(group_sql("p_type, p_size"))
def canonical_groups_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(spark, sf_dir, (True, False))


@query(group_sql("p_type, p_brand"))
def canonical_groups_consts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(spark, sf_dir, (False, True))


@query(group_sql("p_type"))
def canonical_groups_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(spark, sf_dir, (True, True))


@query(group_sql("p_type, p_size", 5))
def exact_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(spark, sf_dir, (True, False), 5)


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def doc_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def event_pairs(spark: SparkSession, sf_dir: str, score: blocks.Score, value: str, *read: str) -> DataFrame:
    """All pairs of users in the size band, with a value of each."""
    rows = corpora.sequences(spark, sf_dir).select("user_id", "stmt_count", *read)
    met = blocks.block_pairs(rows, "stmt_count", ["user_id"], ["user_id"], score, [value])
    return met.select(F.col("a_user_id").alias("a"), F.col("b_user_id").alias("b"), value)


SIZES = "WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY user_id)"


@query(f"{SIZES} SELECT x.user_id AS a, y.user_id AS b, least(x.n, y.n) / greatest(x.n, y.n) AS size_ratio FROM u x JOIN u y ON x.user_id < y.user_id WHERE least(x.n, y.n) / greatest(x.n, y.n) >= 0.4")
def pair_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, blocks.size_ratios, "size_ratio")


COUNTS = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1),
met AS (SELECT x.user_id AS a, y.user_id AS b, sum(least(x.n, y.n)) AS shared FROM c x JOIN c y ON x.event_type = y.event_type AND x.user_id < y.user_id GROUP BY ALL),
j AS (SELECT p.user_id AS a, q.user_id AS b, CAST(coalesce(shared, 0) AS DOUBLE) / CAST(p.t + q.t - coalesce(shared, 0) AS DOUBLE) AS jaccard FROM t p JOIN t q ON p.user_id < q.user_id LEFT JOIN met ON a = p.user_id AND b = q.user_id)"""


@query(f"{COUNTS}, s AS ({SIZES.removeprefix('WITH u AS (').removesuffix(')')}) SELECT a, b, jaccard FROM j JOIN s x ON x.user_id = a JOIN s y ON y.user_id = b WHERE least(x.n, y.n) / greatest(x.n, y.n) >= 0.4")
def counter_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, blocks.jaccards, "jaccard", "node_types")


@query()
def lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, blocks.lcs_ratios, "ratio", "stmt_seq")


@query()
def near_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users whose event sequences reach a similarity of 0.6."""
    scored = blocks.similar(corpora.sequences(spark, sf_dir), 0.6, ["user_id"])
    return scored.select(F.col("a_user_id").alias("a"), F.col("b_user_id").alias("b"), "similarity", *EVIDENCE)


BOUND = "0.4::DOUBLE * jaccard + 0.2::DOUBLE * 1.0::DOUBLE + 0.15::DOUBLE * jaccard + 0.1::DOUBLE * (0.7::DOUBLE * (1.0::DOUBLE - abs(x.k - y.k) / greatest(x.k, y.k, 1)) + 0.3::DOUBLE * 1.0::DOUBLE) + 0.1::DOUBLE * 0.0::DOUBLE + 0.05::DOUBLE * 0.0::DOUBLE"


@query(f"""{COUNTS}, u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY user_id)
SELECT a, b, {BOUND} AS bound FROM j JOIN u x ON x.user_id = a JOIN u y ON y.user_id = b WHERE least(x.n, y.n) / greatest(x.n, y.n) >= 0.4 AND {BOUND} >= 0.75::DOUBLE""")
def upper_bound_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are left before sequences are compared."""
    met = blocks.similar(corpora.sequences(spark, sf_dir), 0.75, ["user_id"], sequences=False)
    return met.select(F.col("a_user_id").alias("a"), F.col("b_user_id").alias("b"), "bound")


#: All functions in scan order; p: the first two of each kind (here a kind is a template), and how many pairs they stand for.
REPS = f"""WITH r AS (SELECT p_type, {NAME} AS l, p_partkey AS k, p_size AS n, {PATH} AS path, {FUNCTION_NAME} AS qualname FROM part WHERE p_size <> 50),
f AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY path) AS place, count(*) OVER (PARTITION BY p_type) AS members FROM r),
p AS (SELECT x.p_type, x.path AS a, y.path AS b, x.qualname AS qa, y.qualname AS qb, x.n AS na, y.n AS nb, x.l AS la, y.l AS lb, x.members * (x.members - 1) // 2 AS links
 FROM f x JOIN f y ON x.p_type = y.p_type AND x.place = 1 AND y.place = 2)"""

SIMILARITY = "0.4::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE * CASE p_type WHEN 'MEDIUM' THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE * CASE p_type WHEN 'LARGE' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END"
LABELS = "CASE p_type WHEN 'MEDIUM' THEN 'wrapper,' WHEN 'LARGE' THEN 'partial_application,' ELSE '' END || 'renamed_locals,' || CASE WHEN na <> nb THEN 'literal_specialization,' ELSE '' END || 'extract_helper_candidate'"
RISKS = "CASE p_type WHEN 'STANDARD' THEN 'possible_side_effects' ELSE '' END"
SUMMARY = by_type(
    SMALL="'shared statements: Assign, AugAssign, For, If, Return'",
    MEDIUM="'shared statements: Return; shared calls: normalize'",
    LARGE="'shared statements: Return'",
    ECONOMY="'shared statements: Assign, Return; shared calls: client.get'",
    PROMO="'shared statements: Expr, For, If, Yield'",
    STANDARD="'shared statements: Expr, For, With; shared calls: fh.write, open, str'",
)
SUGGESTED = "CASE WHEN p_type = 'MEDIUM' THEN 'merge_into_single_function_with_param' WHEN p_type = 'LARGE' THEN 'introduce_partial' WHEN na <> nb THEN 'parameterize_constant' ELSE 'extract_common_helper' END"
TEMPLATE = "CASE WHEN na <> nb THEN 'def shared_helper(..., configurable_value):' || chr(10) || '    # parameterize constant-like variation' || chr(10) || '    ...' ELSE 'def shared_helper(...):' || chr(10) || '    # candidate abstraction for ' || qa || ' and ' || qb || chr(10) || '    ...' END"
REFACTOR = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + 0.2::DOUBLE * CASE p_type WHEN 'MEDIUM' THEN 0.85::DOUBLE ELSE 0 END + 0.1::DOUBLE * CASE p_type WHEN 'LARGE' THEN 0.8::DOUBLE ELSE 0 END
 + 0.08::DOUBLE + CASE WHEN na <> nb THEN 0.05::DOUBLE ELSE 0 END - CASE p_type WHEN 'STANDARD' THEN 0.1::DOUBLE ELSE 0 END)
 + (CASE p_type WHEN 'MEDIUM' THEN 0.05::DOUBLE WHEN 'LARGE' THEN 0.04::DOUBLE WHEN 'STANDARD' THEN -0.05::DOUBLE ELSE 0 END + CASE WHEN na <> nb THEN 0.03::DOUBLE ELSE 0 END + 0.05::DOUBLE)))"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first function of each kind of all parts, with the kind's size."""
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), canonical=False)
    return scan.keep(engine.kind_members(engine.with_kinds(scan.functions()))).where("place = 1")


def near_generated(spark: SparkSession, sf_dir: str, threshold: float = 0.8, top_k: int | None = None) -> DataFrame:
    """Similar kinds of the functions of all parts."""
    return engine.near_kinds(engine.Scan(corpora.generated(parts(spark, sf_dir)), canonical=False), threshold, top_k)


@query("""SELECT path, min(path) OVER (PARTITION BY p_type) AS kind, count(*) OVER (PARTITION BY p_type) - 1 AS links FROM (SELECT p_type, """ + PATH + """ AS path FROM part WHERE p_size <> 50)""")
def near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function, the first one of its kind, and how many functions are similar to it."""
    rows = engine.near_members(engine.Scan(corpora.generated(parts(spark, sf_dir)), canonical=False))
    return rows.select("path", F.col("like.path").alias("kind"), "links")


@query(f"""{REPS} SELECT a, b, round({SIMILARITY}, 4) AS similarity, round({REFACTOR}, 4) AS refactorability, {LABELS} AS labels, {RISKS} AS risks, '' AS differences,
 {SUMMARY} AS summary, {SUGGESTED} AS suggested, {TEMPLATE} AS template, links FROM p""")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(c, ",")
    return near_generated(spark, sf_dir).select(
        F.col("a.path").alias("a"),
        F.col("b.path").alias("b"),
        F.col("similarity_score").alias("similarity"),
        F.col("refactorability_score").alias("refactorability"),
        listed("pattern_labels").alias("labels"),
        listed("risk_flags").alias("risks"),
        listed("key_differences").alias("differences"),
        F.col("shared_structure_summary").alias("summary"),
        F.col("suggested_refactor_kind").alias("suggested"),
        F.col("abstract_template").alias("template"),
        "links",
    )


@query(f"""{REPS} SELECT a, b, 1.0::DOUBLE AS shape, 1.0::DOUBLE AS stmt, 1.0::DOUBLE AS call, 1.0::DOUBLE AS signature,
 CASE p_type WHEN 'MEDIUM' THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS wrapper, CASE p_type WHEN 'LARGE' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS curry, 1.0::DOUBLE AS size_ratio FROM p""")
def near_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("shape", "stmt", "call", "signature", "wrapper", "curry")
    rows = near_generated(spark, sf_dir)
    return rows.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), *(F.col(f"evidence.{e}").alias(n) for e, n in zip(EVIDENCE, names, strict=True)), F.col("metadata.size_ratio").alias("size_ratio"))


@query(f"""{REPS} SELECT a, b, CASE p_type WHEN 'MEDIUM' THEN 'normalize' END AS wrapper_target, CASE p_type WHEN 'LARGE' THEN CAST(1 AS INTEGER) END AS curry_depth,
 CASE p_type WHEN 'STANDARD' THEN 'fh.write,open' END AS calls, CASE WHEN na <> nb THEN CAST(2 AS INTEGER) END AS literal_diff FROM p""")
def plugin_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_generated(spark, sf_dir).select(
        F.col("a.path").alias("a"),
        F.col("b.path").alias("b"),
        F.col("metadata.wrapper.b_wrapper_target").alias("wrapper_target"),
        F.col("metadata.currying.a_curry_depth").alias("curry_depth"),
        F.array_join("metadata.side_effects.calls", ",").alias("calls"),
        F.col("metadata.literal_specialization.literal_token_diff").alias("literal_diff"),
    )


def _touchy(a: dict, b: dict, evidence: dict) -> dict | None:
    """A plugin that fails on lambdas and speaks of wrappers."""
    if a["returns_lambda"]:
        raise RuntimeError("lambda")
    return {"labels": ["seen"], "metadata": {"lines": a["source"].count("\n") + 1}} if a["is_wrapper"] else None


@query(f"""{REPS} SELECT a, b, CASE p_type WHEN 'LARGE' THEN 'touchy: RuntimeError: lambda' ELSE '' END AS errors, p_type = 'MEDIUM' AS seen,
 CASE p_type WHEN 'MEDIUM' THEN '{{"lines": 2}}' END AS said FROM p""")
def plugin_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), canonical=False, source=True)
    rows = engine.near_kinds(scan, 0.8, None, (*BUILT_IN, PythonPlugin("touchy", _touchy)))
    return rows.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), F.array_join("plugin_errors", ",").alias("errors"), F.array_contains("pattern_labels", "seen").alias("seen"), F.try_element_at("metadata.custom", F.lit("touchy")).alias("said"))


RANKED = f"{REPS}, q AS (SELECT a, b, round({SIMILARITY}, 4) AS similarity, round({REFACTOR}, 4) AS refactorability, {SUGGESTED} AS suggested FROM p)"
RANK_ORDER = "ORDER BY refactorability DESC, similarity DESC, a, b"


@query(f"{RANKED} SELECT a, b FROM q {RANK_ORDER} LIMIT 3")
def near_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_generated(spark, sf_dir, top_k=3).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"))


@query(f"SELECT a, b, suggested FROM ({RANKED} SELECT a, b, suggested FROM q {RANK_ORDER} LIMIT 3) WHERE suggested <> 'leave_separate'")
def abstract_topk_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.worth_merging(near_generated(spark, sf_dir, top_k=3))
    return rows.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), F.col("suggested_refactor_kind").alias("suggested"))


@query(f"""{REPS}, g AS (SELECT p_type FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(*) FROM g) AS exact_groups, (SELECT CAST(sum(links) AS BIGINT) FROM p) AS near_matches, (SELECT CAST(sum(links) AS BIGINT) FROM p) AS abstract_candidates, (SELECT count(*) FROM part WHERE p_size = 50) AS scan_errors, CAST(0 AS BIGINT) AS plugin_errors""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all findings, as the check command judges them; pairs by the kinds they are of."""
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), normal=(True, True))
    near = engine.near_kinds(scan, 0.8)
    exact = engine.group_sizes(scan).agg(F.count("*").alias("exact_groups"))
    pairs_ = near.agg(F.sum("links").alias("near_matches"), F.sum(F.when(F.col("suggested_refactor_kind") != "leave_separate", F.col("links"))).alias("abstract_candidates"), F.size(F.array_distinct(F.flatten(F.collect_set("plugin_errors")))).cast("long").alias("plugin_errors"))
    errors = scan.errors().agg(F.count("*").alias("scan_errors"))
    # three tables of one row
    return exact.join(pairs_, F.lit(True)).join(errors, F.lit(True)).select("exact_groups", "near_matches", "abstract_candidates", "scan_errors", "plugin_errors")


@query(f"{REPS} SELECT a, b FROM p WHERE p_type IN ('MEDIUM', 'LARGE')")
def near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above what call-free copies can reach, only wrapper and lambda pairs are left."""
    return near_generated(spark, sf_dir, 0.86).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"))


@query(f"{RANKED} SELECT row_number() OVER ({RANK_ORDER}) AS rank, a, b FROM q")
def near_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_generated(spark, sf_dir).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), (-F.col("refactorability_score")).alias("r"), (-F.col("similarity_score")).alias("s"))
    return global_rank(rows, ["r", "s", "a", "b"]).select("rank", "a", "b")


@query(f"{RANKED} SELECT a, b, suggested FROM q WHERE suggested <> 'leave_separate'")
def abstract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.worth_merging(near_generated(spark, sf_dir))
    return rows.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), F.col("suggested_refactor_kind").alias("suggested"))


@query(f"""{RANKED}, g AS (SELECT p_type, count(*) AS n, string_agg(qualname, ',' ORDER BY path) AS names FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT 'exact' AS section, n AS size, names AS what FROM g UNION ALL SELECT 'near', CAST(NULL AS BIGINT), a || ' ' || b FROM (SELECT a, b FROM q {RANK_ORDER} LIMIT 5)""")
def showcase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exact groups by their names, and the five best pairs."""
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), normal=(True, True))
    exact = engine.exact_groups(scan, shown=("qualname",)).select(F.lit("exact").alias("section"), F.col("count").alias("size"), F.array_join(F.transform("occurrences", lambda o: o.qualname), ",").alias("what"))
    near = engine.near_kinds(scan, 0.8, 5).select(F.lit("near").alias("section"), F.lit(None).cast("long").alias("size"), F.concat_ws(" ", "a.path", "b.path").alias("what"))
    return exact.unionByName(near)


@query(f"""{REPS}, g AS (SELECT p_type, l, n, count(*) AS size, string_agg(qualname, ', ' ORDER BY path) AS names FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT '::error title=twinleaf,file=' || path || ',line=1,col=1,endLine=' || {by_type(SMALL="'6'", MEDIUM="'2'", LARGE="'2'", ECONOMY="'3'", PROMO="'4'", STANDARD="'4'")} || '::Exact duplicate group (' || g.size || ' occurrences): ' || names AS line FROM r JOIN g USING (p_type, l, n)""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = engine.Scan(corpora.generated(parts(spark, sf_dir)), features=False)
    groups = engine.exact_groups(scan)
    names = F.array_join(F.transform("occurrences", lambda o: o.qualname), ", ")
    message = F.concat(F.lit("Exact duplicate group ("), F.col("count").cast("string"), F.lit(" occurrences): "), names)
    rows = groups.select(message.alias("message"), F.explode("occurrences").alias("at"))
    return rows.select(sinks.annotation_column("error", F.col("message"), F.col("at")).alias("line"))


@query("""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY ALL""")
def doc_token_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter build: how often each token stands in each document."""
    rows = corpora.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(f"""{REPS}, c AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY p_type HAVING count(*) > 1)) AS groups, (SELECT CAST(sum(links) AS BIGINT) FROM p) AS pairs, (SELECT count(*) FROM part WHERE p_size = 50) AS errors)
SELECT 'exact_groups' AS category, groups AS actual, CAST(2 AS BIGINT) AS allowed FROM c WHERE groups > 2
UNION ALL SELECT 'abstract_candidates', pairs, CAST(0 AS BIGINT) FROM c WHERE pairs > 0
UNION ALL SELECT 'scan_errors', errors, CAST(0 AS BIGINT) FROM c WHERE errors > 0""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check command finds: exact, near and abstraction counts and errors, all of one scan over all parts."""
    counts = report_summary(spark, sf_dir)
    return policy.violations(counts, policy.CheckConfig(max_exact_groups=2)).select("category", "actual", "allowed")


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS escaped FROM documents""")
def escape_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(sinks.escape_column(F.col("text"), True).cast("binary")).alias("escaped"))


@query(f"""{REPS} SELECT a.path AS a, b.path AS b,
 CASE WHEN a.p_type = 'MEDIUM' AND b.p_type = 'MEDIUM' THEN 0.5::DOUBLE + 0.35::DOUBLE WHEN a.p_type = 'MEDIUM' OR b.p_type = 'MEDIUM' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS wrapper,
 CASE WHEN a.p_type = 'LARGE' AND b.p_type = 'LARGE' THEN 0.8::DOUBLE WHEN a.p_type = 'LARGE' OR b.p_type = 'LARGE' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS curry,
 0.7::DOUBLE * (1.0::DOUBLE - abs(pa - pb) / greatest(pa, pb)) + 0.3::DOUBLE * (1.0::DOUBLE - CASE WHEN (a.p_type = 'PROMO') <> (b.p_type = 'PROMO') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN (a.p_type = 'ECONOMY') <> (b.p_type = 'ECONOMY') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS signature, a.members * b.members AS pairs
FROM (SELECT *, CASE p_type WHEN 'STANDARD' THEN 2 ELSE 1 END AS pa, {by_type(SMALL='5', MEDIUM='1', LARGE='1', ECONOMY='2', PROMO='4', STANDARD='3')} AS n1 FROM (SELECT p_type, min(path) AS path, count(*) AS members FROM r GROUP BY 1)) a JOIN (SELECT *, CASE p_type WHEN 'STANDARD' THEN 2 ELSE 1 END AS pb, {by_type(SMALL='5', MEDIUM='1', LARGE='1', ECONOMY='2', PROMO='4', STANDARD='3')} AS n2 FROM (SELECT p_type, min(path) AS path, count(*) AS members FROM r GROUP BY 1)) b
 ON a.path < b.path AND least(n1, n2) / greatest(n1, n2) >= 0.4""")
def pair_scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapper, currying and signature scores of all pairs of kinds in the size band, by their first functions; pairs of functions they stand for."""
    names = ["path", "stmt_count", "param_count", "has_yield", "has_await", "is_wrapper", "wrapper_target", "returns_lambda", "curry_depth", "members"]
    rows = kinds(spark, sf_dir).select(*names)
    a, b = m.side("a"), m.side("b")
    met = pairs.band_self_join(rows, "stmt_count", a("path") < b("path"))
    scored = met.withColumns({"wrapper": m.wrapper_score(a, b), "curry": m.curry_score(a, b), "signature": m.signature_similarity(a, b), "pairs": a("members") * b("members")})
    return scored.select(a("path").alias("a"), b("path").alias("b"), "wrapper", "curry", "signature", "pairs")


@query(f"""{REPS} SELECT a.path AS a, b.path AS b, CAST(
 CASE WHEN (a.p_type = 'STANDARD') <> (b.p_type = 'STANDARD') THEN 1 ELSE 0 END + CASE WHEN (a.p_type = 'ECONOMY') <> (b.p_type = 'ECONOMY') THEN 1 ELSE 0 END
 + CASE WHEN (a.p_type = 'PROMO') <> (b.p_type = 'PROMO') THEN 1 ELSE 0 END + CASE WHEN (a.p_type = 'MEDIUM') <> (b.p_type = 'MEDIUM') THEN 1 ELSE 0 END
 + CASE WHEN (a.p_type IN ('SMALL', 'PROMO', 'STANDARD')) <> (b.p_type IN ('SMALL', 'PROMO', 'STANDARD')) THEN 1 ELSE 0 END AS BIGINT) AS n_notes,
 concat_ws(',', CASE WHEN (a.p_type = 'ECONOMY') <> (b.p_type = 'ECONOMY') THEN 'async_boundary_diff' END, CASE WHEN a.p_type = 'STANDARD' OR b.p_type = 'STANDARD' THEN 'possible_side_effects' END,
  CASE WHEN (a.p_type = 'PROMO') <> (b.p_type = 'PROMO') THEN 'return_shape_diff' END) AS risks, a.members * b.members AS pairs
FROM (SELECT *, {by_type(SMALL='5', MEDIUM='1', LARGE='1', ECONOMY='2', PROMO='4', STANDARD='3')} AS n1 FROM (SELECT p_type, min(path) AS path, count(*) AS members FROM r GROUP BY 1)) a JOIN (SELECT *, {by_type(SMALL='5', MEDIUM='1', LARGE='1', ECONOMY='2', PROMO='4', STANDARD='3')} AS n2 FROM (SELECT p_type, min(path) AS path, count(*) AS members FROM r GROUP BY 1)) b
 ON a.path < b.path AND least(n1, n2) / greatest(n1, n2) >= 0.4""")
def pair_notes_and_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and risks of all pairs of kinds in the size band; ambient differences, which are a pair's own, are left out of the comparison."""
    rows = kinds(spark, sf_dir).drop("scan_key")
    a, b = m.side("a"), m.side("b")
    met = pairs.band_self_join(rows.select("path", "stmt_count"), "stmt_count", a("path") < b("path")).select(a("path").alias("pa"), b("path").alias("pb"))
    every = rows.select("path", F.struct(*rows.columns).alias("f"))
    full = met.join(every.toDF("pa", "a"), "pa").join(every.toDF("pb", "b"), "pb")
    risks = F.filter(explain.risk_flags(a, b), lambda x: x != "ambient_dependency_diff")
    told = full.withColumns({"n_notes": F.size(explain.difference_notes(a, b)).cast("long"), "risks": F.array_join(risks, ","), "pairs": a("members") * b("members")})
    return told.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_notes", "risks", "pairs")
