"""The queries: exact groups, near pairs, abstraction candidates. One scan feeds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import explain, measures as m
from ..operators import blocks
from ..operators.parse import parse
from ..operators.plugins import BUILT_IN, Plugin, PythonPlugin, apply
from ..schema import EVIDENCE, FEATURES, OCCURRENCE


class Scan:
    """Functions and errors of a source relation, parsed once and kept for all queries.

    strict: a file that cannot be read or parsed is an error of the first query, for the first such file in scan order.
    normal: (local names, constants) that the canonical form leaves out; keep: parts it keeps (docstrings, decorators, ...).
    """

    def __init__(self, sources: DataFrame, *, top_level_only: bool = False, strict: bool = False, normal: tuple[bool, bool] = (False, False), keep: frozenset[str] = frozenset(), features: bool = True, canonical: bool = True, source: bool = False):
        self.strict, self.source = strict, source
        self.rows = parse(sources, top_level_only, features, normal if canonical else None, keep, source).persist()
        self._checked, self._kept = False, []

    def functions(self) -> DataFrame:
        return self.rows.where("error IS NULL").drop("error", "fatal")

    def errors(self) -> DataFrame:
        """scan_key, path, message of files that were skipped."""
        return self.rows.where("error IS NOT NULL AND NOT coalesce(fatal, false)").select("scan_key", "path", F.concat("path", F.lit(": "), "error").alias("message"))

    def error_messages(self, limit: int | None = None) -> list[str]:
        found = self.errors().orderBy("scan_key")
        return [r.message for r in (found if limit is None else found.limit(limit)).select("message").collect()]

    def check(self) -> None:
        if self._checked:
            return
        fatal = self.rows.where("fatal").orderBy("scan_key").limit(1).collect()
        if fatal:
            raise RuntimeError(f"{fatal[0].path}: {fatal[0].error}")
        if self.strict and (first := self.errors().orderBy("scan_key").limit(1).collect()):
            raise RuntimeError(f"Failed to parse/read {first[0].message}")
        self._checked = True

    def keep(self, rows: DataFrame) -> DataFrame:
        """rows made from the scan that several steps read, kept as long as it is."""
        self._kept.append(rows.persist())
        return self._kept[-1]

    def close(self) -> None:
        for rows in (*self._kept, self.rows):
            rows.unpersist()


def occurrence(name: str, prefix: str = "") -> F.Column:
    return F.struct(*(F.col(f"{prefix}{c}") for c in OCCURRENCE)).alias(name)


def group_sizes(scan: Scan, min_count: int = 2) -> DataFrame:
    """hash, count of canonical forms that min_count functions have at least. No member is moved."""
    if min_count < 2:
        raise ValueError("min_count must be >= 2")
    scan.check()
    hashes = scan.functions().select(F.sha2("canonical", 256).alias("hash"))
    return hashes.groupBy("hash").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)


def exact_groups(scan: Scan, min_count: int = 2, include_canonical: bool = False, shown: tuple[str, ...] = tuple(OCCURRENCE)) -> DataFrame:
    """hash, count, occurrences (by path, line, name), canonical of functions with one canonical form; largest groups first.

    shown: what an occurrence tells. A group's occurrences are one row, so what is left out is not gathered.
    """
    often = group_sizes(scan, min_count)  # only hashes that repeat have their members gathered
    first = ("path", "lineno", "qualname")
    member = F.struct(*first, *(c for c in shown if c not in first))
    rows = scan.functions().select(F.sha2("canonical", 256).alias("hash"), member.alias("o"), *(["canonical"] if include_canonical else []))
    text = F.first("canonical") if include_canonical else F.lit(None).cast("string")
    members = rows.join(often, "hash").groupBy("hash", "count").agg(F.array_sort(F.collect_list("o")).alias("m"), text.alias("canonical"))
    told = F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in shown)))
    return members.select("hash", "count", told.alias("occurrences"), "canonical").orderBy(F.desc("count"), "hash")


def scored_pairs(functions: DataFrame, threshold: float, only: F.Column | None = None) -> DataFrame:
    """a, b, the six measures and `similarity` (not rounded) of pairs that reach the threshold; `only`: a condition on the pairs."""
    a, b = m.side("a"), m.side("b")
    met = blocks.candidates(functions, threshold)
    met = met if only is None else met.where(only)
    cheap = met.withColumns(
        {
            "shape_similarity": m.counter_jaccard(a("node_types"), b("node_types")),
            "call_similarity": m.counter_jaccard(a("call_names"), b("call_names")),
            "signature_similarity": m.signature_similarity(a, b),
            "wrapper_score": m.wrapper_score(a, b),
            "curry_score": m.curry_score(a, b),
        }
    )
    values = lambda stmt: [stmt if n == "stmt_similarity" else F.col(n) for n in EVIDENCE]
    # sequences are compared only where even equal ones would reach the threshold
    open_ = cheap.where(m.weighted(m.SIMILARITY_WEIGHTS, values(F.lit(1.0))) >= threshold)
    full = open_.withColumn("stmt_similarity", m.lcs_ratio(a("stmt_seq"), b("stmt_seq")))
    return full.withColumn("similarity", m.weighted(m.SIMILARITY_WEIGHTS, values(F.col("stmt_similarity")))).where(F.col("similarity") >= threshold)


#: First functions of kinds that are sent to all executors at most.
FEW_KINDS = 50_000

RANKING = (F.desc, "refactorability_score"), (F.desc, "similarity_score"), (F.asc, "a.path"), (F.asc, "a.lineno"), (F.asc, "b.path"), (F.asc, "b.lineno")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*(order(name) for order, name in RANKING))


def explained_pairs(scored: DataFrame, plugins: tuple[Plugin, ...] = BUILT_IN, also: tuple[F.Column, ...] = ()) -> DataFrame:
    """Result rows of scored pairs, unordered, with `plugin_errors`; `also`: more columns of a and b."""
    a, b, e = m.side("a"), m.side("b"), lambda n: F.col(n)
    evidence = F.struct(*EVIDENCE)
    said = apply(scored, plugins, a, b, e, evidence)
    joined = said.withColumns(
        {
            "labels": F.array_distinct(F.concat(explain.pattern_labels(a, b, e), "p_labels")),
            "risks": F.array_distinct(F.concat(explain.risk_flags(a, b), "p_risks")),
            "differences": F.array_distinct(F.concat(explain.difference_notes(a, b), "p_differences")),
            "summary": explain.shared_summary(a, b),
        }
    )
    labels, risks = F.col("labels"), F.col("risks")
    score = m.clamp(explain.refactorability(labels, risks, e) + F.col("p_delta"))
    own = lambda x: F.when(F.col(x) != "", F.col(x))  # noqa: E731  an empty text says nothing
    return joined.select(
        m.round4(F.col("similarity")).alias("similarity_score"),
        m.round4(score).alias("refactorability_score"),
        labels.alias("pattern_labels"),
        F.col("summary").alias("shared_structure_summary"),
        F.col("differences").alias("key_differences"),
        risks.alias("risk_flags"),
        F.coalesce(own("p_suggestion"), explain.suggestion(labels, risks, e)).alias("suggested_refactor_kind"),
        occurrence("a", "a."),
        occurrence("b", "b."),
        evidence.alias("evidence"),
        F.coalesce(own("p_template"), explain.template(a, b, labels, F.col("summary"))).alias("abstract_template"),
        F.struct(m.round4(m.size_ratio(a, b)).alias("size_ratio"), "p_metadata.*", F.col("p_custom").alias("custom")).alias("metadata"),
        F.col("p_errors").alias("plugin_errors"),
        *also,
    )


def _near_inputs(scan: Scan, threshold: float, top_k: int | None, plugins: tuple[Plugin, ...]) -> DataFrame:
    """What near pairs are made from, after the guards."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must be >= 0")
    if any(isinstance(p, PythonPlugin) for p in plugins) and not scan.source:
        raise ValueError("Python plugins read source text: scan with source=True")
    scan.check()
    return scan.functions().select("rel", "scan_key", *OCCURRENCE, *FEATURES, *(["source"] if scan.source else []))


def near_matches(scan: Scan, threshold: float = 0.8, top_k: int | None = None, plugins: tuple[Plugin, ...] = BUILT_IN) -> DataFrame:
    """Ranked pairs of similar functions; a is scanned before b."""
    rows = ranked(explained_pairs(scored_pairs(_near_inputs(scan, threshold, top_k, plugins), threshold), plugins))
    return rows if top_k is None else rows.limit(top_k)


def kind_of() -> F.Column:
    """Equal for functions that every similarity measure takes for the same."""
    entries = lambda c: F.array_sort(F.map_entries(c))
    read = ("stmt_seq", "param_count", "has_yield", "has_await", "is_wrapper", "wrapper_target", "returns_lambda", "curry_depth")
    return F.sha2(F.to_json(F.struct(entries("node_types").alias("n"), entries("call_names").alias("c"), *read)), 256)


def with_kinds(functions: DataFrame) -> DataFrame:
    return functions.withColumn("alike", kind_of())


def kind_members(keyed: DataFrame) -> DataFrame:
    """The first two functions of each kind in scan order, with `place` (1, 2) and `members`, the kind's size.

    A task keeps two functions of a kind before any is moved, so no task reads a kind.
    """
    place = F.dense_rank().over(Window.partitionBy("alike").orderBy("scan_key", "lineno"))
    two = keyed.withColumn("place", place).where("place <= 2").dropDuplicates(["alike", "place"])
    sizes = keyed.groupBy("alike").agg(F.count("*").alias("members"))
    return two.join(sizes, "alike").select(*keyed.columns, "members", "place")


def _kind_pairs(members: DataFrame, threshold: float) -> tuple[DataFrame, F.Column]:
    """(scored pairs of kinds' first functions, and of each kind's first two; how many pairs of functions each stands for)."""
    same = F.col("a.alike") == F.col("b.alike")
    scored = scored_pairs(members, threshold, same | ((F.col("a.place") == 1) & (F.col("b.place") == 1)))
    n, k = F.col("a.members"), F.col("b.members")
    return scored, F.when(same, (n * (n - 1) / 2).cast("long")).otherwise(n * k).alias("links")


def near_kinds(scan: Scan, threshold: float = 0.8, top_k: int | None = None, plugins: tuple[Plugin, ...] = BUILT_IN) -> DataFrame:
    """near_matches() of one pair for each two similar kinds of functions (or one kind of several), with `links`: the pairs of functions it stands for.

    All functions of a kind are equally similar to those of another, so no similar pair is left out, and none is expanded; what is
    explained is the pair's own. near_members() says what kind each function is of.
    """
    scored, links = _kind_pairs(scan.keep(kind_members(with_kinds(_near_inputs(scan, threshold, top_k, plugins)))), threshold)
    rows = ranked(explained_pairs(scored, plugins, (links,)))
    return rows if top_k is None else rows.limit(top_k)


def near_members(scan: Scan, threshold: float = 0.8) -> DataFrame:
    """Every function: its occurrence's columns, `like` (the first function of its kind in scan order) and `links`, how many functions are similar to it."""
    keyed = with_kinds(_near_inputs(scan, threshold, None, ()))
    members = scan.keep(kind_members(keyed))
    scored, _ = _kind_pairs(members, threshold)
    ends = scored.select(F.col("a.alike").alias("x"), F.col("b.alike").alias("y"), F.col("a.members").alias("n"), F.col("b.members").alias("k"))
    each = ends.select(F.col("x").alias("alike"), F.when(F.col("x") == F.col("y"), F.col("k") - 1).otherwise(F.col("k")).alias("l"))
    each = each.union(ends.where("x <> y").select(F.col("y").alias("alike"), F.col("n").alias("l")))
    links = each.groupBy("alike").agg(F.sum("l").alias("links"))
    heads = members.where("place = 1").select("alike", F.struct("path", "lineno", "qualname").alias("first"))
    named = heads.join(links, "alike", "left").select("alike", "first", F.coalesce("links", F.lit(0)).alias("links"))
    named = F.broadcast(named) if members.count() <= FEW_KINDS else named  # else a kind's functions would meet in one task
    return keyed.select(*OCCURRENCE, "alike").join(named, "alike").select(*OCCURRENCE, F.col("first").alias("like"), "links")


def worth_merging(near: DataFrame) -> DataFrame:
    return near.where("suggested_refactor_kind <> 'leave_separate'")


def abstract_candidates(scan: Scan, threshold: float = 0.82, top_k: int | None = None, plugins: tuple[Plugin, ...] = BUILT_IN) -> DataFrame:
    """Near pairs worth merging. top_k applies before the choice, so fewer rows may come."""
    return worth_merging(near_matches(scan, threshold, top_k, plugins))


def plugin_errors(near: DataFrame) -> DataFrame:
    """Distinct messages, in order of the first pair that raised one."""
    one = near.select(F.explode("plugin_errors").alias("message"), F.struct("a.path", "a.lineno", "b.path", "b.lineno").alias("at"))
    return one.groupBy("message").agg(F.min("at").alias("at")).orderBy("at", "message").select("message")
