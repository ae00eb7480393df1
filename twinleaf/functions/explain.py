"""What is said about a pair: risks, labels, notes, summary, suggestion, template, scores. All columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EVIDENCE
from . import measures as m
from .measures import Side

Evidence = Side


def chosen(*items: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in items)))


def differs(a: Side, b: Side, name: str) -> Column:
    return ~a(name).eqNullSafe(b(name))


def ambient_difference(a: Side, b: Side) -> Column:
    return m.key_difference(a("external_names"), b("external_names"))


def literal_variation(a: Side, b: Side, e: Evidence) -> Column:
    few = F.abs(a("literals") - b("literals")) <= 2
    return (m.counter_distance(a("literal_tokens"), b("literal_tokens")) > 0) & few & (e("shape_similarity") >= 0.85) & (e("call_similarity") >= 0.6)


def same_structure(e: Evidence) -> Column:
    return (e("shape_similarity") >= 0.8) & (e("stmt_similarity") >= 0.8)


def difference_notes(a: Side, b: Side) -> Column:
    return chosen(
        (differs(a, b, "param_count"), F.format_string("parameter count differs (%d vs %d)", a("param_count"), b("param_count"))),
        (differs(a, b, "has_await"), "async behavior differs"),
        (differs(a, b, "has_yield"), "generator behavior differs"),
        (differs(a, b, "raises"), "exception behavior differs"),
        (differs(a, b, "wrapper_target") & (a("is_wrapper") | b("is_wrapper")), "wrapper targets differ"),
        (F.abs(a("literals") - b("literals")) >= 2, "literal density differs"),
        (F.abs(a("control_count") - b("control_count")) >= 2, "control-flow complexity differs"),
    )


def risk_flags(a: Side, b: Side) -> Column:
    """In alphabetical order."""
    return chosen(
        (ambient_difference(a, b) >= 6, "ambient_dependency_diff"),
        (differs(a, b, "has_await"), "async_boundary_diff"),
        (differs(a, b, "raises"), "exception_behavior_diff"),
        ((F.size(a("side_effect_calls")) > 0) | (F.size(b("side_effect_calls")) > 0), "possible_side_effects"),
        (differs(a, b, "has_yield"), "return_shape_diff"),
    )


def pattern_labels(a: Side, b: Side, e: Evidence) -> Column:
    return chosen(
        (e("wrapper_score") >= 0.5, "wrapper"),
        (e("curry_score") >= 0.4, "partial_application"),
        ((e("shape_similarity") >= 0.9) & (e("call_similarity") >= 0.85), "renamed_locals"),
        (literal_variation(a, b, e), "literal_specialization"),
        (same_structure(e), "extract_helper_candidate"),
        ((e("signature_similarity") >= 0.8) & (F.abs(a("param_count") - b("param_count")) <= 1) & (e("call_similarity") < 0.5), "same_shape_different_dependencies"),
    )


def shared_summary(a: Side, b: Side) -> Column:
    statements = F.array_sort(F.array_intersect(a("stmt_seq"), b("stmt_seq")))
    calls = F.array_sort(F.array_intersect(F.map_keys(a("call_names")), F.map_keys(b("call_names"))))
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.slice(items, 1, 6), ", ")))
    text = F.concat_ws("; ", listed("shared statements: ", statements), listed("shared calls: ", calls))
    return F.when(text == "", F.lit("shared AST shape without strong call overlap")).otherwise(text)


def suggestion(labels: Column, risks: Column, e: Evidence) -> Column:
    """By rule, where no plugin suggests anything."""
    has = F.array_contains
    apart = F.arrays_overlap(risks, F.array(F.lit("ambient_dependency_diff"), F.lit("async_boundary_diff"), F.lit("return_shape_diff")))
    return (
        F.when(has(labels, "wrapper") & (e("wrapper_score") >= 0.5), "merge_into_single_function_with_param")
        .when(has(labels, "partial_application"), "introduce_partial")
        .when(has(labels, "extract_helper_candidate") & ~has(risks, "possible_side_effects"), "extract_common_helper")
        .when(has(labels, "literal_specialization"), "parameterize_constant")
        .when(apart, "leave_separate")
        .otherwise("move_to_utils")
    )


def refactorability(labels: Column, risks: Column, e: Evidence) -> Column:
    score = m.weighted(m.REFACTORABILITY_WEIGHTS, [e(n) for n in EVIDENCE])
    score = score + F.when(F.array_contains(labels, "extract_helper_candidate"), 0.08).otherwise(0.0)
    score = score + F.when(F.array_contains(labels, "literal_specialization"), 0.05).otherwise(0.0)
    return m.clamp(score - F.lit(0.1) * F.size(risks))


def template(a: Side, b: Side, labels: Column, summary: Column) -> Column:
    wanted = F.arrays_overlap(labels, F.array(F.lit("extract_helper_candidate"), F.lit("literal_specialization"), F.lit("wrapper")))
    return F.when(wanted, F.concat(F.lit("def shared_helper(...):\n    # candidate abstraction for "), a("qualname"), F.lit(" and "), b("qualname"), F.lit("\n    # "), summary, F.lit("\n    ...")))
