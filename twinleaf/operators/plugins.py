"""Pair plugins: column plugins run inside the plan, Python plugins in one Arrow UDF each, isolated from each other.

A registry is an ordinary list that is passed to the query; its order decides whose suggestion and template win.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import explain, measures as m
from ..functions.measures import Side


@dataclass(frozen=True)
class Finding:
    """What a column plugin says where it fires. metadata: name -> column."""

    fires: Column
    labels: Column | None = None
    differences: Column | None = None
    risks: Column | None = None
    suggestion: str | None = None
    delta: Column | float = 0.0
    template: Column | None = None
    metadata: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnPlugin:
    name: str
    finding: Callable[[Side, Side, Side], Finding]


@dataclass(frozen=True)
class PythonPlugin:
    """analyze(a, b, evidence) gets two feature rows with their `source`, and the measures, as dicts.

    It returns None or a dict of any of: labels, differences, risks (lists), suggestion, template (texts), delta (float), metadata (dict).
    """

    name: str
    analyze: Callable[[dict, dict, dict], dict | None]


Plugin = ColumnPlugin | PythonPlugin


def texts(*items: str) -> Column:
    return F.array(*(F.lit(x) for x in items))


def _both(a: Side, b: Side, *names: str) -> dict[str, Column]:
    return {f"{s}_{n}": side(n) for n in names for s, side in (("a", a), ("b", b))}


def _wrapper(a: Side, b: Side, e: Side) -> Finding:
    return Finding(
        e("wrapper_score") >= 0.5,
        texts("wrapper"),
        explain.chosen((explain.differs(a, b, "wrapper_target"), "wrapper targets differ")),
        suggestion="merge_into_single_function_with_param",
        delta=0.05,
        metadata=_both(a, b, "wrapper_target", "fixed_args"),
    )


def _currying(a: Side, b: Side, e: Side) -> Finding:
    return Finding(e("curry_score") >= 0.4, texts("partial_application"), suggestion="introduce_partial", delta=0.04, metadata=_both(a, b, "returns_lambda", "curry_depth"))


def _side_effects(a: Side, b: Side, e: Side) -> Finding:
    calls = F.array_sort(F.array_union(a("side_effect_calls"), b("side_effect_calls")))
    return Finding(F.size(calls) > 0, risks=texts("possible_side_effects"), delta=-0.05, metadata={"calls": calls})


#: Feature, risk, note, cost.
BOUNDARIES = (
    ("has_await", "async_boundary_diff", "async behavior differs", 0.08),
    ("has_yield", "return_shape_diff", "generator behavior differs", 0.08),
    ("raises", "exception_behavior_diff", "exception behavior differs", 0.05),
)


def _async_boundary(a: Side, b: Side, e: Side) -> Finding:
    differs = {name: explain.differs(a, b, name) for name, *_ in BOUNDARIES}
    cost = F.lit(0.0)
    for name, _, _, price in BOUNDARIES:
        cost = cost - F.when(differs[name], price).otherwise(0.0)
    return Finding(
        differs["has_await"] | differs["has_yield"] | differs["raises"],
        differences=explain.chosen(*((differs[n], note) for n, _, note, _ in BOUNDARIES)),
        risks=explain.chosen(*((differs[n], risk) for n, risk, _, _ in BOUNDARIES)),
        delta=cost,
        metadata=_both(a, b, "has_await", "has_yield", "raises"),
    )


def _literal_specialization(a: Side, b: Side, e: Side) -> Finding:
    return Finding(
        explain.literal_variation(a, b, e),
        texts("literal_specialization"),
        suggestion="parameterize_constant",
        delta=0.03,
        template=F.lit("def shared_helper(..., configurable_value):\n    # parameterize constant-like variation\n    ..."),
        metadata=_both(a, b, "literals") | {"literal_token_diff": m.counter_distance(a("literal_tokens"), b("literal_tokens"))},
    )


def _extract_helper(a: Side, b: Side, e: Side) -> Finding:
    names = F.concat(F.lit("def shared_helper(...):\n    # candidate abstraction for "), a("qualname"), F.lit(" and "), b("qualname"), F.lit("\n    ..."))
    return Finding(explain.same_structure(e), texts("extract_helper_candidate"), suggestion="extract_common_helper", delta=0.05, template=names, metadata={n: e(n) for n in ("shape_similarity", "stmt_similarity")})


def _dependency_divergence(a: Side, b: Side, e: Side) -> Finding:
    apart = explain.ambient_difference(a, b)
    return Finding(
        apart >= 6,
        explain.chosen(((e("signature_similarity") >= 0.8) & (e("call_similarity") < 0.5), "same_shape_different_dependencies")),
        risks=texts("ambient_dependency_diff"),
        delta=-0.06,
        metadata={"external_name_symmetric_difference": apart},
    )


BUILT_IN: tuple[Plugin, ...] = (
    ColumnPlugin("wrapper", _wrapper),
    ColumnPlugin("currying", _currying),
    ColumnPlugin("side_effects", _side_effects),
    ColumnPlugin("async_boundary", _async_boundary),
    ColumnPlugin("literal_specialization", _literal_specialization),
    ColumnPlugin("extract_helper", _extract_helper),
    ColumnPlugin("dependency_divergence", _dependency_divergence),
)


class Registry:
    """Plugins in the order they were registered; passed to a query as registry.plugins."""

    def __init__(self, plugins: tuple[Plugin, ...] = BUILT_IN):
        self.plugins = plugins

    def register(self, item):
        """For plugins, and as a decorator for a class or an instance with `name` and `analyze(a, b, evidence)`."""
        made = item() if isinstance(item, type) else item
        self.plugins = (*self.plugins, made if isinstance(made, Plugin) else PythonPlugin(made.name, made.analyze))
        return item


_OUTCOME = "struct<said:boolean,labels:array<string>,differences:array<string>,risks:array<string>,suggestion:string,delta:double,template:string,metadata:string,error:string>"


def _plain(value):
    """Arrow's pandas values as Python's."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return dict(value) if value and all(isinstance(x, tuple) and len(x) == 2 for x in value) else [_plain(x) for x in value]
    return value


def _outcome(name: str, analyze, a: dict, b: dict, evidence: dict) -> dict:
    empty = dict.fromkeys(("labels", "differences", "risks", "suggestion", "delta", "template", "metadata", "error")) | {"said": False}
    try:
        got = analyze(a, b, evidence)
        if got is None:
            return empty
        return empty | {
            "said": True,
            "labels": list(got.get("labels") or []),
            "differences": list(got.get("differences") or []),
            "risks": list(got.get("risks") or []),
            "suggestion": got.get("suggestion"),
            "delta": float(got.get("delta") or 0.0),
            "template": got.get("template"),
            "metadata": json.dumps(got.get("metadata") or {}),
        }
    except Exception as error:  # one plugin's failure is reported and leaves the others alone
        return empty | {"error": f"{name}: {type(error).__name__}: {error}"}


def python_outcome(plugin: PythonPlugin) -> Callable[..., Column]:
    name, analyze = plugin.name, plugin.analyze

    @F.pandas_udf(_OUTCOME)
    def run(a: pd.DataFrame, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        sides = [[{k: _plain(v) for k, v in row.items()} for row in x.to_dict("records")] for x in (a, b, e)]
        return pd.DataFrame([_outcome(name, analyze, *row) for row in zip(*sides, strict=True)], columns=["said", "labels", "differences", "risks", "suggestion", "delta", "template", "metadata", "error"])

    return run


def apply(rows: DataFrame, plugins: tuple[Plugin, ...], a: Side, b: Side, e: Side, evidence: Column) -> DataFrame:
    """Appends what all plugins say together: p_labels, p_differences, p_risks, p_delta, p_suggestion, p_template, p_metadata, p_custom, p_errors."""
    python = [p for p in plugins if isinstance(p, PythonPlugin)]
    for p in python:
        rows = rows.withColumn(f"py_{p.name}", python_outcome(p)(F.col("a"), F.col("b"), evidence))
    none = F.array().cast("array<string>")
    labels, differences, risks, suggestions, templates, errors = [none], [none], [none], [], [], [none]
    delta, metadata, custom = F.lit(0.0), [], []
    for p in plugins:
        if isinstance(p, PythonPlugin):
            got = lambda n, p=p: F.col(f"py_{p.name}.{n}")
            for into, name in ((labels, "labels"), (differences, "differences"), (risks, "risks")):
                into.append(F.coalesce(got(name), none))
            suggestions.append(got("suggestion"))
            templates.append(got("template"))
            delta = delta + F.coalesce(got("delta"), F.lit(0.0))
            custom.append(F.when(got("said"), F.struct(F.lit(p.name).alias("key"), got("metadata").alias("value"))))
            errors.append(F.array_compact(F.array(got("error"))))
            continue
        found = p.finding(a, b, e)
        for into, said in ((labels, found.labels), (differences, found.differences), (risks, found.risks)):
            if said is not None:
                into.append(F.when(found.fires, said).otherwise(none))
        if found.suggestion is not None:
            suggestions.append(F.when(found.fires, found.suggestion))
        if found.template is not None:
            templates.append(F.when(found.fires, found.template))
        delta = delta + F.when(found.fires, found.delta).otherwise(0.0)
        metadata.append(F.when(found.fires, F.struct(*(c.alias(n) for n, c in found.metadata.items()))).alias(p.name))
    text = F.lit(None).cast("string")
    joined = F.map_from_entries(F.array_compact(F.array(*custom))) if custom else F.create_map().cast("map<string,string>")
    return rows.withColumns(
        {
            "p_labels": F.array_distinct(F.concat(*labels)),
            "p_differences": F.array_distinct(F.concat(*differences)),
            "p_risks": F.array_distinct(F.concat(*risks)),
            "p_delta": delta,
            "p_suggestion": F.coalesce(*suggestions, text),
            "p_template": F.coalesce(*templates, text),
            "p_metadata": F.struct(*metadata) if metadata else F.struct(F.lit(None).cast("string").alias("none")),
            "p_custom": joined,
            "p_errors": F.concat(*errors),
        }
    )
