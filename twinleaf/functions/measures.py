"""Similarity measures as columns. A function's features are read through an accessor: name -> Column.

Doubles are summed in a fixed order, so bounds hold bit by bit and scores can be compared with other engines.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Side = Callable[[str], Column]

#: Weights of the measures in the similarity and in the refactorability score, in EVIDENCE order.
SIMILARITY_WEIGHTS = (0.40, 0.20, 0.15, 0.10, 0.10, 0.05)
REFACTORABILITY_WEIGHTS = (0.35, 0.15, 0.10, 0.10, 0.20, 0.10)


def side(prefix: str) -> Side:
    return lambda name: F.col(f"{prefix}.{name}")


def total(counter: Column) -> Column:
    return F.aggregate(F.map_values(counter), F.lit(0), lambda s, x: s + x)


def _keys(a: Column, b: Column) -> Column:
    return F.array_union(F.map_keys(a), F.map_keys(b))


def _count(counter: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(counter, key), F.lit(0))


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(_keys(a, b), F.lit(0), lambda s, k: s + term(_count(a, k), _count(b, k)))


def counter_jaccard(a: Column, b: Column) -> Column:
    """Shared over joint counts of two multisets; 1 if both are empty."""
    shared, joint = _fold(a, b, F.least), _fold(a, b, F.greatest)
    return F.when(joint == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.greatest(joint, F.lit(1)))


def counter_distance(a: Column, b: Column) -> Column:
    """Sum of absolute count differences."""
    return _fold(a, b, lambda x, y: F.abs(x - y))


def key_difference(a: Column, b: Column) -> Column:
    """Number of keys that only one of two multisets has."""
    return F.size(_keys(a, b)) - F.size(F.array_intersect(F.map_keys(a), F.map_keys(b)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a word of bits for the whole row of the table at a time."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for token in b:
        hit = open_ & where.get(token, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def _lcs_ratio(a, b) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * lcs_length(list(a), list(b)) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths; 1 for two empty sequences."""
    return pd.Series([_lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def round4(x: pd.Series) -> pd.Series:
    """Python's correctly rounded round(x, 4), which Spark's decimal rounding differs from on ties."""
    return pd.Series([None if v is None or v != v else round(float(v), 4) for v in x], dtype="float64")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def signature_similarity(a: Side, b: Side) -> Column:
    most = F.greatest(a("param_count"), b("param_count"), F.lit(1))
    params = F.lit(1.0) - F.abs(a("param_count") - b("param_count")).cast("double") / most
    traits = F.lit(1.0) - F.when(a("has_yield") != b("has_yield"), 0.35).otherwise(0.0) - F.when(a("has_await") != b("has_await"), 0.25).otherwise(0.0)
    return clamp(F.lit(0.7) * params + F.lit(0.3) * traits)


def wrapper_score(a: Side, b: Side) -> Column:
    both = F.when(a("wrapper_target") == b("wrapper_target"), F.lit(0.5) + F.lit(0.35)).otherwise(0.5)
    return F.when(a("is_wrapper") & b("is_wrapper"), both).when(a("is_wrapper") | b("is_wrapper"), 0.25).otherwise(0.0)


def curry_score(a: Side, b: Side) -> Column:
    both = F.when(a("curry_depth") == b("curry_depth"), 0.8).otherwise(0.6)
    return F.when(a("returns_lambda") & b("returns_lambda"), both).when(a("returns_lambda") | b("returns_lambda"), 0.4).otherwise(0.0)


def weighted(weights: tuple[float, ...], values: list[Column]) -> Column:
    out = F.lit(weights[0]) * values[0]
    for w, v in zip(weights[1:], values[1:], strict=True):
        out = out + F.lit(w) * v
    return out


def size_ratio(a: Side, b: Side) -> Column:
    """Smaller over larger statement count; 0 for two functions without statements."""
    return F.least(a("stmt_count"), b("stmt_count")).cast("double") / F.greatest(a("stmt_count"), b("stmt_count"), F.lit(1))


def total_ratio(a: Column, b: Column) -> Column:
    """No less than the Jaccard similarity of two multisets of these totals."""
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b).cast("double") / F.greatest(a, b, F.lit(1)))
