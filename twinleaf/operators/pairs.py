"""The band of sizes as a native join, for few rows (kinds of functions); blocks.py pairs many.

The statement-count band (smaller over larger at least 0.4) is an equality join: in buckets of a factor 2.5 two counts of the band are
at most one bucket apart. A condition on the pair is part of the join's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m

BAND = 0.4


def band_bucket(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1 / BAND)) + 1e-9)


def band_self_join(rows: DataFrame, size: str, condition: Column, parts: int = 1) -> DataFrame:
    """Pairs (a, b structs) of rows whose sizes are in the band and that meet the condition on a and b."""
    whole = rows.select(F.struct(*rows.columns).alias("x"), band_bucket(F.col(size)).alias("bucket"))
    left = whole.select(F.col("x").alias("a"), "bucket", F.pmod(F.xxhash64("x"), F.lit(parts)).alias("part"))
    right = whole.select(F.col("x").alias("b"), F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("bucket"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    fits = m.side("a"), m.side("b")
    in_band = F.least(*(s(size) for s in fits)) >= F.lit(BAND) * F.greatest(*(s(size) for s in fits), F.lit(1))
    return left.join(right, ["bucket", "part"]).where(in_band & condition).select("a", "b")
