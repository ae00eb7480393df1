"""Corpora that the queries derive from the tables: generated Python sources, event sequences as functions, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.tables import from_table

#: Python sources by part type; %k is the part's key, %n its size, %l a name made from its brand.
TEMPLATES = {
    "SMALL": "def total_%k(values):\n    %l = 0\n    for item in values:\n        if item > %n:\n            %l += item\n    return %l\n",
    "MEDIUM": "def wrap_%k(%l):\n    return normalize(%l, %n)\n",
    "LARGE": "def make_%k(%l):\n    return lambda text: (%l, text, %n)\n",
    "ECONOMY": "async def fetch_%k(%l):\n    resp = await client.get(%l, %n)\n    return resp\n",
    "PROMO": "def gen_%k(values):\n    for %l in values:\n        if %l % %n == 0:\n            yield %l\n",
    "STANDARD": "def save_%k(rows, path):\n    with open(path, 'w') as fh:\n        for %l in rows:\n            fh.write(str(%l + %n))\n",
}
BROKEN_SIZE = 50
BROKEN = "def broken(:\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_name() -> Column:
    return F.lower(F.regexp_replace("p_brand", "#", "_"))


def source_text() -> Column:
    filled = None
    for kind, text in TEMPLATES.items():
        body = F.lit(text)
        for mark, value in (("%k", F.col("p_partkey").cast("string")), ("%n", F.col("p_size").cast("string")), ("%l", local_name())):
            body = F.replace(body, F.lit(mark), value)
        filled = F.when(F.col("p_type") == kind, body) if filled is None else filled.when(F.col("p_type") == kind, body)
    return F.when(F.col("p_size") == BROKEN_SIZE, F.lit(BROKEN)).otherwise(filled)


def generated(parts: DataFrame, path: Column | None = None, src: Column | None = None) -> DataFrame:
    """Sources, one file with one function for each part."""
    where = F.concat(F.lit("pkg/"), local_name(), F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return from_table(parts.select((where if path is None else path).alias("path"), (source_text() if src is None else src).alias("src")))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function row for each user of events: statements are event types in order of time; counters count event types."""
    events = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id", "event_type")
    users = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.event_type).alias("stmt_seq"))
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("c"))
    zero, no = F.lit(0), F.lit(False)
    key = F.lpad(F.col("user_id").cast("string"), 12, "0")
    return users.join(maps, "user_id").select(
        F.col("user_id"),
        key.alias("rel"),
        F.array(F.struct(F.lit(0).alias("d"), key.alias("n"))).alias("scan_key"),
        F.lit(1).alias("lineno"),
        "stmt_seq",
        F.size("stmt_seq").alias("stmt_count"),
        F.col("c").alias("node_types"),
        F.col("c").alias("call_names"),
        F.size("c").alias("param_count"),
        no.alias("has_yield"),
        no.alias("has_await"),
        no.alias("is_wrapper"),
        F.lit(None).cast("string").alias("wrapper_target"),
        no.alias("returns_lambda"),
        zero.alias("curry_depth"),
    )
