"""Source relations: rel (path below the root), path (as shown), content, read_error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import python_files

#: Tasks that a table of sources is dealt to, for each core at least.
TASKS_PER_CORE = 4


def from_directory(spark: SparkSession, root: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """All Python files below a directory."""
    ship(spark)
    python_files.register(spark)
    return spark.read.format("python_files").option("batchBytes", batch_bytes).load(str(root))


def from_table(df: DataFrame, path: str = "path", src: str = "src") -> DataFrame:
    """Any table of paths and sources (text or bytes). Excluded directories and other suffixes do not count, as on disk."""
    ship(df.sparkSession)
    rows = df.select(F.col(path).alias("rel"), F.col(path).alias("path"), F.col(src).cast("binary").alias("content"), F.lit(None).cast("string").alias("read_error"))
    return spread(rows.where(F.col("rel").endswith(".py") & ~in_excluded_dir(F.col("rel"))))


def spread(rows: DataFrame) -> DataFrame:
    """Sources dealt over all cores. They are small next to the work on them, and files or row groups of a table may be few: without this one task
    could parse a whole table. Their number is fixed, as Spark would join small partitions again."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "rel")


def in_excluded_dir(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(x) for x in sorted(python_files.EXCLUDED_DIRS))))


def scan_key(rel: Column) -> Column:
    """Sorts like a walk that lists a directory's files before its subdirectories."""
    parts = F.split(rel, "/")
    above = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.lit(1).alias("d"), x.alias("n")))
    return F.concat(above, F.array(F.struct(F.lit(0).alias("d"), F.element_at(parts, -1).alias("n"))))
