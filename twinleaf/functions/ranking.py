"""Numbers rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """rows with their place (from 1) in the order: range-partitioned, numbered within partitions, shifted by partition counts."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # partition number, then place in the partition
    numbered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", place).persist()
    numbered = numbered.withColumn("__part", F.shiftright("__at", 33))
    counts = numbered.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")  # a row for each partition
    shifts = counts.select("__part", before.alias("__before"))
    within = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    return numbered.join(F.broadcast(shifts), "__part").withColumn(name, within + F.col("__before") + 1).drop("__at", "__part", "__before")
