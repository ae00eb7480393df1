"""Session helpers: shared folders, materialised tables, split keys and Arrow adapters."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship as ship_package

#: Rows of an Arrow batch. Documents are long, and a batch stands in the JVM and in Python at once; Spark's default is 10000.
BATCH_ROWS = 1024
#: Rows that the JVM decodes from Parquet at a time. It does so into arrays that hold all their texts and are doubled as they fill; Spark's default
#: is 4096, and arrays of so many documents are what an executor's heap grows by.
READ_ROWS = 512

#: What a worker keeps from task to task of one operator, and the module of the operator it works for.
_worker_caches: list[dict] = []
_operator = ""


def ship(spark: SparkSession) -> None:
    """The package on all workers, and batches of bounded size in Arrow and from Parquet unless the session sets its own."""
    ship_package(spark)
    for name, usual, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10000, BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", 4096, READ_ROWS)):
        if int(spark.conf.get(name)) == usual:
            spark.conf.set(name, str(rows))


def operator_cache(cache: dict) -> dict:
    """cache, which a worker empties when it goes over to another operator; what is missing there has to be made again."""
    _worker_caches.append(cache)
    return cache


def _give_back() -> None:
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(fn):
    """For generators that run in Python workers: memory that a task has freed goes back to the system when it ends.

    Workers live on between stages, and what they keep adds up beside the executor's heap. So the first task of another operator also drops
    what the worker kept for the one before, such as tokenizers.
    """

    @functools.wraps(fn)
    def run(*args, **kwargs):
        global _operator
        if _operator != fn.__module__:
            _operator = fn.__module__
            for cache in _worker_caches:
                cache.clear()
            _give_back()
        try:
            yield from fn(*args, **kwargs)
        finally:
            _give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="twinleaf-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders of materialised tables, for those that are still referred to.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back.

    Later stages read files that outlive any executor, so a lost executor costs only its running tasks.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    ship(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing will read again: all that was made from them is written already."""
    for df in tables:
        path = None if df is None else _folders.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def kept(view: DataFrame, table: DataFrame) -> DataFrame:
    """view, to be discarded instead of the materialised table that it reads."""
    if table in _folders:
        _folders[view] = _folders.pop(table)
    return view


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished queries now: it does so when the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def split_key(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(fields: list[StructField], before: str = "", after: str = "") -> StructType:
    """Schema of fields under the names c0, c1, ... with those of two DDL texts around them. Types are taken as they are, whatever their names."""
    own = [StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]
    head, tail = (StructType.fromDDL(x).fields if x else [] for x in (before, after))
    return StructType([*head, *own, *tail])


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows_allowed: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most about `bound` labelled texts, spread by a hash of the id, in an order fixed by that hash.

    Only the labels are thinned before the join, so the broadcast side holds at most about `bound` rows
    and the texts are filtered where they are read. Null labels are left out; of several labels of one id the largest counts.
    """
    seen = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(target).alias("__y")).where(rows_allowed)
    total = seen.count()
    if total > bound:
        seen = seen.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < F.lit(int((1 << 20) * bound / total)))
    joined = docs.select(F.col(id_col), F.col(text_col).alias("__t")).join(F.broadcast(seen), id_col)
    got = joined.select(F.xxhash64(F.col(id_col)).alias("k"), F.coalesce("__t", F.lit("")).alias("t"), F.col("__y").cast("int").alias("y")).toArrow()
    rows = sorted(zip(got["k"].to_pylist(), got["t"].to_pylist(), got["y"].to_pylist(), strict=True))
    return [(t, int(y)) for _, t, y in rows]
