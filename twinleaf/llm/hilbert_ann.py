"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Equal vectors are first collapsed to classes that carry their smallest ids, so a vector in a third of all rows is one point. Each of
several curves projects the points at random, shifts them, and orders them by Hilbert key; Spark range-partitions that order and
numbers it. A query meets every point in its window of the order, on each curve; the windows' best are merged and reranked on the
original vectors in double precision.

Every point is indexed. The window is the smallest power of two whose recall of exact neighbours, measured for a bounded sample of
queries against all points, reaches `recall`; on points without any structure it has to grow with them.

Inner products are searched as angles: points get one more component that makes all norms equal, queries get 0 there.

Edge cases: vectors that are null, zero, or hold null or non-finite components, or whose length is not the commonest, take no part;
repeated ids count once for each row; equal scores go to the smaller id; fewer candidates than k give all; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, materialise, parallelism, ship

DIM, BITS = 8, 8
CURVES = 16
SMALLEST = 256
SAMPLE = 48


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (rows, each below 2**bits) on the Hilbert curve, as unsigned 64-bit numbers.

    Works on the transposed index: undo the excess exchanges and inversions from the top bit down, Gray-encode, interleave.
    """
    x = grid.T.astype(np.uint64).copy()
    n_dim, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(n_dim):
            high = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n_dim):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n_dim):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


class Curves:
    """Projections, shifts and scales of all curves; fitted on a bounded sample of points."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.top = 0.0
        self.projections = rng.normal(size=(curves, sample.shape[1] + 1, DIM))
        spread = np.abs(np.pad(sample, ((0, 0), (0, 1))) @ self.projections)
        self.half = np.maximum(np.quantile(spread, 0.995, axis=1), 1e-12)  # curves, dimensions
        self.shift = rng.uniform(0, 2, size=self.half.shape)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """Keys as signed numbers of the same order: curves, points."""
        out = np.empty((len(self.projections), len(points)), np.int64)
        for c, projection in enumerate(self.projections):
            unit = ((points @ projection) / self.half[c] + 1 + self.shift[c]) / 4
            grid = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            out[c] = (hilbert_keys(grid, BITS) ^ np.uint64(1 << 63)).view(np.int64)
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@frugal
def _smallest_ids(batches: Iterator[pa.RecordBatch], keep: int, dim: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct vector of the task: the smallest ids, and whether any is a query."""
    held: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        rows = list(held.items())
        flat = np.frombuffer(b"".join(k for k, _ in rows), "<f8").reshape(len(rows), dim)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([vectors, pa.array([sorted(-x for x in v[0]) for _, v in rows], pa.list_(pa.int64())), pa.array([v[1] for _, v in rows])], ["vector", "ids", "asked"])

    for batch in batches:
        if not batch.num_rows:
            continue
        points = matrix(batch.column(0), dim) + 0.0  # -0.0 becomes 0.0
        for i, (key, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            own = held.setdefault(points[i].astype("<f8").tobytes(), [[], False])
            if len(own[0]) < keep:
                heapq.heappush(own[0], -key)
            else:
                heapq.heappushpop(own[0], -key)
            own[1] |= asked
        if len(held) >= 1 << 15:
            yield out()
            held = {}
    if held:
        yield out()


@frugal
def _keys(batches: Iterator[pa.RecordBatch], curves, dim: int) -> Iterator[pa.RecordBatch]:
    """An item for each point and curve, and another where the point is a query."""
    model = curves.value
    for batch in batches:
        if not batch.num_rows:
            continue
        points, cls, asked = matrix(batch.column(1), dim), batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        norm = np.sqrt((points**2).sum(axis=1))
        rest = np.sqrt(np.maximum(model.top**2 - norm**2, 0))
        sides = [(np.column_stack([points, rest]), cls, False), (np.column_stack([points * (model.top / norm)[:, None], np.zeros(len(points))])[asked], cls[asked], True)]
        for side, own, query in sides:
            keys = model.keys(side)
            n = len(own)
            curve = np.repeat(np.arange(len(keys)), n)
            yield pa.RecordBatch.from_arrays([pa.array(curve, pa.int32()), pa.array(keys.ravel()), pa.array(np.tile(own, len(keys))), pa.array(np.full(len(curve), query))], ["curve", "key", "cls", "query"])


@frugal
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        curve = batch.column("curve").to_numpy()
        place = np.empty(len(curve), np.int64)
        for c in np.unique(curve):
            rows = np.flatnonzero(curve == c)
            place[rows] = np.arange(len(rows)) + seen.get(int(c), 0)
            seen[int(c)] = seen.get(int(c), 0) + len(rows)
        yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("cls"), batch.column("query"), pa.array(np.full(len(curve), part), pa.int32()), pa.array(place)], ["curve", "cls", "query", "part", "place"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best points. Scores are summed alike whatever the block.

    What a matrix product cannot tell from the k-th best is scored exactly, however many points that are.
    """
    lengths = np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((points * points).sum(axis=1).max(initial=0))
    # twice the error bound of an inner product, of both the edge and the point
    slack = 8 * queries.shape[1] * np.finfo(np.float64).eps * lengths
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ points.T
        for i, row in enumerate(rough):
            edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            some = np.flatnonzero(row >= edge - slack[a + i])
            exact = (points[some] * queries[a + i]).sum(axis=1)
            order = best(exact, ids[some], k)
            yield ids[some][order], exact[order]


@frugal
def _search(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by curve, block and role; blocks have at most a window of points and three of queries."""
    now, points, ids, queries, asked = None, [], [], [], []

    def out() -> pa.RecordBatch | None:
        if not points or not queries:
            return None
        own = np.concatenate(ids)
        got = list(nearest(np.concatenate(queries), np.concatenate(points), own, k))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked)), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array([s for _, s in got], pa.list_(pa.float64()))], ["cls", "found", "scores"])

    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, cls, role = matrix(batch.column("vector"), dim), batch.column("cls").to_numpy(), batch.column("role").to_numpy()
        where = batch.column("curve").to_numpy().astype(np.int64) << 40 | batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if where[a] != now:
                if (done := out()) is not None:
                    yield done
                now, points, ids, queries, asked = where[a], [], [], [], []
            p, q = a + np.flatnonzero(role[a:b] == 0), a + np.flatnonzero(role[a:b] == 1)
            if len(p):
                points.append(vectors[p])
                ids.append(cls[p])
            if len(q):
                queries.append(vectors[q])
                asked.append(cls[q])
    if (done := out()) is not None:
        yield done


@frugal
def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by query; the k best of all its windows."""
    now, found = None, {}

    def out() -> pa.RecordBatch:
        ids, scores = np.array(list(found), np.int64), np.array(list(found.values()))
        order = best(scores, ids, k)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), now)), pa.array(ids[order]), pa.array(scores[order])], ["cls", "near", "score"])

    for batch in batches:
        for cls, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cls != now:
                if found:
                    yield out()
                now, found = cls, {}
            found.update(zip(ids, scores, strict=True))
    if found:
        yield out()


@frugal
def _exact(batches: Iterator[pa.RecordBatch], queries, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Best points of this task for a broadcast sample of queries."""
    ids, points = queries.value
    held = {int(i): (np.zeros(0, np.int64), np.zeros(0)) for i in ids}
    for batch in batches:
        if not batch.num_rows:
            continue
        got = nearest(points, matrix(batch.column(1), dim), batch.column(0).to_numpy(), k)
        for i, (found, scores) in zip(ids, got, strict=True):
            all_ids, all_scores = np.concatenate([held[int(i)][0], found]), np.concatenate([held[int(i)][1], scores])
            order = best(all_scores, all_ids, k)
            held[int(i)] = (all_ids[order], all_scores[order])
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x for x, _ in held.values()], pa.list_(pa.int64())), pa.array([s for _, s in held.values()], pa.list_(pa.float64()))], ["cls", "found", "scores"])


class Index:
    """Classes of equal vectors, and their places on every curve."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, asked: Column, k: int, curves: int = CURVES):
        spark = self.spark = rows.sparkSession
        ship(spark)
        self.k, self.parts = k, parallelism(spark)
        vector = F.col("vector")
        clean = rows.select(F.col(vector_col).cast("array<double>").alias("vector"), F.col(id_col).cast("long").alias("id"), asked.alias("asked"))
        ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
        clean = clean.where(ok & F.col("id").isNotNull())
        sizes = clean.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
        self.dim = sizes[0].d if sizes else 1
        self.rows = clean.where(F.size("vector") == self.dim)
        one = self.rows.select("vector", "id", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(partial(_smallest_ids, keep=k + 1, dim=self.dim), "vector array<double>, ids array<long>, asked boolean")
        low = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
        # lists of at most k + 1 ids a task, first within 64 salts
        two = one.groupBy("vector", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(low("ids").alias("ids"), F.max("asked").alias("asked"))
        classes = two.groupBy("vector").agg(low("ids").alias("ids"), F.max("asked").alias("asked"))
        self.classes = materialise(classes.select(F.col("ids")[0].alias("cls"), "vector", "ids", "asked"), "vectors")
        self.total = self.classes.count()
        self.places = None
        if self.total:
            self._order(curves)

    def _order(self, curves: int) -> None:
        share = min(1.0, 2000 / self.total)
        some = (self.classes if share == 1 else self.classes.sample(share, seed=5)).select("vector").limit(4000).toArrow()["vector"].combine_chunks()
        points = matrix(some if len(some) else self.classes.limit(1).select("vector").toArrow()["vector"].combine_chunks(), self.dim)
        model = Curves(points, curves)
        model.top = self.classes.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first().m
        shared = self.spark.sparkContext.broadcast(model)
        items = self.classes.select("cls", "vector", "asked").mapInArrow(partial(_keys, curves=shared, dim=self.dim), "curve int, key long, cls long, query boolean")
        items = materialise(items, "curve-keys")
        order = ["curve", "key", "cls", "query"]
        numbered = materialise(items.repartitionByRange(self.parts, *order).sortWithinPartitions(*order).mapInArrow(_number, "curve int, cls long, query boolean, part int, place long"), "places")
        counts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
        self.places = numbered.join(counts.select("curve", "part", before.alias("before")), ["curve", "part"]).select("curve", "cls", "query", (F.col("place") + F.col("before")).alias("rank"))

    def window(self, recall: float) -> int:
        """Smallest power of two whose windows find that share of the exact neighbours of a sample of queries."""
        asked = self.classes.where("asked")
        n = asked.count()
        if n == 0 or self.total <= SMALLEST:
            return SMALLEST
        some = asked.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, SAMPLE / n))).select("cls", "vector").orderBy("cls").limit(4 * SAMPLE).toArrow()
        if not some.num_rows:
            some = asked.select("cls", "vector").orderBy("cls").limit(SAMPLE).toArrow()
        ids = some["cls"].to_numpy()
        shared = self.spark.sparkContext.broadcast((ids, matrix(some["vector"].combine_chunks(), self.dim)))
        lists = self.classes.select("cls", "vector").mapInArrow(partial(_exact, queries=shared, dim=self.dim, k=self.k), "cls long, found array<long>, scores array<double>")
        true = {}
        top = lists.repartition(self.parts, "cls").sortWithinPartitions("cls").mapInArrow(partial(_merge, k=self.k), "cls long, near long, score double")
        for r in top.collect():  # SAMPLE * k rows
            true.setdefault(r.cls, []).append(r.near)
        points = {x for near in true.values() for x in near}
        rank: dict[tuple[int, int, bool], int] = {}
        for r in self.places.where((F.col("query") & F.col("cls").isin([int(x) for x in ids])) | (~F.col("query") & F.col("cls").isin(sorted(points)))).collect():
            rank[r.cls, r.curve, r.query] = r.rank
        curves = sorted({c for _, c, _ in rank})
        gaps = np.array([min(abs(rank[q, c, True] - rank[p, c, False]) for c in curves) for q, near in true.items() for p in near])
        size = SMALLEST
        while size < 2 * self.total and (gaps <= size).mean() < recall:
            size *= 2
        return size

    def search(self, recall: float = 0.96) -> DataFrame:
        """cls, near, score: the best classes of each class that holds a query."""
        size = self.window(recall)
        self.size = size
        placed = self.places.withColumn("block", F.floor(F.col("rank") / size)).join(self.classes.select("cls", "vector"), "cls")
        points = placed.where("NOT query").select("curve", "block", F.lit(0).alias("role"), "cls", "vector")
        queries = placed.where("query").select("curve", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"), F.lit(1).alias("role"), "cls", "vector")
        dealt = points.unionByName(queries).repartition(self.parts, "curve", "block").sortWithinPartitions("curve", "block", "role")
        found = dealt.mapInArrow(partial(_search, dim=self.dim, k=self.k + 1), "cls long, found array<long>, scores array<double>")
        return found.repartition(self.parts, "cls").sortWithinPartitions("cls").mapInArrow(partial(_merge, k=self.k + 1), "cls long, near long, score double")


def neighbours(rows: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, curves: int = CURVES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best other rows found for each row that `asked` picks."""
    index = Index(rows, id_col, vector_col, asked, k, curves)
    schema = "query_id long, rank int, vec_id long, score double"
    if index.places is None:
        return index.spark.createDataFrame([], schema)
    near = index.search(recall).join(index.classes.select(F.col("cls").alias("near"), "ids"), "near")
    # at most (k + 1) classes of k + 1 ids for each query class
    lists = near.select("cls", F.explode("ids").alias("id"), "score").groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1).alias("top"))
    queries = index.rows.where("asked").join(index.classes.select("vector", "cls"), "vector").select("id", "cls")
    # one of the copies of its own id is the query itself
    mine = F.array_position(F.transform("top", lambda x: x.id), F.col("id"))
    rest = F.when(mine > 0, F.concat(F.slice("top", 1, F.greatest(mine - 1, F.lit(0)).cast("int")), F.slice("top", (mine + 1).cast("int"), k + 1))).otherwise(F.col("top"))
    got = queries.join(lists, "cls").select("id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "x"))
    return got.select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
