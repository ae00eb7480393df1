"""Best-fit packing of token pieces into fixed-capacity sequences, by a configuration linear program.

The length histogram (at most `capacity` rows) is all the driver sees. The covering program over configurations (which
lengths share a sequence) is solved by multiplicative weights: each round a dynamic-programming knapsack prices configurations,
and lengths that are covered lose weight, until all are. The fractional solution is rounded to full sequences, and the program is
solved again for what that leaves while this places a good part of it. The rest is filled configuration by configuration: the longest
length left with the best fill of the rest of the sequence, as often as that goes. Tasks then place pieces by their rank within their
length, so no task ever holds more than its own pieces.

Edge cases: a null text is empty and still has its end id; a piece that fills a sequence alone is not packed; repeated
rows are packed separately; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import frugal, materialise, ship

END_ID = 2
#: Of the covering program: how much of a length a round covers at most, how far below the best a configuration may be priced, and the bonus of long pieces.
STEP, SLACK, LONG_FIRST = 0.5, 0.2, 0.3
#: The program is solved again while rounding places at least this part of what was left.
GOOD_PART = 0.2


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each room up to capacity: the most total value of sizes (ascending, distinct, any number of each), and the size taken first or -1."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], ends[room]
        if n:
            total = best[room - sizes[:n]] + values[:n]
            i = int(total.argmax())
            if total[i] > best[room] + 1e-15:
                best[room], pick[room] = total[i], i
    return best, pick


def taken(pick: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """Copies of each size (by its place) in the best filling of a room."""
    out: dict[int, int] = {}
    while room > 0:
        i = int(pick[room])
        if i < 0:
            room -= 1
        else:
            out[i] = out.get(i, 0) + 1
            room -= int(sizes[i])
    return out


def fill(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Copies of each size, at most left, whose total is the largest within room."""
    out = np.zeros(len(sizes), np.int64)
    # used[t]: fewest copies of the last size that reach total t; reached layer by layer, largest sizes first
    reach = np.full(room + 1, -1, np.int64)
    reach[0] = len(sizes)
    for i in range(int(np.searchsorted(sizes, room, "right")) - 1, -1, -1):
        if reach[room] >= 0:
            break
        size = int(sizes[i])
        for _ in range(int(min(left[i], room // size))):
            new = np.flatnonzero((reach[:-size] >= 0) & (reach[size:] < 0)) + size
            # a total first reached with this size must not use it more often than there is
            if not len(new):
                break
            reach[new] = i
    total = int(np.flatnonzero(reach >= 0)[-1])
    while total > 0:
        i = int(reach[total])
        out[i] += 1
        total -= int(sizes[i])
    return out


def configurations(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """((copies of each length in one sequence, number of such sequences), ...), their total exactly the histogram; how many come from the program.

    The program is solved for what is left and rounded down, full sequences only and each at least once, as long as that places a good part
    of what is left. What then remains is filled one configuration at a time.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(places: np.ndarray, copies: np.ndarray, most: int) -> None:
        times = min(most, int((left[places] // copies).min()))
        if times > 0:
            left[places] -= copies * times
            out.append(({int(sizes[i]): int(n) for i, n in zip(places, copies, strict=True)}, times))

    while left.any():
        before, on = int(left.sum()), np.flatnonzero(left)
        for places, copies, amount in sorted(fractional(sizes[on], left[on], capacity), key=lambda x: -x[2]):
            if int(copies @ sizes[on][places]) == capacity:
                use(on[places], copies, max(1, int(amount)))
        if before - int(left.sum()) < GOOD_PART * before:
            break
    rounded = len(out)
    while left.any():
        copies, times = fullest(sizes, left, capacity)
        places = np.flatnonzero(copies)
        use(places, copies[places], times)
    return out, rounded


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The longest length left with the best fill of the rest of the sequence, and how often that goes."""
    i = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[i] -= 1
    copies = fill(sizes, rest, capacity - int(sizes[i]))
    copies[i] += 1
    on = copies > 0
    return copies, int((left[on] // copies[on]).min())


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Multiplicative weights for the covering program, until every length is covered: (places in sizes, copies, how often) of configurations.

    A round prices with one dynamic program and takes, of the configurations within SLACK of the best, as many as share no length.
    """
    covered = np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    while (covered < 1 - 1e-9).any():
        live = np.flatnonzero(covered < 1 - 1e-9)
        own = sizes[live]
        # a piece weighs its tokens, less as its length is covered, and somewhat more if it is long: short ones fill gaps later
        weight = np.exp(-covered[live] / STEP) * own * (1 + LONG_FIRST * own / capacity)
        best, pick = knapsack(weight, own, capacity)
        value = weight + best[capacity - own]  # of the best configuration with each length
        busy = np.zeros(len(live), bool)
        for i in np.argsort(-value, kind="stable").tolist():
            if value[i] < (1 - SLACK) * best[capacity]:
                break
            if busy[i]:
                continue
            held = taken(pick, own, capacity - int(own[i]))
            held[i] = held.get(i, 0) + 1
            places = np.array(sorted(held))
            if busy[places].any():
                continue
            busy[places] = True
            wanted = demand[live[places]]
            copies = np.minimum([held[int(j)] for j in places], wanted)  # there are no more
            amount = STEP * float((wanted / copies).min())
            covered[live[places]] += amount * copies / wanted
            key = tuple(live[places].tolist()), tuple(copies.tolist())
            used[key] = used.get(key, 0.0) + amount
    return [(np.array(places), np.array(copies), amount) for (places, copies), amount in used.items()]


class Plan:
    """Places of the r-th piece of each length. Its size depends on the capacity, not on the number of pieces."""

    def __init__(self, packed: list[tuple[dict[int, int], int]]):
        slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        base = 0
        for copies, times in packed:
            offset = 0
            for size in sorted(copies, reverse=True):
                n = copies[size]
                slots.setdefault(size, []).append((n * times, base, n, offset))
                offset += n * size
            base += times
        self.sequences = base
        self.slots = {}
        for size, rows in slots.items():
            count, first, copies, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            self.slots[size] = (np.concatenate([[0], np.cumsum(count)]), first, copies, offset)

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, first, copies, offset = self.slots[size]
        k = np.searchsorted(ends, rank, "right") - 1
        r = rank - ends[k]
        return first[k] + r // copies[k], offset[k] + (r % copies[k]) * size


@frugal
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for a, b, ids, at in tokens.encoded(batch.column(0), path, end_id):
            n = np.diff(at)
            count = -(-n // capacity)
            row = np.repeat(np.arange(b - a), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * capacity  # the first piece may be shorter
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            crc = [zlib.crc32(ids[x : x + y]) for x, y in zip((at[row] + start).tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            group = np.flatnonzero(np.diff(length[order], prepend=-1))
            run = np.arange(len(order)) - np.repeat(group, np.diff(np.append(group, len(order))))
            rank = np.empty(len(order), np.int64)
            rank[order] = run + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a).take(pa.array(row)), *(pa.array(x, kind) for x, kind in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(row), part), pa.int32()), (rank, pa.int64())))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )


@frugal
def _placed(batches: Iterator[pa.RecordBatch], plan, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            sequence[rows], offset[rows] = plan.value.place(int(size), rank[rows])
        keep = [batch.column(i) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i")).mapInArrow(partial(_pieces, path=tokenizer_path, end_id=end_id, capacity=capacity), schema + ", part int, rank long")
    pieces = materialise(pieces, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(configurations(histogram, capacity)[0]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select(F.col("length").alias("l"), F.col("part").alias("p"), before.alias("before")), (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(partial(_placed, plan=plan, capacity=capacity), schema + ", sequence_id long, offset long")
