"""Chat formatting: quotation linking and reply-ordered conversations without quotes.

Each line's quote level is the number of its leading '>' marks. A message's own lines are those of level 0; a run of quoted lines
of one level is a passage. A passage is normalised (A-Z lower-cased, white space and line ends collapsed) and hashed by all its windows of
WORDS words; own texts are hashed likewise, so whatever run of words of an own text a passage quotes, however it is wrapped, all its hashes
are among the text's. A shorter passage is hashed line by line. It belongs to the latest earlier message of the conversation that has all
its hashes, which is found by descending: the bound falls to the earliest of the latest messages that have each hash, until they agree or
some hash has none. Only where no message has all, each quoted line counts for the
latest earlier message that has it as an own line. A message answers the message that most of its level-1 passages (by hashes), or else
lines, belong to (then the latest); deeper levels count only where level 1 names none. A line of own text that announces a quote
("... wrote:") goes with the quote.

Both sides of the match are reduced to distinct (conversation, hash, turn) rows of conversations with quotes before they meet, and the latest earlier turn is found
over ranges of turns, so a line that everyone quotes or a conversation with a third of all messages stays in small pieces. Threads are
resolved by pointer jumping. The result is range-partitioned by (conversation, thread, turn), which is the reply order: a message,
then all that answers it directly or indirectly, by turn; `position` numbers it within the conversation.

Edge cases: a null text is empty; a null conv_id or turn is kept, links to nothing and has no position; several rows of one turn are
linked alike and ordered by role and text; other columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import discard, frugal, materialise, parallelism, ship

MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
ANNOUNCES = re.compile(r"wrote:\s*$", re.IGNORECASE | re.ASCII)
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANGE = 1024
#: Words of a window of a passage.
WORDS = 4


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    out = []
    for line in text.split("\n"):
        found = MARKS.match(line)
        out.append((found[1].count(">"), line[found.end() :]) if found else (0, line))
    return out


def normalise(line: str) -> str:
    return " ".join(re.split(r"[\x20\x09-\x0D]+", line.translate(ASCII_LOWER))).strip(" ")


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(own text, own normalised lines, quoted normalised lines with their level)."""
    rows = levels(text)
    own, quoted = [], []
    for i, (level, line) in enumerate(rows):
        if level:
            quoted.append((level, normalise(line)))
        else:
            after = next((x for x in rows[i + 1 :] if x[0] or x[1].strip()), None)
            if not (after and after[0] and ANNOUNCES.search(line)):
                own.append(line)
    lines = [normalise(x) for x in own]
    return "\n".join(own).strip("\n") if quoted else text, [x for x in lines if x], [x for x in quoted if x[1]]


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, normalised lines that are not blank) of each run of quoted lines of one level."""
    out: list[tuple[int, list[str]]] = []
    last = 0
    for level, line in levels(text):
        if level:
            if level != last:
                out.append((level, []))
            if words := normalise(line):
                out[-1][1].append(words)
        last = level
    return [x for x in out if x[1]]


def windows(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashes of each text's windows of WORDS words."""
    data = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)])
    h, _, _, at = tv.words(np.frombuffer(b"".join(data), np.uint8), offsets)
    if len(h) < WORDS:
        return [np.zeros(0, np.int64)] * len(texts)
    grams = tv.ngram_hashes(h, WORDS).view(np.int64)
    return [np.unique(grams[a : max(a, b - WORDS + 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _hash(lines: list[str]) -> np.ndarray:
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    return tv.span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - np.array([len(x) for x in data], np.int64), ends, tv.RAW_TABLE).view(np.int64) if data else np.zeros(0, np.int64)


@frugal
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the own text, hashes of own lines and of its windows (distinct), hashes and levels of quoted lines, and passages by their hashes."""
    names = ["conv_id", "turn", "role", "body", "lines", "quoted", "levels", "passages"]
    for batch in batches:
        own, lines, quoted, level, held = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            body, mine, theirs = parse(text or "")
            own.append(body)
            lines.append(_hash(mine))
            quoted.append(_hash([x for _, x in theirs]))
            level.append([n for n, _ in theirs])
            held.append(passages(text) if theirs else [])
        prints = windows(own)
        of_passages = iter(windows([" ".join(x) for found in held for _, x in found]))
        keyed = []
        for found in held:
            both = [(n, next(of_passages), x) for n, x in found]
            keyed.append([{"level": n, "keys": keys if len(keys) else np.unique(_hash(x))} for n, keys, x in both])
        many = pa.list_(pa.int64())
        every = [np.unique(np.concatenate([x, y])) for x, y in zip(lines, prints, strict=True)]
        columns = [pa.array(own, pa.string()), pa.array(every, many), pa.array(quoted, many), pa.array(level, pa.list_(pa.int32())), pa.array(keyed, pa.list_(pa.struct([("level", pa.int32()), ("keys", many)])))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *columns], names)


def latest(asked: DataFrame, given: DataFrame) -> DataFrame:
    """asked: distinct conv_id, h, turn, kind (1: before the turn, -1: up to it); given: distinct conv_id, h, turn.

    asked with `found`, the largest such turn of given, where there is one. Within a range of turns the rows of a hash are few (distinct
    turns); across ranges only each range's largest turn is carried.
    """
    keys = ["conv_id", "h"]
    ranged = lambda df, kind: df.select(*keys, "turn", F.floor(F.col("turn") / RANGE).alias("range"), kind.alias("kind"))
    rows = ranged(asked, F.col("kind")).unionByName(ranged(given, F.lit(0)))
    inside = Window.partitionBy(*keys, "range").orderBy("turn", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(F.when(F.col("kind") == 0, F.col("turn"))).over(inside))
    tops = rows.groupBy(*keys, "range").agg(F.max(F.when(F.col("kind") == 0, F.col("turn"))).alias("top"))
    tops = tops.withColumn("carried", F.max("top").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    out = near.where("kind <> 0").join(tops, [*keys, "range"]).select(*keys, "turn", "kind", F.coalesce("near", "carried").alias("found"))
    return out.where("found IS NOT NULL")


def passage_links(asks: DataFrame, given: DataFrame) -> DataFrame:
    """asks: distinct conv_id, turn, level, keys. conv_id, turn, level, n (hashes), found: the latest earlier turn that has them all."""
    done, names = [], ["conv_id", "turn", "level", "keys"]
    open_ = materialise(asks.select(*names, F.xxhash64("level", "keys").alias("pid"), F.col("turn").alias("bound"), F.lit(1).alias("kind")), "passages")
    while True:
        each = open_.select("conv_id", "turn", "pid", F.explode("keys").alias("h"), "bound", "kind")
        found = latest(each.select("conv_id", "h", F.col("bound").alias("turn"), "kind").distinct(), given).withColumnRenamed("turn", "bound")
        met = each.join(found, ["conv_id", "h", "bound", "kind"]).groupBy("conv_id", "turn", "pid").agg(F.min("found").alias("low"), F.max("found").alias("high"), F.count("*").alias("n"))
        step = open_.drop("bound", "kind").join(met, ["conv_id", "turn", "pid"]).where("n = size(keys)")
        step = materialise(step, "passages")
        discard(open_)
        done.append(step.where("low = high").select("conv_id", "turn", "level", "n", F.col("low").alias("found")))
        open_ = step.where("low < high").select(*names, "pid", F.col("low").alias("bound"), F.lit(-1).alias("kind"))
        if not open_.limit(1).count():
            return functools.reduce(DataFrame.unionByName, done)
        open_ = materialise(open_, "passages")


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to of turns that quote an earlier one."""
    rows = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = rows.where("size(quoted) > 0")
    with_quotes = rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    given = materialise(with_quotes.select("conv_id", "turn", F.explode("lines").alias("h")).distinct(), "own-hashes")
    asks = quoting.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.keys").distinct()
    by_passage = passage_links(asks, given).withColumn("whole", F.lit(1))
    quotes = quoting.select("conv_id", "turn", F.explode(F.arrays_zip("quoted", "levels")).alias("q")).select("conv_id", "turn", F.col("q.quoted").alias("h"), F.col("q.levels").alias("level"))
    quotes = quotes.groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    found = latest(quotes.select("conv_id", "h", "turn", F.lit(1).alias("kind")), given).drop("kind")
    by_line = quotes.join(found, ["conv_id", "h", "turn"]).select("conv_id", "turn", "level", "n", "found", F.lit(0).alias("whole"))
    votes = by_passage.unionByName(by_line).groupBy("conv_id", "turn", "found", "whole").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    order = F.struct((-F.col("level")).alias("level"), "whole", "n", "found")
    return votes.groupBy("conv_id", "turn").agg(F.max(order).alias("m")).select("conv_id", "turn", F.col("m.found").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (the turn where its chain of answers starts), depth (answers up to there)."""
    now = materialise(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "thread"], "left")
        now = materialise(step.select("conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the task's number and each row's place among the task's rows of its conversation. Rows come sorted."""
    part, now, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        place = []
        for conv in batch.column("conv_id").to_pylist():
            now, seen = (now, seen + 1) if conv == now else (conv, 0)
            place.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, reply_to, thread, depth, n_quoted, position of every message, in reply order."""
    spark = messages.sparkSession
    ship(spark)
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    head = ", ".join(f"{c} {k}" for c, k in kinds.items())
    parsed = materialise(messages.select("conv_id", "turn", "role", "text").mapInArrow(_parse, f"{head}, body string, lines array<long>, quoted array<long>, levels array<int>, passages array<struct<level:int,keys:array<long>>>"), "messages")
    linked = threads(reply_links(parsed))
    rows = parsed.join(linked, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "body", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("quoted").cast("long").alias("n_quoted"))
    order = ["conv_id", "thread", "turn", "role", "body"]
    body = f"{head}, body string, reply_to {kinds['turn']}, thread {kinds['turn']}, depth long, n_quoted long"
    counted = materialise(rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).mapInArrow(_count, f"{body}, part int, place long"), "ordered")
    counts = counted.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before"))
    full = counted.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    position = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("place") + F.col("before"))
    return full.select("conv_id", "turn", "role", "body", "reply_to", "thread", "depth", "n_quoted", position.alias("position"))
