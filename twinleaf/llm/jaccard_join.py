"""Near-duplicate documents by an exact Jaccard join of word shingles: a grouped prefix join.

1. Tasks hash each document's distinct shingles and deal them, packed, to hash segments; a segment counts in how many documents
   each occurs and answers each block of documents with those that occur twice or more. Others can match nothing.
2. A document of n shingles can only link if at least t*n of them are repeated; only such documents go on. Equal sets become one class.
3. Shingles are ordered from rare to common. Classes of equal size and equal prefix (of n - ceil(t*n) + 1 shingles) form a group;
   only groups are posted under their prefix shingles and joined.
4. First each group meets one leader for the shingle lists it shares; verified links give components. Lists inside one component are
   done and dropped, after this and after each round. In the rounds that follow, each list that still spans components brings one group of each of them before some of a component drawn by its size, and of each two components
   the closest pair is verified. After these rounds, which only spare work, every list that still spans components gives all its group pairs outside its largest component;
   pairs pass size, position and bitmap filters, are expanded to members of different components and verified.
   Pairs inside a component need no test: the result is the components.

So a list of copies or near copies costs as many pairs as members, no pair that could join two components is left out, and what is
linked is decided by exact counts. Tables that nothing reads any more are deleted as the join goes on. Hashes have 48 bits and those of the segment number.

Edge cases: texts of fewer words than a shingle have one shingle of all words; without words (or null) there is none and no link;
rows are documents, also rows of one id; ties go to the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .shared import discard, frugal, materialise, parallelism, release, ship

U64 = np.uint64
LOW = 48
BLOCK = 1 << 19
MAP_LONGS = 16
WORDS = 5
#: Rounds in which components meet before the full crossing, and how many groups the drawn component sends to each.
ROUNDS, DRAWS = 3, 4
#: Similarity bound as a fraction: intersection * DOWN >= union * UP.
UP, DOWN = 80, 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle keys of each document, one after another; documents' offsets in them)."""
    h, _, _, at = tv.words(data, offsets)
    n = np.diff(at)
    grams = tv.ngram_hashes(h, k)
    count = np.where(n >= k, n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    keys = grams[first] if len(owner) else np.zeros(0, U64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([tv.ngram_hashes(h[at[i] : at[i + 1]], int(n[i]))[0] for i in short], U64)
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, whole])
    keys = keys >> U64(64 - LOW - bits)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    owner, keys = owner[new], keys[new]
    return keys, np.searchsorted(owner, np.arange(len(n) + 1))


def pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(blob, segment: int) -> np.ndarray:
    got = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :6] = got
    return out.view("<u8").ravel() | U64(segment << LOW)


@frugal
def _segments(batches: Iterator[pa.RecordBatch], k: int, bits: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a block: one with its documents (ids set), and one for each segment with packed keys and documents' counts."""
    base, number = TaskContext.get().partitionId() << 20, 0
    held: list[tuple] = []
    size = 0
    names = ["deal", "seg", "block", "ids", "marks", "sizes", "keys"]

    def out() -> Iterator[pa.RecordBatch]:
        block = base + number
        keys = np.concatenate([x[0] for x in held])
        n = np.concatenate([np.diff(x[1]) for x in held])
        at = np.concatenate([[0], np.cumsum(n)])
        prints = []
        for salt in (3, 5):
            sums = np.zeros(len(keys) + 1, U64)
            np.cumsum(tv.mix(keys + U64(salt)), out=sums[1:])
            prints.append(sums[at[1:]] - sums[at[:-1]])
        ids = pa.concat_arrays([x[2] for x in held])
        marks = pa.concat_arrays([x[3] for x in held])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([pa.array([int(tv.mix(np.array([block], U64))[0]) >> (64 - bits)], pa.int32()), pa.array([-1], pa.int32()), pa.array([block], pa.int64()), whole(ids), whole(marks), pa.array([n.astype("<i4").tobytes()], pa.binary()), pa.array([np.stack(prints).astype("<u8").tobytes()], pa.binary())], names)
        seg = (keys >> U64(LOW)).astype(np.int32)
        order = np.argsort(seg, kind="stable")
        cuts = np.searchsorted(seg[order], np.arange((1 << bits) + 1))
        owner = np.repeat(np.arange(len(n)), n)
        rows = [s for s in range(1 << bits) if cuts[s] < cuts[s + 1]]
        parts = [order[cuts[s] : cuts[s + 1]] for s in rows]
        if rows:
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(rows, pa.int32()), pa.array([block] * len(rows), pa.int64()), none.cast(pa.list_(id_kind)), none.cast(pa.list_(pa.int64())), pa.array([np.bincount(owner[p], minlength=len(n)).astype("<i4").tobytes() for p in parts], pa.binary()), pa.array([pack48(keys[p]) for p in parts], pa.binary())],
                names,
            )

    for batch in batches:
        for a, b, data, offsets in tv.slices(batch.column(0)):
            keys, at = shingle_sets(data, offsets, k, bits)
            held.append((keys, at, batch.column(1).slice(a, b - a).cast(id_kind), batch.column(2).slice(a, b - a)))
            size += len(keys) + b - a
            if size >= BLOCK:
                yield from out()
                held, size, number = [], 0, number + 1
    if held:
        yield from out()


def rarity(n: np.ndarray) -> np.ndarray:
    """One byte that never falls as the count grows."""
    return np.minimum(np.floor(16 * np.log2(n)), 255).astype(np.uint8)


@frugal
def _repeated(batches: Iterator[pa.RecordBatch], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment. Keeps keys that occur in two documents or more, with their rarity; rows with ids pass."""
    now, rows = None, []
    names = ["block", "seg", "ids", "marks", "sizes", "keys", "rare"]

    def out() -> pa.RecordBatch:
        keys = [unpack48(r[2], now) for r in rows]
        _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        count = count[inverse]
        kept, rare = count >= 2, rarity(count)
        result, pos = [], 0
        for (block, sizes, _), own in zip(rows, keys, strict=True):
            ok = kept[pos : pos + len(own)]
            if ok.any():
                sums = np.concatenate([[0], np.cumsum(ok)])
                ends = np.cumsum(np.frombuffer(sizes, "<i4"))
                left = np.diff(np.concatenate([[0], sums[ends]])).astype("<i4")
                result.append((block, left.tobytes(), pack48(own[ok]), rare[pos : pos + len(own)][ok].tobytes()))
            pos += len(own)
        block, left, keys, rare = ([r[i] for r in result] for i in range(4))
        none = pa.nulls(len(result))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([now] * len(result), pa.int32()), none.cast(pa.list_(id_kind)), none.cast(pa.list_(pa.int64())), pa.array(left, pa.binary()), pa.array(keys, pa.binary()), pa.array(rare, pa.binary())], names)

    for batch in batches:
        segs = batch.column("seg").to_numpy()
        if (segs < 0).any():
            meta = batch.filter(pa.array(segs < 0))
            yield pa.RecordBatch.from_arrays([*(meta.column(c) for c in names[:4]), meta.column("sizes"), meta.column("keys"), pa.nulls(meta.num_rows).cast(pa.binary())], names)
        data = batch.filter(pa.array(segs >= 0)).select(["block", "seg", "sizes", "keys"])
        for block, seg, sizes, keys in zip(*(c.to_pylist() for c in data.columns), strict=True):
            if seg != now:
                if rows:
                    yield out()
                now, rows = seg, []
            rows.append((block, sizes, keys))
    if rows:
        yield out()


def parity(keys: np.ndarray) -> np.ndarray:
    """Bitmap of MAP_LONGS longs: the parity of the number of keys at each bit."""
    spot = (tv.mix(keys) >> U64(32)) % U64(64 * MAP_LONGS)
    return np.packbits(np.bincount(spot.astype(np.int64), minlength=64 * MAP_LONGS).astype(np.uint8) & 1).view("<i8")


def prefix_size(n: int) -> int:
    return n - -(-n * UP // DOWN) + 1


@frugal
def _documents(batches: Iterator[pa.RecordBatch], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its documents first. A row for each document; keys, prefix and bitmap if it can link at all."""
    now, meta, parts = None, None, []
    names = ["node", "id", "mark", "n", "print1", "print2", "repeated", "keys", "prefix", *(f"m{i}" for i in range(MAP_LONGS))]

    def out() -> Iterator[pa.RecordBatch]:
        ids, marks, n, prints = meta
        keys = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, U64)
        rare = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint8)
        owner = np.concatenate([np.repeat(np.arange(len(n)), p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        repeated = np.bincount(owner, minlength=len(n))
        able = (n > 0) & (repeated * DOWN >= n * UP)
        mine = able[owner]
        keys, rare, owner = keys[mine], rare[mine], owner[mine]
        order = np.lexsort((keys, rare, owner))
        keys, owner = keys[order], owner[order]
        at = np.searchsorted(owner, np.arange(len(n) + 1))
        sets, prefixes = [None] * len(n), [None] * len(n)
        maps = np.zeros((len(n), MAP_LONGS), np.int64)
        for i in np.flatnonzero(able):
            own = keys[at[i] : at[i + 1]]
            prefixes[i] = own[: prefix_size(int(n[i])) - (int(n[i]) - len(own))].astype(np.int64)
            sets[i] = np.sort(own).astype("<u8").tobytes()
            maps[i] = parity(own)
        for a in range(0, len(n), 2048):
            b = min(a + 2048, len(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array((now << 21) + np.arange(a, b), pa.int64()), ids.slice(a, b - a), marks.slice(a, b - a), pa.array(n[a:b], pa.int64()), pa.array(prints[0, a:b].view(np.int64)), pa.array(prints[1, a:b].view(np.int64)), pa.array(repeated[a:b], pa.int64()), pa.array(sets[a:b], pa.binary()), pa.array(prefixes[a:b], pa.list_(pa.int64())), *(pa.array(maps[a:b, i]) for i in range(MAP_LONGS))],
                names,
            )

    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column("block")[i].as_py()
            if block != now:
                if meta is not None:
                    yield from out()
                now, meta, parts = block, None, []
            sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i4").astype(np.int64)
            if batch.column("seg")[i].as_py() < 0:
                prints = np.frombuffer(batch.column("keys")[i].as_buffer(), "<u8").reshape(2, -1)
                meta = (batch.column("ids")[i].values.cast(id_kind), batch.column("marks")[i].values, sizes, prints.copy())
            else:
                parts.append((sizes, unpack48(batch.column("keys")[i].as_buffer(), batch.column("seg")[i].as_py()), np.frombuffer(batch.column("rare")[i].as_buffer(), np.uint8)))
    if meta is not None:
        yield from out()


@frugal
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough, by exact counts."""
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column("ka")[i].as_buffer(), "<u8")
            y = np.frombuffer(batch.column("kb")[i].as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = batch.column("na")[i].as_py() + batch.column("nb")[i].as_py() - both
            kept.append(both * DOWN >= union * UP)
        mask = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def sizes_fit(x: Column, y: Column) -> Column:
    return F.least(x, y) * DOWN >= F.greatest(x, y) * UP


def overlap_fits(overlap: Column, total: Column) -> Column:
    """Whether an intersection of `overlap` can do for two sets of `total` together."""
    return overlap * (UP + DOWN) >= total * UP


def apart(x: str, y: str) -> Column:
    """Differing bits of two bitmaps: no more than the sets' differing shingles."""
    bits = [F.bit_count(F.col(f"{x}.m{i}").bitwiseXOR(F.col(f"{y}.m{i}"))) for i in range(MAP_LONGS)]
    return sum(bits[1:], bits[0])


def near_enough(x: str, y: str) -> Column:
    """Whether two groups' heads, or two members (radius 0), can have similar sets as far as bitmaps tell."""
    least = apart(x, y) - F.col(f"{x}.radius") - F.col(f"{y}.radius")
    return overlap_fits((F.col(f"{x}.repeated") + F.col(f"{y}.repeated") - least) / 2, F.col(f"{x}.n") + F.col(f"{y}.n"))


def renamed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with their `label` after changes (label, to)."""
    others = [c for c in rows.columns if c != "label"]
    return rows.join(changes, "label", "left").select(*others, F.coalesce("to", "label").alias("label"))


def changes_of(links: DataFrame) -> DataFrame:
    """label, to: the new label of every label that links join to others."""
    return components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))


def spanning(lists: DataFrame) -> DataFrame:
    """Rows of the lists (kind, token) whose nodes lie in more than one component."""
    mixed = lists.groupBy("kind", "token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("kind", "token")
    return lists.join(mixed, ["kind", "token"], "left_semi")


class Join:
    """The join's tables. nodes: every row; classes: one row for each distinct set that can link; members: their groups."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.id_kind = docs.schema[id_col].dataType.simpleString()
        parts = parallelism(self.spark)
        bits = max(4, (2 * parts - 1).bit_length())
        from pyspark.sql.pandas.types import to_arrow_type

        arrow_id = to_arrow_type(docs.schema[id_col].dataType)
        rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
        lists = f"ids array<{self.id_kind}>, marks array<long>, sizes binary, keys binary"
        dealt = rows.mapInArrow(partial(_segments, k=words, bits=bits, id_kind=arrow_id), f"deal int, seg int, block long, {lists}").repartitionById(parts, "deal").sortWithinPartitions("deal", "seg")
        answered = dealt.mapInArrow(partial(_repeated, id_kind=arrow_id), f"block long, seg int, {lists}, rare binary")
        schema = f"node long, id {self.id_kind}, mark long, n long, print1 long, print2 long, repeated long, keys binary, prefix array<long>, " + ", ".join(f"m{i} long" for i in range(MAP_LONGS))
        whole = answered.repartition(parts, "block").sortWithinPartitions("block", "seg")
        self.nodes = materialise(whole.mapInArrow(partial(_documents, id_kind=arrow_id), schema), "documents")
        del dealt, answered, whole
        release(self.spark)
        able = self.nodes.where("keys IS NOT NULL")
        self.prints = materialise(able.groupBy("print1", "print2", "n").agg(F.min("node").alias("cls"), F.count("*").alias("copies")), "classes")
        classes = able.join(self.prints.select(F.col("cls").alias("node")), "node", "left_semi")
        classes = classes.withColumn("p1", F.xxhash64("prefix", "n")).withColumn("p2", F.hash("prefix", "n"))
        same = ["p1", "p2", "n", "repeated"]
        groups = classes.groupBy(*same).agg(F.min("node").alias("gid"))
        self.classes = materialise(classes.join(groups, same).drop("p1", "p2", "id", "mark", "print1", "print2"), "sets")
        bitmaps = [f"m{i}" for i in range(MAP_LONGS)]
        first = self.classes.where("node = gid").select("gid", "n", "repeated", *bitmaps)
        spread = self.classes.where("node <> gid").alias("x").join(first.alias("y"), F.col("x.gid") == F.col("y.gid")).groupBy("x.gid").agg(F.max(apart("x", "y")).alias("radius"))
        # no member's bitmap is further than the radius from its head's
        self.heads = materialise(first.join(spread, "gid", "left").withColumn("radius", F.coalesce("radius", F.lit(0))), "heads")
        posted = self.classes.where("node = gid").select("gid", "n", "repeated", F.posexplode("prefix").alias("pos", "token"))
        # what can still be shared from this shingle on: later ones are at least as common
        posted = posted.select("gid", "n", "token", (F.col("repeated") - F.col("pos")).alias("rest"))
        # a list of one group joins nothing
        often = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        self.postings = materialise(posted.join(often, "token", "left_semi"), "postings")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs a, b of classes that are similar."""
        sets = self.classes.select("node", "keys", "n")
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("n").alias("na")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("n").alias("nb")), "b")
        return materialise(full.where(sizes_fit(F.col("na"), F.col("nb"))).mapInArrow(_verify, "a long, b long"), "links")

    def leader_pairs(self) -> DataFrame:
        """Each group's head with the leader it meets in most lists; each member with its group's head."""
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DOWN / UP)))
        posted = self.postings.select("gid", "token", band.alias("band"))
        order = F.struct(F.xxhash64("gid").alias("r"), F.col("gid").alias("lead"))
        leaders = posted.groupBy("token", "band").agg(F.min(order).alias("o"), F.count("*").alias("c")).where("c > 1").select("token", "band", F.col("o.lead").alias("lead"), F.col("o.r").alias("r"))
        met = posted.join(leaders, ["token", "band"]).where("gid <> lead").groupBy("gid", "lead", "r").agg(F.count("*").alias("c"))
        best = met.groupBy("gid").agg(F.max(F.struct("c", (-F.col("r")).alias("r"), "lead")).alias("m")).select(F.col("gid").alias("a"), F.col("m.lead").alias("b"))
        return best.union(self.classes.where("node <> gid").select(F.col("node").alias("a"), F.col("gid").alias("b")))

    def open_lists(self, labels: DataFrame) -> DataFrame:
        """kind, token, node, n, label of what lists of heads and groups of members hold, where they span components."""
        heads = self.postings.select(F.lit(0).alias("kind"), "token", F.col("gid").alias("node"), "n")
        groups = self.heads.where("radius > 0").select("gid")
        inside = self.classes.join(groups, "gid", "left_semi").select(F.lit(1).alias("kind"), F.col("gid").alias("token"), "node", "n")
        return materialise(spanning(heads.unionByName(inside).join(labels, "node")), "open-lists")

    def meetings(self, lists: DataFrame, salt: int) -> DataFrame:
        """a, b, la, lb: classes that meet in an open list, one pair for each two components."""
        drawn = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(salt * 8 + k)).alias("r"), "node", "n"))
        reps = lists.groupBy("kind", "token", "label").agg(F.count("*").alias("c"), *(drawn(k).alias(f"x{k}") for k in range(DRAWS)))
        reps = materialise(reps, "meeting")
        largest = F.max(F.struct("c", "label", *(f"x{k}" for k in range(DRAWS))))
        lead = reps.groupBy("kind", "token").agg(largest.alias("l"), F.count("*").alias("c")).where("c > 1")
        lead = lead.select("kind", "token", F.col("l.label").alias("lb"), F.explode(F.array(*(F.col(f"l.x{k}") for k in range(DRAWS)))).alias("y"))
        fits = (F.col("label") != F.col("lb")) & sizes_fit(F.col("x0.n"), F.col("y.n"))
        met = reps.drop("c").join(lead, ["kind", "token"]).where(fits).select(F.col("x0.node").alias("a"), F.col("y.node").alias("b"), F.col("label").alias("la"), "lb").distinct()
        bitmaps = self.classes.select("node", "n", "repeated", F.lit(0).alias("radius"), *(f"m{i}" for i in range(MAP_LONGS)))
        x, y = bitmaps.alias("x"), bitmaps.alias("y")
        close = met.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(near_enough("x", "y"))
        best = close.groupBy(F.least("la", "lb").alias("p"), F.greatest("la", "lb").alias("q")).agg(F.min(F.struct(apart("x", "y").alias("d"), "a", "b", "la", "lb")).alias("m"))
        best = materialise(best.select("m.a", "m.b", "m.la", "m.lb"), "meetings")
        discard(reps)
        return best

    def crossing_pairs(self, labels: DataFrame, open_: DataFrame) -> DataFrame:
        """All pairs of classes in different components that share a prefix shingle or a group and pass the filters."""
        members = materialise(self.classes.join(labels, "node").select("node", "gid", "n", "repeated", "label", F.lit(0).alias("radius"), *(f"m{i}" for i in range(MAP_LONGS))), "members")
        span = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        # lists whose heads span components, and those with a group that does
        mixed = self.postings.join(span.where("low <> high").select("gid"), "gid", "left_semi").select("token")
        tokens = open_.where("kind = 0").select("token").union(mixed).distinct()
        lists = self.postings.join(tokens, "token", "left_semi").join(span, "gid").join(self.heads.drop("n"), "gid")
        lists = materialise(lists, "lists")
        pure = lists.where("low = high").groupBy("token", "low").agg(F.count("*").alias("c"))
        largest = pure.groupBy("token").agg(F.max(F.struct("c", "low")).alias("m")).select("token", F.col("m.low").alias("main"))
        others = lists.join(largest, "token", "left").where("main IS NULL OR low <> main OR high <> main")
        x, y = others.alias("x"), lists.alias("y")
        fits = (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") != F.col("y.gid")) & sizes_fit(F.col("x.n"), F.col("y.n"))
        fits &= ~((F.col("x.low") == F.col("x.high")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.low") == F.col("y.high")))
        fits &= overlap_fits(F.least("x.rest", "y.rest"), F.col("x.n") + F.col("y.n")) & near_enough("x", "y")
        groups = x.join(y, fits).select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb")).distinct()
        inner = span.where("low <> high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
        x, y = members.alias("x"), members.alias("y")
        pairs = groups.union(inner).join(x, F.col("ga") == F.col("x.gid")).join(y, (F.col("gb") == F.col("y.gid")) & (F.col("x.label") != F.col("y.label")) & near_enough("x", "y"))
        pairs = materialise(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
        discard(members, lists)
        return pairs

    def labels(self) -> DataFrame:
        """node, label of every class: the smallest class that links lead to."""
        every = self.classes.select("node")
        links = self.verified(self.leader_pairs())
        found = components(links)
        labels = materialise(every.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
        discard(links, found)
        lists = self.open_lists(labels)
        for salt in range(ROUNDS):
            met = self.meetings(lists, salt)
            links = self.verified(met.select("a", "b"))
            linked = materialise(met.join(links, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")), "linked")
            discard(met, links)
            if not linked.limit(1).count():
                discard(linked)
                break
            labels, lists = self._joined(labels, lists, linked)
        pairs = self.crossing_pairs(labels, lists)
        more = self.verified(pairs)
        ends = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        linked = more.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
        linked = materialise(linked.select(F.col("la").alias("a"), F.col("lb").alias("b")), "linked")
        discard(pairs, more)
        return self._joined(labels, lists, linked)[0]

    def _joined(self, labels: DataFrame, lists: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """labels and open lists after links between labels; the tables they are made from go."""
        changes = changes_of(linked)
        after = materialise(renamed(labels, changes), "labels"), materialise(spanning(renamed(lists, changes)), "open-lists")
        discard(labels, lists, linked, changes)
        return after

    def resolved(self) -> DataFrame:
        """id, mark, n, component: the smallest id of the documents linked with it, and `first`: its smallest (id, mark)."""
        own = F.struct("id", "mark")
        able = self.nodes.where("keys IS NOT NULL").select("id", "mark", "print1", "print2", "n")
        least = able.groupBy("print1", "print2", "n").agg(F.min(own).alias("least")).join(self.prints, ["print1", "print2", "n"])
        named = least.join(self.labels().select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        named = materialise(named.select("print1", "print2", "n", "label", "least"), "named")
        discard(self.prints, self.classes, self.heads, self.postings)
        firsts = named.groupBy("label").agg(F.min("least").alias("first"))
        found = named.join(firsts, "label").select("print1", "print2", "n", "first")
        every = self.nodes.select("node", "id", "mark", "n", "print1", "print2")
        out = every.join(found, ["print1", "print2", "n"], "left").select("id", "mark", "n", F.coalesce("first", own).alias("first")).withColumn("component", F.col("first.id"))
        out = materialise(out, "components")
        discard(self.nodes, named)
        return out


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each document: id, n_shingles, component_id."""
    return Join(docs, id_col, text_col, words).resolved().select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs without all but one row of each component: its smallest id, then the smallest hash of its text. Rows without words stay."""
    found = Join(docs, id_col, text_col, words).resolved()
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    leaves = found.where("n > 0 AND NOT (first <=> struct(id, mark))").select(F.col("id").alias("__i"), F.col("mark").alias("__m")).distinct()
    twice = found.where("n > 0 AND first <=> struct(id, mark)").groupBy(F.col("id").alias("__i"), F.col("mark").alias("__m")).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = docs[id_col].eqNullSafe(F.col("__i")) & (mark == F.col("__m"))
    kept = docs.join(materialise(leaves, "leaving"), same, "left_anti")
    twice = materialise(twice, "repeated-rows")
    if not twice.limit(1).count():
        return kept
    single = kept.join(twice, same, "left_anti")
    return single.unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
