"""Exact similarity join of word n-gram sets by rare-first prefixes.

In a global order of shingles, rare ones first, two sets of a Jaccard likeness of
``percent`` or more share a shingle of their prefixes. The work is done in steps
that each leave little to the next:

1. Texts of the same words are one class; all else is between classes.
2. A shingle that one class alone has comes first in the order and can't be
   shared. Counting over all classes tells how many a class has; one whose whole
   prefix consists of them has no partner. Shingles are counted as packed arrays,
   and what a task sees twice it settles itself, so a frequent shingle travels
   once per task.
3. The classes left are ordered exactly by frequency, and their prefixes give
   candidate pairs: in a few turns each class with the two it stands next to in most
   of its shingles' lists, then, with the linked ones joined, all that lie between
   different components. Length,
   position and suffix bounds come before the sets themselves are fetched, once a
   pair. So a group of thousands of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import give_back, pick, stored, text_slices, texts_of, worker_store
from stopwise.llm.components import connected_components

WORDS = 5
PERCENT = 80
_FLUSH = 1_000_000  # shingles a task gathers before it sends them
_BUCKET = 750_000  # shingles of a bucket, about
_SPACE = 1 << 40  # shingles are counted by the upper 40 bits of their hash
_KEPT_WORDS = 200_000
_PARTS = 32  # of the hash space, for the suffix bound
_SKETCH = 8  # words of 64 parities
_CHAIN = 5_000  # rows of one shingle's list that one chain takes
_TURNS = 4  # of neighbours, before all that is left
_SEED = 0x9E3779B97F4A7C15
_FACTORS = [np.uint64(pow(_SEED, 2 * i + 1, 1 << 64)) for i in range(64)]
_BROADCAST_ROWS = 1_000_000
_TOLD = -1  # in place of a bucket: counts that a task settled itself


class Shingler:
    """Hashed shingle sets; hashes of words are kept in a bounded table."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        value = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def words(self, text: str) -> list[bytes]:
        """Words between ASCII white space, A-Z in lower case."""
        return text.encode().lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """The sorted distinct 64-bit hashes of all n-word shingles; of all words
        together, if they are fewer."""
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        hashes = np.array([known.get(w) or self._hash(w) for w in words], dtype=np.uint64)
        width = min(self.n, len(words))
        size = len(words) - width + 1
        mixed = np.full(size, width, np.uint64)
        for step in range(width):
            mixed += hashes[step : step + size] * _FACTORS[step]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _FACTORS[-1]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def class_of(words: list[bytes]) -> int:
    """A signed 64-bit name of the word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def least_overlap(n: int, percent: int) -> int:
    """What a set must share with any partner: ``percent`` of it, rounded up."""
    return -(-n * percent // 100)


def _shingler(n: int) -> Shingler:
    return worker_store("shingler").setdefault(n, Shingler(n))


def _sets(batches: Iterator[pa.RecordBatch], n: int, column: int):
    shingler = _shingler(n)
    for batch in batches:
        for part in text_slices(batch, column):
            rows = []
            for text in texts_of(part, column):
                words = shingler.words(text)
                rows.append((class_of(words), shingler.shingles(words)))
            yield part, rows
    give_back()


def document_classes(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, class, places`` of every row; class null for texts without words. A text
    has a shingle at each of its ``places``, repeated ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(n)
        for batch in batches:
            for part in text_slices(batch, 1):
                split = [shingler.words(t) for t in texts_of(part, 1)]
                classes = pa.array([class_of(words) if words else None for words in split], pa.int64())
                places = pa.array([len(words) - min(n, len(words)) + 1 if words else 0 for words in split], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), classes, places], names=["key", "class", "places"])

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, class long, places long")


def with_class(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the ``class`` of each row's text: rows of equal words have equal
    ones, null for texts without words."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(WORDS)
        for batch in batches:
            for part in text_slices(batch, at):
                split = (shingler.words(t) for t in texts_of(part, at))
                classes = pa.array([class_of(words) if words else None for words in split], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, classes], names=[*part.schema.names, "class"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, class long")


def _pack(classes: np.ndarray, hashes: np.ndarray) -> bytes:
    """Classes (in runs) and upper 40 bits of hashes as bytes, 5 a hash."""
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    runs = np.diff(np.r_[starts, len(classes)])
    head = np.array([len(starts), len(hashes)], "<i8").tobytes()
    low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    high = (hashes >> np.uint64(32)).astype("u1").tobytes()
    return head + classes[starts].astype("<i8").tobytes() + runs.astype("<i4").tobytes() + low + high


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    runs, size = np.frombuffer(packed, "<i8", 2)
    at = 16
    classes = np.frombuffer(packed, "<i8", runs, at)
    at += 8 * runs
    lengths = np.frombuffer(packed, "<i4", runs, at)
    at += 4 * runs
    low = np.frombuffer(packed, "<u4", size, at).astype(np.uint64)
    high = np.frombuffer(packed, "u1", size, at + 4 * size).astype(np.uint64)
    return np.repeat(classes, lengths), (high << np.uint64(32)) | low


def _shared_counts(df: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """``class, n, shared``: how many shingles a class has, and how many of them other
    classes have too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushed = TaskContext.get().partitionId(), 0
        held: dict[int, np.ndarray] = {}
        sizes: dict[int, int] = {}  # shingles of a class; 40 bits don't tell all of them apart
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            classes = np.repeat(np.array(list(held), np.int64), [len(s) for s in held.values()])
            hashes = np.concatenate([np.zeros(0, np.uint64), *held.values()])
            order = np.argsort(hashes, kind="stable")
            hashes, classes = hashes[order], classes[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
            starts = np.flatnonzero(new)
            alone = np.diff(np.r_[starts, len(hashes)]) == 1
            # Shingles of several classes here are shared for certain: their
            # classes are told at once, the shingle itself is sent a single time.
            single = np.repeat(alone, np.diff(np.r_[starts, len(hashes)]))
            names, told = np.unique(classes[~single], return_counts=True)
            whole = np.array(list(sizes.values()), np.int64)
            lost = whole - [len(s) for s in held.values()]
            names, told = np.r_[names, np.array(list(sizes), np.int64)], np.r_[told, lost]
            whole = np.r_[np.zeros(len(names) - len(whole), np.int64), whole]
            flush_id = (task << 20) + flushed
            sent_hashes = np.concatenate([hashes[single], hashes[starts[~alone]]])
            # Class 0 stands for "shared already" and asks for no answer.
            sent_classes = np.concatenate([classes[single], np.zeros((~alone).sum(), np.int64)])
            bucket = (sent_hashes * np.uint64(buckets)) >> np.uint64(40)
            by = np.lexsort((sent_classes, bucket))
            bucket, sent_hashes, sent_classes = bucket[by], sent_hashes[by], sent_classes[by]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            ends = np.r_[edges[1:], len(bucket)].astype(int)
            out = [(_TOLD, flush_id, np.concatenate([names, told, whole]).astype("<i8").tobytes())]
            out += [
                (int(bucket[a]), flush_id, _pack(sent_classes[a:b], sent_hashes[a:b]))
                for a, b in zip(edges.tolist(), ends.tolist(), strict=True)
            ]
            for start in range(0, len(out), 64):
                columns = list(zip(*out[start : start + 64], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                    names=["bucket", "flush", "packed"],
                )

        for _, rows in _sets(batches, n, 0):
            for name, shingles in rows:
                if len(shingles) and name not in held:
                    held[name] = np.unique(shingles >> np.uint64(24))
                    size += len(shingles)
                    sizes[name] = len(shingles)
                if size >= _FLUSH:
                    yield from flush()
                    flushed += 1
                    held, sizes, size = {}, {}, 0
        if held:
            yield from flush()
        held, sizes = {}, {}
        give_back()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answer a bucket's questions; rows come sorted by bucket."""
        waiting: list[tuple[int, bytes]] = []
        current = None

        def answer() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            parts = [_unpack(packed) for _, packed in waiting]
            flushes = np.repeat(np.array([f for f, _ in waiting], np.int64), [len(h) for _, h in parts])
            classes = np.concatenate([c for c, _ in parts])
            hashes = np.concatenate([h for _, h in parts])
            order = np.argsort(hashes, kind="stable")
            hashes, classes, flushes = hashes[order], classes[order], flushes[order]
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            low, high = np.minimum.reduceat(classes, starts), np.maximum.reduceat(classes, starts)
            known = np.logical_or.reduceat(classes == 0, starts)
            shared = np.repeat((low != high) | known, np.diff(np.r_[starts, len(hashes)])) & (classes != 0)
            classes, flushes = classes[shared], flushes[shared]
            by = np.lexsort((flushes, classes))
            classes, flushes = classes[by], flushes[by]
            starts = np.flatnonzero(
                np.r_[True, (classes[1:] != classes[:-1]) | (flushes[1:] != flushes[:-1])][: len(classes)]
            )
            counts = np.diff(np.r_[starts, len(classes)])
            yield _dealt(classes[starts], flushes[starts], counts, np.zeros(len(counts), np.int64), buckets)

        for batch in batches:
            for bucket, flush, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket == _TOLD:
                    names, told, whole = np.frombuffer(packed, "<i8").reshape(3, -1)
                    yield _dealt(names, np.full(len(names), flush), told, whole, buckets)
                    continue
                if bucket != current:
                    yield from answer()
                    waiting, current = [], bucket
                waiting.append((flush, packed))
        yield from answer()
        waiting = []
        give_back()

    sent = pick(df, text=text).mapInArrow(send, "bucket int, flush long, packed binary")
    # Told counts have no bucket to meet in and are dealt by their flush.
    where = F.when(F.col("bucket") < 0, F.pmod("flush", F.lit(buckets))).otherwise(F.col("bucket"))
    met = sent.withColumn("to", where).repartition(buckets, "to").sortWithinPartitions("bucket")
    answered = met.select("bucket", "flush", "packed").mapInArrow(settle, "to int, packed binary")
    gathered = answered.repartition(buckets, "to").sortWithinPartitions("to")
    return gathered.mapInArrow(_summed, "class long, n long, shared long")


def _dealt(classes: np.ndarray, flushes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Counts and sizes (or 0) as packed arrays, a row for each part that some of the
    classes belong to."""
    to = (classes.astype(np.int64).view(np.uint64) % np.uint64(parts)).astype(np.int32)
    rows = np.stack([np.asarray(a, np.int64) for a in (classes, flushes, counts, sizes)])
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[:, order]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    ends = [*edges[1:].tolist(), len(to)]
    packed = [rows[:, a:b].tobytes() for a, b in zip(edges.tolist(), ends)] if len(to) else []
    return pa.RecordBatch.from_arrays([pa.array(to[edges], pa.int32()), pa.array(packed, pa.binary())], names=["to", "packed"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by class and flush. Every flush that holds a class comes to the same sum,
    so the class has the largest; its size was sent with the flush. Rows come sorted by
    part."""
    held, current = [], None

    def total() -> Iterator[pa.RecordBatch]:
        if held:
            classes, flushes, counts, sizes = np.concatenate(held, axis=1)
            order = np.lexsort((flushes, classes))
            classes, flushes, counts, sizes = (x[order] for x in (classes, flushes, counts, sizes))
            starts = np.flatnonzero(np.r_[True, (classes[1:] != classes[:-1]) | (flushes[1:] != flushes[:-1])])
            sums, sizes, classes = np.add.reduceat(counts, starts), np.maximum.reduceat(sizes, starts), classes[starts]
            starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
            columns = [classes[starts], np.maximum.reduceat(sizes, starts), np.maximum.reduceat(sums, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["class", "n", "shared"])

    for batch in batches:
        for to, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if to != current:
                yield from total()
                held, current = [], to
            held.append(np.frombuffer(packed, np.int64).reshape(4, -1))
    yield from total()
    held = []
    give_back()


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``64 * _SKETCH`` parts of the hash space a bit: whether the set has an
    odd number of shingles there. A shingle that only one of two sets has turns one bit
    of the two sketches' difference, so these differ in no more bits than the sets in
    shingles."""
    bits = np.uint64(64 * _SKETCH - 1)
    odd = np.bincount((shingles & bits).astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _class_sets(df: DataFrame, key: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """``class, n, hashes, parts, odd`` of the ``wanted`` classes (class, key of one document)."""
    docs = pick(df, key=key, text=text)
    keys = wanted.select(F.col("key").alias("wanted"))
    if wanted.count() <= _BROADCAST_ROWS:  # 16 bytes a row; else a shuffled join
        keys = F.broadcast(keys)
    found = docs.join(keys, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _sets(batches, n, 0):
            rows = [(c, s) for c, s in rows if len(s)]
            sizes = np.array([len(s) for _, s in rows], np.int64)
            values = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in rows)]).view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))
            classes = pa.array([c for c, _ in rows], pa.int64())
            shift = np.uint64(65 - _PARTS.bit_length())
            parts = [np.bincount((s >> shift).astype(np.int64), minlength=_PARTS) for _, s in rows]
            odd = [parities(s) for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [classes, pa.array(sizes), hashes, pa.array(parts, pa.list_(pa.int32())), pa.array(odd, pa.list_(pa.int64()))],
                names=["class", "n", "hashes", "parts", "odd"],
            )

    schema = "class long, n long, hashes array<long>, parts array<int>, odd array<long>"
    sets = found.select("text").mapInArrow(run, schema)
    # A key may stand for other texts too, and several keys for one class.
    return sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``hash, class, n, place, often``: the shared part of every class's prefix in
    the order of frequency."""
    each = sets.select("class", "n", F.explode("hashes").alias("hash"))
    often = each.groupBy("hash").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = (
        each.join(often, "hash")
        .groupBy("class", "n")
        .agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("shared"))
    )
    alone = F.col("n") - F.size("shared")
    least = F.expr(f"(n * {percent} + 99) div 100")
    reach = (F.col("n") - least + 1 - alone).cast("int")
    return (
        ranked.withColumns({"alone": alone, "reach": reach})
        .filter("reach > 0")
        .select("class", "n", "alone", F.posexplode(F.expr("slice(shared, 1, reach)")).alias("at", "s"))
        .select(F.col("s.hash").alias("hash"), "class", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("s.often").alias("often"))
    )


def _fits(percent: int) -> Column:
    """Length and position bounds of a meeting: if this is the first shingle in order
    that both share, what both sets have left from here on must reach the overlap
    that their sizes ask for. Every alike pair passes at its first one."""
    need = F.expr(f"((n_a + n_b) * {percent} + {99 + percent}) div {100 + percent}")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (left >= need)


def _close(percent: int) -> Column:
    """Whether two sketches of parities leave room for the overlap that the sizes ask
    for: what only one of the sets has is at least the bits in which they differ."""
    need = F.expr(f"((n_a + n_b) * {percent} + {99 + percent}) div {100 + percent}")
    bits = [F.bit_count(F.col(f"odd_{i}_a").bitwiseXOR(F.col(f"odd_{i}_b"))) for i in range(_SKETCH)]
    return reduce(add, bits) <= F.col("n_a") + F.col("n_b") - 2 * need


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike: first a bound from the counts by part of the
    hash space, then the sets themselves."""
    parts = sets.select("class", "n", "parts")
    a = parts.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("parts").alias("parts_a"))
    b = parts.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("parts").alias("parts_b"))
    bound = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    alike = lambda common: common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent
    likely = pairs.join(a, "a").join(b, "b").filter(alike(bound)).select("a", "b", "n_a", "n_b")
    hashes = sets.select("class", "hashes")
    fetched = likely.join(hashes.toDF("a", "hashes_a"), "a").join(hashes.toDF("b", "hashes_b"), "b")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return fetched.filter(alike(common)).select("a", "b")


def _neighbours(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of different components: each class with the two it stands next to
    in most of its shingles' lists. Lists are in the order of length at first, then in
    another mixed order each turn; long lists are several chains."""
    chain = F.pmod(F.xxhash64("class"), F.expr(f"often div {_CHAIN} + 1"))
    order = ["n", "class"] if turn == 0 else [F.xxhash64("class", F.lit(turn)), "class"]
    line = Window.partitionBy("hash", "chain").orderBy(*order)
    before = [F.lag(c).over(line).alias(f"{c}_b") for c in ("class", "n", "component")]
    near = postings.withColumn("chain", chain).select("class", "n", "component", *before)
    near = near.filter("component != component_b").filter(f"least(n, n_b) * 100 >= greatest(n, n_b) * {percent}")
    one = near.select(F.col("class").alias("c"), F.col("class_b").alias("d"))
    lists = one.unionByName(one.select(F.col("d").alias("c"), F.col("c").alias("d")))
    often = lists.groupBy("c", "d").agg(F.count("*").alias("lists"))
    best = Window.partitionBy("c").orderBy(F.desc("lists"), "d")
    chosen = often.withColumn("place", F.row_number().over(best)).filter("place <= 2")
    return chosen.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def _mixed(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """The postings, with components, of the lists that hold several of them."""
    named = postings.drop("component").join(joined, postings["class"] == joined["node"], "left")
    named = named.select(*postings.drop("component").columns, F.coalesce("component", "class").alias("component"))
    lists = named.groupBy("hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return named.join(lists.filter("lo < hi").select("hash"), "hash", "left_semi")


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of all classes that are linked to another, from
    ``sets`` (class, n, hashes, parts: their counts by part of the hash space, odd:
    their ``parities``)."""
    sets = stored(sets)
    postings = stored(_prefixes(sets, percent).withColumn("component", F.col("class")))
    joined = sets.sparkSession.createDataFrame([], "node long, component long")

    def with_stars(links: DataFrame) -> DataFrame:
        # A component's star stands for its links.
        stars = joined.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stars.unionByName(links)

    for turn in range(_TURNS):
        found = stored(_verified(_neighbours(postings, percent, turn), sets, percent))
        if found.isEmpty():
            break
        joined = stored(connected_components(with_stars(found)))
        postings = stored(_mixed(postings, joined))

    # What is left lies between different components.
    sketches = sets.select("class", *[F.col("odd")[i].alias(f"odd_{i}") for i in range(_SKETCH)])
    postings = stored(postings.join(sketches, "class"))

    def side(x: str) -> DataFrame:
        return postings.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in postings.columns if c not in ("hash", "often")])

    meet = (F.col("component_a") != F.col("component_b")) & (F.col("class_a") < F.col("class_b"))
    met = side("a").join(side("b"), "hash").filter(meet & _fits(percent) & _close(percent))
    others = met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    rest = stored(_verified(others, sets, percent))
    return joined if rest.isEmpty() else connected_components(with_stars(rest))


def similarity_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``key, class, n_shingles, component_id, component`` of every row.

    Two rows are linked if their sets of n-word shingles have a Jaccard likeness of
    ``percent`` hundredths or more; ``component_id`` is the smallest key reachable
    by links, the own one included (null if all are null). Words are what stands
    between ASCII white space, A-Z in lower case; fewer than n words are one
    shingle; rows without words (null, empty) are linked with nothing. Rows of equal
    words are always linked; rows of one key but different words only by likeness.
    ``component`` names the component itself, null without words.

    Equality of shingles is that of 64-bit hashes. An empty table gives no rows.
    """
    rows = stored(document_classes(df, key, text, n))
    named = rows.filter("class is not null").groupBy("class").agg(F.min("key").alias("key"), F.first("places").alias("places"))
    named = stored(named)
    total = named.agg(F.sum("places")).first()[0] or 0
    buckets = max(1, -(-total // _BUCKET))
    classes = stored(named.select("class", "key").join(_shared_counts(df, text, n, buckets), "class"))
    least = F.expr(f"(n * {percent} + 99) div 100")
    kept = classes.filter(F.col("shared") >= least).select("class", "key")
    linked = stored(link_classes(_class_sets(df, key, text, n, kept), percent))
    found = linked.join(classes.select("class", "key"), linked["node"] == F.col("class")).select(
        "class", "component", "key"
    )
    smallest = found.groupBy("component").agg(F.min("key").alias("component_id"))
    own = stored(
        found.join(smallest, "component").select("class", "component", F.col("component_id").alias("reached"))
    )
    named = rows.join(own, "class", "left").join(
        classes.select("class", F.col("key").alias("smallest"), "n"), "class", "left"
    )
    # Rows without words are reached from nowhere.
    component_id = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.coalesce("reached", "smallest"))
    return named.select(
        F.col("key").alias(key),
        "class",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        component_id.alias("component_id"),
        F.coalesce("component", "class").alias("component"),
    )
