"""Packing whole documents by hierarchical best fit.

Documents are tokenized; only such as exceed a sequence are cut. The pieces are
dealt into groups of a bounded number, and every group is packed by itself: best
fit, longest pieces first. Its nearly full bins are final. Its emptiest ones, a
bounded share, rise as items to the next level, where those of several groups meet
and are packed by best fit again, and so on up a tree until one group is left. So no
task ever holds more than a bounded number of items, and an underfull bin meets
ever more distant ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import local_bytes, pick, stored, text_slices, texts_of, worker_store
from stopwise.llm.plain_bpe import ByteLevelIds

CAPACITY = 2048
GROUP_ITEMS = 8_192  # items that one task packs at a time, about
FAN_IN = 16  # groups of one level that meet in one of the next
NEARLY_FULL = 0.98  # bins from this share of the capacity on never rise

# A bin's number: its group above these bits; a sequence's: its level above those.
_GROUP_SHIFT, _LEVEL_SHIFT = 24, 56
_BIN = "bin long, offset long, fill long, rises boolean"
_BIN_NAMES = ["bin", "offset", "fill", "rises"]


def spans_of(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else pieces of full
    length after a first one that takes the rest."""
    first = tokens % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def token_pieces(
    df: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
) -> DataFrame:
    """Every document's pieces: ``key, piece, start, length, ids`` (binary,
    little-endian unsigned 32-bit).

    The ids are the tokenizer file's, without special tokens added, then ``end_id``;
    the strings of added tokens in a text become their ids. Null and empty text are
    the one id ``end_id``. Rows are independent: repeated rows and null keys stay.
    """
    content = df.sparkSession.sparkContext.broadcast(local_bytes(tokenizer_path))
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("residual_packing")
        if store.get("key") != hash(content.value):
            store.clear()
            store.update(key=hash(content.value), ids=ByteLevelIds(content.value))
        encode = store["ids"].encode
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, pieces, starts, lengths, binary = [], [], [], [], []
                for row, text_ in enumerate(texts_of(part, 1)):
                    ids = np.concatenate([encode(text_), end]).astype("<u4", copy=False).tobytes()
                    for piece, (start, length) in enumerate(spans_of(len(ids) // 4, capacity)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        binary.append(ids[4 * start : 4 * (start + length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int32())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(binary, pa.binary()),
                    ],
                    names=["key", "piece", "start", "length", "ids"],
                )

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids binary"
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item and what each bin holds: longest items first
    (ties: as they come), each into the fullest bin that still takes it (ties: the
    one that came to its fill last), else into a new one."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    held: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for place in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[place])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number = capacity, len(held)
            held.append(0)
        bins[place], offsets[place] = number, held[number]
        held[number] += length
        if room > length:
            by_room[room - length].append(number)
            rooms |= 1 << (room - length)
    return bins, offsets, held


def _packer(number: str, length: str, columns: list[str], capacity: int, rising: int):
    """Best fit over one group: every item with its ``bin``, its ``offset`` there, what
    the bin holds, and whether the bin rises: the ``rising`` emptiest of those that
    are not nearly full do."""

    def pack(items: pa.Table) -> pa.Table:
        items = items.sort_by(number)
        bins, offsets, held = best_fit(items.column(length).to_numpy(), capacity)
        fill = np.array(held, dtype=np.int64)
        emptiest = np.argsort(fill, kind="stable")[:rising]
        rises = np.zeros(len(fill), dtype=bool)
        rises[emptiest] = fill[emptiest] < NEARLY_FULL * capacity
        numbered = (items.column("group").to_numpy().astype(np.int64) << _GROUP_SHIFT) + bins
        found = items.select(columns)
        for name, values in zip(_BIN_NAMES, (numbered, offsets, fill[bins], rises[bins]), strict=True):
            found = found.append_column(name, pa.array(values))
        return found

    return pack


def assign(
    pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN
) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``, gapless in
    each sequence.

    The pieces are written once, as every row needs a number that stays; pass narrow
    rows. Full pieces are sequences by themselves. All others are dealt by a hash of
    their number into groups of about ``group_items``, so neither a key nor equal
    rows make a group large. Of a group at most a ``fan_in``-th of that number of bins
    rises and at most ``fan_in`` groups meet, so tasks are bounded alike on all
    levels and each level has a ``fan_in``-th of the groups below it. Every level is
    a written table. No rows give no rows.
    """
    names = pieces.columns
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    loose = rows.filter(~full)
    groups = max(1, -(-loose.count() // group_items))
    rising = max(1, group_items // fan_in)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = loose.withColumn("group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    pack = _packer("_row", "length", names, capacity, rising)
    leaves = stored(dealt.groupBy("group").applyInArrow(pack, f"{kinds}, {_BIN}"))

    pack = _packer("child", "amount", ["child"], capacity, rising)
    levels, level = [], leaves
    while groups > 1:
        groups = -(-groups // fan_in)
        risen = level.filter("rises and offset = 0").select(F.col("bin").alias("child"), F.col("fill").alias("amount"))
        # The group below is in the upper bits of its bins' numbers.
        met = risen.withColumn("group", F.pmod(F.shiftright("child", _GROUP_SHIFT), F.lit(groups)))
        level = stored(met.groupBy("group").applyInArrow(pack, f"child long, {_BIN}"))
        levels.append(level)

    placed = None  # where the bins that rose to a level lie in the end
    for number, level in reversed([*enumerate(levels, start=1)]):
        placed = _settled(level, ["child"], number, placed).withColumnsRenamed({"child": "bin"})
    alone = rows.filter(full).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return _settled(leaves, names, 0, placed).unionByName(alone)


def _settled(level: DataFrame, names: list[str], number: int, placed: DataFrame | None) -> DataFrame:
    """The items of a level with their final sequence and offset; ``placed`` has
    those of its bins that rose."""
    own = level.withColumn("sequence_id", F.col("bin") + (number << _LEVEL_SHIFT))
    if placed is None:
        return own.select(*names, "sequence_id", "offset")
    above = placed.select("bin", F.col("sequence_id").alias("_sequence"), F.col("offset").alias("_shift"))
    risen = own.filter("rises").join(above, "bin")
    risen = risen.select(*names, F.col("_sequence").alias("sequence_id"), (F.col("offset") + F.col("_shift")).alias("offset"))
    return own.filter("not rises").select(*names, "sequence_id", "offset").unionByName(risen)


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Documents to sequences: ``key, piece, start, length, ids, sequence_id, offset``."""
    return assign(token_pieces(df, tokenizer_path, key, text, end_id=end_id))
