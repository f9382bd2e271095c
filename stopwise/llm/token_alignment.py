"""Two tokenizers' tokens of the same bytes, aligned by diagonal run skipping.

Tokens are known by the byte offsets at which they end. While the two arrays of
ends agree at one index shift, tokens stand one to one: stretches of them are
jumped by comparing slices of doubling width, then of halving width to find where
the stretch stops. There the tokens up to the next common end form an irregular
group; it is resolved end by end and the shift updated.

Corpus-wide counts of linked id pairs come back to the documents by chunk: a task
lists the distinct pairs of some MB of text once, and of every document which of
them it has how often. The lists are summed and joined, never the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import local_bytes, pick, stored, text_slices, texts_of, worker_store
from stopwise.llm.plain_bpe import ByteLevelIds

_SPACE = "▁"  # fixed value: the sign for a space in pieces
_WIDTH = 4  # bytes of an end
CHUNK_BYTES = 16_000_000  # text of the documents whose pairs are listed together
_BLOCK = 100_000  # groups that are written out at a time
_B_BITS = 32  # a pair's code: its a id above these bits, its b id in them


class Tokens:
    """Ids and token bytes of the two tokenizers; ``a`` is a byte-level BPE file, ``b``
    a sentencepiece model that puts a space before the text."""

    def __init__(self, a: bytes, b: bytes):
        self.a = ByteLevelIds(a, added=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [self.a.token.get(i, b"") for i in range(max(self.a.token) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.width_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.width_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(_SPACE, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for every text; none if the text is empty or if its tokens'
        bytes are not those of the text after a space."""
        none = np.empty(0, np.int64)
        for text, ids_b in zip(texts, self.b.encode(texts, out_type="numpy", num_threads=1), strict=True):
            spaced = " " + text
            ids_a, raw = self.a.encode(spaced).astype(np.int64), spaced.encode()
            own = b"".join(map(self.bytes_a.__getitem__, ids_a.tolist()))
            if not text or own != raw or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != raw:
                yield none, none
            else:
                yield ids_a, ids_b.astype(np.int64)


class Alignment:
    """Groups and links of one text's tokens.

    ``last_a`` and ``last_b`` mark the tokens that end a group; token ``link_a[i]``
    overlaps token ``link_b[i]``, every overlapping pair being there once.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        linked_a, linked_b, inside_a, inside_b = _irregular(ends_a, ends_b)
        self.last_a, self.last_b = np.ones(len(ends_a), bool), np.ones(len(ends_b), bool)
        alone_a, alone_b = self.last_a.copy(), self.last_b.copy()
        self.last_a[inside_a] = self.last_b[inside_b] = False
        alone_a[linked_a] = alone_b[linked_b] = False
        self.link_a = np.concatenate([np.flatnonzero(alone_a), np.array(linked_a, np.int64)])
        self.link_b = np.concatenate([np.flatnonzero(alone_b), np.array(linked_b, np.int64)])
        self.groups = int(self.last_a.sum())


def _irregular(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Where two arrays of rising ends, which finish alike, are not one to one: the
    links of irregular groups as two lists of token numbers, and the tokens of
    either side that end inside a group. All other tokens are one to one, in order."""
    raw_a, raw_b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    linked_a: list[int] = []
    linked_b: list[int] = []
    inside_a: list[int] = []
    inside_b: list[int] = []
    place, finish = 0, len(raw_a)  # bytes into raw_a
    shift = 0  # bytes that b is ahead
    while place < finish:
        width = _WIDTH
        while raw_a[place : place + width] == raw_b[place + shift : place + shift + width]:
            place += width
            if place >= finish:
                return linked_a, linked_b, inside_a, inside_b
            width *= 2
        while width > _WIDTH:
            width //= 2
            if raw_a[place : place + width] == raw_b[place + shift : place + shift + width]:
                place += width
        one, two = place // _WIDTH, (place + shift) // _WIDTH
        end_a, end_b = list_a[one], list_b[two]
        while end_a != end_b:
            linked_a.append(one)
            linked_b.append(two)
            if end_a < end_b:
                inside_a.append(one)
                one += 1
                end_a = list_a[one]
            else:
                inside_b.append(two)
                two += 1
                end_b = list_b[two]
        linked_a.append(one)
        linked_b.append(two)
        place, shift = _WIDTH * (one + 1), _WIDTH * (two - one)
    return linked_a, linked_b, inside_a, inside_b


class GroupText:
    """Groups written as ``a1,a2|b1;a3|b2,b3``, decimal ids in order."""

    def __init__(self, largest: int):
        numbers = np.arange(largest + 1)
        width = len(str(largest))
        powers = 10 ** np.arange(width)[::-1]
        self.digits = np.zeros((largest + 1, width + 1), np.uint8)
        self.digits[:, :width] = numbers[:, None] // powers % 10 + ord("0")
        self.length = np.maximum(1, (numbers[:, None] >= powers).sum(axis=1))
        # The first digit to the left edge; the place after the last takes the sign.
        place = np.arange(width + 1)
        shifted = np.minimum(place + (width - self.length)[:, None], width)
        self.digits = np.take_along_axis(self.digits, shifted, axis=1)
        self.place = place

    def _block(self, ids_a, ids_b, last_a, last_b) -> bytes:
        """Whole groups, each with the sign that follows it."""
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate([[0], ends_b])  # tokens of b before each group
        at_a, at_b = np.arange(len(ids_a)) + before[group_a], np.arange(len(ids_b)) + ends_a[group_b]
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        sign[at_a], sign[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        written, length = self.digits[ids], self.length[ids]
        written[np.arange(len(ids)), length] = sign
        return written[self.place <= length[:, None]].tobytes()

    def blocks(self, ids_a: np.ndarray, ids_b: np.ndarray, aligned: Alignment) -> Iterator[bytes]:
        """The text of all groups, in parts."""
        ends_a, ends_b = np.flatnonzero(aligned.last_a) + 1, np.flatnonzero(aligned.last_b) + 1
        from_a = from_b = 0
        for first in range(0, aligned.groups, _BLOCK):
            last = min(first + _BLOCK, aligned.groups)
            to_a, to_b = ends_a[last - 1], ends_b[last - 1]
            one, two = slice(from_a, to_a), slice(from_b, to_b)
            part = self._block(ids_a[one], ids_b[two], aligned.last_a[one], aligned.last_b[two])
            yield part if last < aligned.groups else part[:-1]
            from_a, from_b = to_a, to_b

    def sha256(self, ids_a: np.ndarray, ids_b: np.ndarray, aligned: Alignment) -> str:
        """Of that text, in hexadecimal; empty without tokens."""
        if not aligned.groups:
            return ""
        digest = hashlib.sha256()
        for part in self.blocks(ids_a, ids_b, aligned):
            digest.update(part)
        return digest.hexdigest()


def _tokens(content_a: bytes, content_b: bytes) -> tuple[Tokens, GroupText]:
    store = worker_store("token_alignment")
    key = hash((content_a, content_b))
    if store.get("key") != key:
        store.clear()
        tokens = Tokens(content_a, content_b)
        store.update(key=key, tokens=tokens, text=GroupText(max(len(tokens.bytes_a), len(tokens.bytes_b)) - 1))
    return store["tokens"], store["text"]


def align_tokens(
    df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, ids_a, ids_b, groups_a, groups_b`` of every row over its whole text: the
    ids of both tokenizers and how many of each side's tokens every group has.

    Null and empty texts, and such whose tokens' bytes are not the text after a
    space, have empty lists. Rows are independent: repeated rows and null keys stay.
    """
    content = df.sparkSession.sparkContext.broadcast((local_bytes(path_a), local_bytes(path_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _tokens(*content.value)
        for batch in batches:
            for part in text_slices(batch, 1):
                lists = [[], [], [], []]
                for ids_a, ids_b in tokens.encode(texts_of(part, 1)):
                    aligned = Alignment(np.cumsum(tokens.width_a[ids_a]), np.cumsum(tokens.width_b[ids_b]))
                    sizes = [np.diff(np.flatnonzero(last), prepend=-1) for last in (aligned.last_a, aligned.last_b)]
                    for held, values in zip(lists, (ids_a, ids_b, *sizes), strict=True):
                        held.append(values.astype(np.int32))
                arrays = [pa.array(held, pa.list_(pa.int32())) for held in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["key", *_LISTS])

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{n} array<int>" for n in _LISTS)
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


_LISTS = ("ids_a", "ids_b", "groups_a", "groups_b")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _Chunk:
    """Documents until their pairs are listed together."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.keys: list[pa.Array] = []
        self.counts: list[tuple[int, int, int, int]] = []
        self.digests: list[str] = []
        self.codes: list[np.ndarray] = []  # each document's distinct pairs
        self.times: list[np.ndarray] = []  # and how often it has them

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The documents' rows, then one with the pairs."""
        codes, places = np.unique(np.concatenate(self.codes), return_inverse=True)
        times = np.concatenate(self.times)
        totals = np.bincount(places, weights=times, minlength=len(codes)).astype(np.int64)
        cuts = np.cumsum([len(c) for c in self.codes])[:-1]
        split = [np.split(places.astype("<i4"), cuts), np.split(times.astype("<i4"), cuts)]
        n = len(self.counts)
        values = [
            pa.array([self.number] * n, pa.int64()),
            pa.concat_arrays(self.keys),
            *(pa.array(c, pa.int64()) for c in zip(*self.counts)),
            pa.array(self.digests, pa.string()),
            *(pa.array([p.tobytes() for p in parts], pa.binary()) for parts in split),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(values, names=names)
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (codes, totals)]
        empty = [pa.nulls(1, v.type) for v in values[1:-2]]
        yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *empty, *lists], names=names)


def _chunks(df: DataFrame, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: documents with their pairs by place in the chunk's list, and
    the chunks' lists (``codes``, ``totals``)."""
    content = df.sparkSession.sparkContext.broadcast((local_bytes(path_a), local_bytes(path_b)))
    kind = df.schema["key"].dataType.simpleString()
    fields = [f"{c} long" for c in _COUNTS]
    schema = ["chunk long", f"key {kind}", *fields, "groups_sha256 string", "places binary", "times binary"]
    schema += ["codes array<long>", "totals array<long>"]
    names = [f.split()[0] for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, written = _tokens(*content.value)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for part in text_slices(batch, 1, 1_000_000):
                chunk.keys.append(part.column(0))
                chunk.bytes += part.column(1).nbytes
                for ids_a, ids_b in tokens.encode(texts_of(part, 1)):
                    aligned = Alignment(np.cumsum(tokens.width_a[ids_a]), np.cumsum(tokens.width_b[ids_b]))
                    linked = (ids_a[aligned.link_a] << _B_BITS) | ids_b[aligned.link_b]
                    codes, times = np.unique(linked, return_counts=True)
                    chunk.codes.append(codes)
                    chunk.times.append(times)
                    chunk.counts.append((len(ids_a), len(ids_b), aligned.groups, len(linked)))
                    chunk.digests.append(written.sha256(ids_a, ids_b, aligned))
                if chunk.bytes > chunk_bytes:
                    yield from chunk.rows(names)
                    number += 1
                    chunk = _Chunk(number)
        if chunk.counts:
            yield from chunk.rows(names)

    return stored(df.mapInArrow(run, ", ".join(schema)))


def link_statistics(
    df: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Of every row ``key, n_a, n_b, n_groups, n_links, n_best, count_sum`` and
    ``groups_sha256``.

    A link is an overlapping pair of tokens, an id pair's count the number of links
    of all rows that have it. ``n_best`` counts the links whose pair has the
    highest count of its b id, ties included; ``count_sum`` sums the counts over
    the row's links. Rows without tokens (see ``align_tokens``) have zeros and an
    empty digest; every row counts by itself, repeated ones too. No rows give none.

    The alignments are made once and written as distinct pairs of each document;
    the rest is joins of the chunks' lists, which a pair's frequency does not skew:
    a chunk has it once.
    """
    chunks = _chunks(pick(df, key=key, text=text), path_a, path_b, chunk_bytes)
    listed = chunks.filter("codes is not null").select(
        F.col("chunk").alias("list"), F.posexplode(F.arrays_zip("codes", "totals")).alias("place", "pair")
    )
    pairs = listed.select("list", "place", F.col("pair.codes").alias("code"), F.col("pair.totals").alias("links"))
    counts = pairs.groupBy("code").agg(F.sum("links").alias("count"))
    counts = stored(counts.withColumn("b", F.col("code").bitwiseAND((1 << _B_BITS) - 1)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "b").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = pairs.join(judged, "code").select("list", "place", "count", "best")
    documents = chunks.filter("codes is null").drop("codes", "totals")

    def look_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        sums, bests = [], []
        for places, times in zip(rows.column("places"), rows.column("times"), strict=True):
            at, often = (np.frombuffer(v.as_buffer(), "<i4") for v in (places, times))
            sums.append(int(count[at] @ often.astype(np.int64)))
            bests.append(int(often[best[at]].sum()))
        kept = rows.select(["key", *_COUNTS, "groups_sha256"])
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    kind = documents.schema["key"].dataType.simpleString()
    fields = [f"key {kind}", *(f"{c} long" for c in _COUNTS), "groups_sha256 string", "n_best long", "count_sum long"]
    looked_up = documents.groupBy("chunk").cogroup(known.groupBy("list")).applyInArrow(look_up, ", ".join(fields))
    order = ["key", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    return looked_up.select(*order).withColumnRenamed("key", key)
