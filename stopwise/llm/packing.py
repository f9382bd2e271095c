"""Packing of documents into windows by multiway differencing.

Documents are tokenized and cut into pieces; pieces are dealt into bins of a
bounded number of tokens, and every bin is partitioned by Karmarkar-Karp: the
two partial partitions with the largest imbalance are merged so that the largest
window of one meets the smallest of the other, until one partition is left. If
its largest window exceeds the capacity, the bin is partitioned anew into one
window more.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stopwise.llm.byte_bpe import byte_letters
from stopwise.llm.common import local_bytes, pick, stored, text_slices, texts_of, worker_store

CAPACITY = 2048
PIECE = 512
BIN_TOKENS = 256 * CAPACITY
_SUFFIX = "</w>"
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
# Composed characters of one lower-case letter each; the marks are neither letters nor numbers.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0400-\u045f\u4e00-\u9fa5"
_UNCERTAIN = re.compile(f"[^\\t-\\r -~\u00a1\u00ab\u00bf\u2013\u2014\u2018-\u201e\u2026{_LETTERS}]")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r 0-9{_LETTERS}]+")
_END = np.array([1], dtype="<u4").tobytes()


class WordIds:
    """Ids of texts whose tokens never span white space.

    A file with the splitting of ``_NORMALIZER`` and ``_SPLIT`` and with tokens numbered
    in the order of their merges is put into a compiled encoder that ranks merges by token
    number; the end of a piece is a space there, which no piece holds. Words with
    characters whose lower case, composed form or kind is not certain, and those that
    hold an added token, go to the tokenizer library, as do all texts of other files.
    Nothing is remembered of the texts, so memory does not grow with the words.
    """

    def __init__(self, content: bytes):
        self.content = content
        file = json.loads(content)
        self.added = [t["content"] for t in file["added_tokens"]]
        self.fast = _end_marked(file)

    @cached_property
    def library(self) -> Tokenizer:
        tokenizer = Tokenizer.from_buffer(self.content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if self._plain(text):
            return self._by_rank(text)
        if self.fast is None:
            return self._by_library(text)
        runs = groupby((w.decode() for w in text.encode().split()), self._plain)
        return b"".join((self._by_rank if plain else self._by_library)(" ".join(words)) for plain, words in runs)

    def _plain(self, text: str) -> bool:
        return self.fast is not None and not _UNCERTAIN.search(text) and not any(a in text for a in self.added)

    def _by_rank(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        if not pieces:
            return b""
        ids = self.fast.encode_to_numpy(" ".join(pieces) + " ", allowed_special=set(), disallowed_special=())
        return ids.astype("<u4", copy=False).tobytes()

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _end_marked(file: dict) -> tiktoken.Encoding | None:
    """An encoder of pieces that each end with a space; None for files it does not suit."""
    model = file["model"]
    plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": _SUFFIX}
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if file["normalizer"] != _NORMALIZER or steps[0] != _SPLIT or any(model[k] != v for k, v in plain.items()):
        return None
    if [{k: s.get(k) for k in _BYTES} for s in steps[1:]] != [_BYTES]:
        return None
    byte = {c: bytes([b]) for c, b in byte_letters().items()}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    vocabulary = model["vocab"]
    bare = [c + end for end in ("", _SUFFIX) for c in byte]
    made = [vocabulary.get(t, -1) for t in merges]
    first = [vocabulary.get(t, len(vocabulary)) for t in bare]
    if any(a >= b for a, b in zip(made, made[1:])) or max(first) >= min(made, default=len(vocabulary)):
        return None
    if any(b" " in map(byte.get, t) for t in merges):
        return None
    ranks = {}
    for token in [*bare, *merges]:
        name = token.removesuffix(_SUFFIX)
        ranks[b"".join(byte[c] for c in name) + b" " * (name != token)] = vocabulary[token]
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def spans_of(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole windows first, the rest
    in pieces of at most ``piece``."""
    whole = tokens // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [
        (s, min(piece, tokens - s)) for s in range(whole, tokens, piece)
    ]


def token_pieces(
    df: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
) -> DataFrame:
    """Every document's pieces: ``key, start, length, ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``.

    The ids are the tokenizer's, without special tokens, then id 1. The file must
    be one whose tokens never span ASCII white space and that drops it. Null and
    empty text are the one id 1. Rows are independent.
    """
    content = df.sparkSession.sparkContext.broadcast(local_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("word_ids")
        if store.get("key") != hash(content.value):
            store.clear()
            store.update(key=hash(content.value), words=WordIds(content.value))
        words = store["words"]
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, starts, lengths, pieces, totals = [], [], [], [], []
                for row, whole in enumerate(texts_of(part, 1)):
                    ids = words.encode(whole) + _END
                    for start, length in spans_of(len(ids) // 4, capacity, piece):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        pieces.append(ids[4 * start : 4 * (start + length)])
                        totals.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int32())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(pieces, pa.binary()),
                        pa.array(totals, pa.int64()),
                    ],
                    names=["key", "start", "length", "ids", "doc_tokens"],
                )

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long"
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Positions of ``lengths`` dealt into ``windows`` by multiway differencing."""
    heap: list = []
    for place, length in enumerate(lengths):
        # Only the windows that hold something are listed, smallest first.
        heapq.heappush(heap, (-length if windows > 1 else 0, place, [(length, [place])]))
    while len(heap) > 1:
        _, mark, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        free = max(0, windows - len(one))  # empty windows of the first partition
        merged = list(one)
        for place, (total, held) in enumerate(reversed(two)):  # its largest first
            if place < free:
                merged.append((total, held))
            else:
                own, kept = one[place - free]
                merged[place - free] = (own + total, kept + held)
        merged.sort(key=lambda w: w[0])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, mark, merged))
    return [held for _, held in heap[0][2]] if heap else []


def pack_bin(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: as few as differencing allows."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        dealt = difference(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in dealt):
            return dealt
        windows += 1


def assign(pieces: DataFrame, capacity: int = CAPACITY, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """``pieces`` (with ``start`` and ``length``) with ``sequence_id`` and ``offset``.

    Whole windows are sequences by themselves. All other pieces are dealt by a
    hash of their row number into bins of about ``bin_tokens`` tokens, so no key
    makes a bin large, and each bin is packed in one task. Offsets are gapless.
    The pieces are written once, as every row needs a number that stays; pass
    narrow rows. No rows give no rows.
    """
    marked = pieces.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(marked)
    full = F.col("length") == capacity
    total = rows.filter(~full).agg(F.sum("length")).first()[0] or 0
    bins = max(1, round(total / bin_tokens))
    names = pieces.columns

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row").reset_index(drop=True)
        dealt = pack_bin(frame["length"].tolist(), capacity)
        window, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        for number, held in enumerate(dealt):
            at = 0
            for place in sorted(held):
                window[place], offset[place] = number, at
                at += int(frame["length"].iat[place])
        sequence = frame["_bin"].to_numpy(np.int64) * (1 << 32) + window
        return pd.DataFrame({"_row": frame["_row"], "sequence_id": sequence, "offset": offset})

    loose = rows.filter(~full).select(
        "_row", "length", F.pmod(F.xxhash64("_row"), F.lit(bins)).alias("_bin")
    )
    packed = loose.groupBy("_bin").applyInPandas(pack, "_row long, sequence_id long, offset long")
    # Sequences of whole windows are numbered below zero by their row.
    alone = rows.filter(full).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.filter(~full).join(packed, "_row").select(*names, "sequence_id", "offset").unionByName(alone)


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to sequences: ``key, start, length, ids, doc_tokens, sequence_id, offset``."""
    return assign(token_pieces(df, tokenizer_path, key, text))
