"""Byte-level BPE by prefix states: encode and decode.

The encoding of a prefix is known from its last token alone: that token follows
the encoding of the rest. So for every prefix only the last token is kept, and
words that share a prefix share its states. The distinct words of a batch are
walked as a trie in depth-first order, which is their sorted order: a word starts
from the state stack it shares with the word before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stopwise.llm.common import local_bytes, pick, text_slices, texts_of, worker_store

# Fixed value: how byte-level BPE splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT = 400_000  # chunks, and words, that a worker remembers before it starts afresh
_KEPT_PAIRS = 2_000_000
_NEVER = 1 << 60
# A space between two characters that are none belongs to the word after it, so a
# text can be cut before it whatever stands around.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next
    free one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE tokenizer")
        if pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("prefix space, normalizer and ignore_merges are not supported")
        letters = byte_letters()
        ids = model["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[left + right]
            self.merge[ids[left], ids[right]] = (rank, whole)
            self.parts.setdefault(whole, (rank, ids[left], ids[right]))
        singles = {i: t for i, t in self.token.items() if len(t) == 1 or i in self.parts}
        self.of_bytes = {t: i for i, t in singles.items()}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.of_bytes.items():
            self.matcher.add_word(t.decode("latin-1"), (i, len(t)))
        self.matcher.make_automaton()
        self.added: dict[str, int] = {}
        for a in spec["added_tokens"]:
            if a["lstrip"] or a["rstrip"] or a["single_word"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[a["content"]] = a["id"]
            self.token[a["id"]] = a["content"].encode()
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.words = regex.compile(WORD_PATTERN)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of ``token``'s own making, each with the rank
        of the merge that takes it up."""
        spine, taken = [], _NEVER
        while True:
            spine.append((token, taken))
            made = self.parts.get(token)
            if made is None:
                return spine
            taken, token = made[0], made[side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two tokens: none joins parts
        that are both still there when its rank comes. Equal ranks go left first."""
        known = self.pairs.get((left, right))
        if known is None:
            known = True
            ends = self._spine(left, 2)
            for start, start_taken in self._spine(right, 1):
                for end, end_taken in ends:
                    met = self.merge.get((end, start))
                    if met and met[0] < end_taken and met[0] <= start_taken:
                        known = False
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of every distinct word."""
        pairs, may_follow, matches = self.pairs, self.may_follow, self.matcher.iter
        encoded: dict[bytes, bytes] = {}
        last: list[int] = []  # last[i]: last token of the prefix of i + 1 bytes
        size: list[int] = []  # its length
        before = ""
        for raw in sorted(words):
            word = raw.decode("latin-1")  # one character a byte
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared:], size[shared:]
            known = shared  # prefixes with a last token
            for end, (token, length) in matches(word):  # by end, the longest first
                if end < known:
                    continue
                if length <= end:
                    pair = last[end - length], token
                    follows = pairs.get(pair)
                    if not (may_follow(*pair) if follows is None else follows):
                        continue
                last.append(token)
                size.append(length)
                known = end + 1
            if known < len(word):
                raise ValueError(f"no token for {raw[: known + 1]!r}")
            ids, end = [], len(word)
            while end:
                ids.append(last[end - 1])
                end -= size[end - 1]
            encoded[raw] = np.array(ids[::-1], dtype="<i4").tobytes()
            before = word
        return encoded

    def words_of(self, text: str) -> list[str | int]:
        """The words of a text; added tokens as ids."""
        if self.added_pattern is None or not any(a in text for a in self.added):
            return self.words.findall(text)
        found: list = []
        for part in self.added_pattern.split(text):
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found.extend(self.words.findall(part))
        return found


class Encoder:
    """Ids of texts, remembering a bounded number of chunks and words.

    A chunk is what stands between two spaces, the one before it included. One
    that is empty or has white space at an end can't be taken by itself: it is
    kept as None, and its text is cut only where that is safe.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}

    def _spell(self, chunks: list[str]) -> list[bytes]:
        split = [self.vocabulary.words_of(c) for c in chunks]
        spelled = {w: w.encode() for words in split for w in words if isinstance(w, str)}
        fresh = {w for w in spelled.values() if w not in self.words}
        if len(self.words) + len(fresh) > _KEPT:
            self.words.clear()
            fresh = set(spelled.values())
        self.words.update(self.vocabulary.encode_words(list(fresh)))
        return [
            b"".join(self.words[spelled[w]] if isinstance(w, str) else np.array([w], "<i4").tobytes() for w in words)
            for words in split
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        split = [t.split(" ") for t in texts]
        heads = [parts.pop(0) for parts in split]
        firsts = self._spell(heads)
        fresh = set().union(*split).difference(self.chunks)
        if len(self.chunks) + len(fresh) > _KEPT:
            self.chunks.clear()
            fresh = set().union(*split)
        alone = [c for c in fresh if c and not c[0].isspace() and not c[-1].isspace()]
        self.chunks.update(dict.fromkeys(fresh))
        self.chunks.update(zip(alone, self._spell([" " + c for c in alone]), strict=True))
        look = self.chunks.__getitem__
        encoded = []
        for text, head, first, parts in zip(texts, heads, firsts, split, strict=True):
            ids = list(map(look, parts))
            if parts and (None in ids or head[-1:].isspace()):
                head, *rest = _CUT.split(text)
                ids = self._spell([head, *(" " + part for part in rest)])
                encoded.append(b"".join(ids))
            else:
                encoded.append(first + b"".join(ids))
        return encoded


def _encoder(content: bytes) -> Encoder:
    store = worker_store("byte_bpe")
    key = hash(content)
    if key not in store:
        store.clear()
        store[key] = Encoder(Vocabulary(content))
    return store[key]


def encode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, as the tokenizer file's own
    library encodes the whole text without special tokens added; the strings of
    added tokens in a text become their ids.

    Null and empty text have no ids. Rows are independent: repeated rows and null
    keys stay as they are. One pass without a shuffle; a worker holds a bounded
    number of words and a few MB of text at a time (a longer text alone).
    """
    content = df.sparkSession.sparkContext.broadcast(local_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = encoder.encode(texts_of(part, 1))
                offsets = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _texts(ids: list[np.ndarray], table: list[bytes]) -> list[str]:
    """What the ids stand for; bytes that are no UTF-8 become replacement characters."""
    return [b"".join(map(table.__getitem__, i.tolist())).decode("utf-8", "replace") for i in ids]


def _table(vocabulary: Vocabulary) -> list[bytes]:
    return [vocabulary.token.get(i, b"") for i in range(max(vocabulary.token) + 1)]


def encode_and_decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` as ``encode`` gives them, and ``decoded``, their text as ``decode``
    gives it, in one pass."""
    content = df.sparkSession.sparkContext.broadcast(local_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        table = _table(encoder.vocabulary)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = [np.frombuffer(i, "<i4") for i in encoder.encode(texts_of(part, 1))]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                decoded = pa.array(_texts(ids, table), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=["key", "ids", "decoded"])

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and their ``text``. Ids that the vocabulary lacks and null
    ids are passed over; bytes that are no UTF-8 become replacement characters.
    Null ids for a whole row give empty text."""
    content = df.sparkSession.sparkContext.broadcast(local_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(_encoder(content.value).vocabulary)
        for batch in batches:
            for part in text_slices(batch, 1):
                known = []
                for row in part.column(1):
                    numbers = np.empty(0, np.int32)
                    if row.values is not None:
                        numbers = row.values.drop_null().to_numpy(zero_copy_only=False)
                    known.append(numbers[(numbers >= 0) & (numbers < len(table))])
                texts = _texts(known, table)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["key", "ids", "text"]
                )

    picked = pick(df, key=key, ids=ids)
    kind = picked.schema["key"].dataType.simpleString()
    named = picked.mapInArrow(run, f"key {kind}, ids array<int>, text string")
    return named.withColumnRenamed("key", key)
