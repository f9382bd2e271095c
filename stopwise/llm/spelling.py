"""Spelling variants of a corpus' words by composing finite-state machines.

Words are near if one inserted, deleted or replaced code point makes one the other:
pairs that the vocabulary's acceptor, composed with the transducer of one edit and
with the acceptor again, accepts. The composed machine is enumerated in parts by
where it starts. Two near words of lengths m and m or m + 1 share their first m // 2
code points or their last m - m // 2, so every word joins the parts of both halves,
once as the shorter and once as the longer word; a part's words have what is fixed in
common and differ in the free code points between. The edit is placed where the
words first differ, so each pair is accepted in one part only. A part that is too
large, or whose words are long, is halved again in the same way.

In a task all parts make up one minimised acyclic acceptor with initial states of
each part, and states that two parts share are walked once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import pick, stored, text_slices

MIN_LENGTH, MIN_COUNT = 5, 3
PART_WORDS = 4_096  # a part with more words is halved if it can be
FREE_LENGTH = 32  # and one with more free code points
_RUN = re.compile("[a-zÀ-ÿ]+")  # of texts with A-Z lowered
_HELD_WORDS, _HELD_TEXT = 200_000, 32_000_000  # a task passes on what it counted in so many words or bytes of text
_HELD_PAIRS = 200_000  # state pairs that are remembered


def count_words(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    slip_every: int | None = None,
) -> DataFrame:
    """``word`` and ``n`` (long): how often each run of letters occurs in all texts.

    Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z are lowered and nothing else.
    Words with fewer than ``min_length`` code points or ``min_count`` occurrences
    are left out. Null and empty texts have none, repeated rows count each time.

    ``slip_every`` plants spelling slips: of a run whose hash with its row's key,
    the CRC-32 of ``key:run``, is a multiple, one code point is left out, the one
    at that hash modulo the length. A null key is empty text there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        read = 0

        def passed_on() -> pa.RecordBatch:
            words, n = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for batch in batches:
            for part in text_slices(batch, 1):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not value:
                        continue
                    found = _RUN.findall(value.encode().lower().decode())  # bytes lower A-Z only
                    if slip_every is None:
                        counts.update(found)
                        continue
                    before = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for word, n in Counter(found).items():
                        drawn = zlib.crc32(word.encode(), before)
                        if drawn % slip_every == 0:
                            place = drawn % len(word)
                            word = word[:place] + word[place + 1 :]
                        counts[word] += n
                read += part.column(1).nbytes
                if len(counts) > _HELD_WORDS or read > _HELD_TEXT:
                    read = 0
                    yield passed_on()
        yield passed_on()

    counted = pick(df, key=key, text=text).mapInArrow(run, "word string, n long")
    long_enough = F.char_length("word") >= min_length
    totals = counted.filter(long_enough).groupBy("word").agg(F.sum("n").alias("n"))
    return totals.filter(F.col("n") >= min_count)


class Acceptor:
    """A minimised acyclic acceptor that takes in word lists one after the other.

    Each list gets an initial state; states of equal futures are one, whichever
    lists they come from. The words of a list have one length, so all that a state
    still accepts has one length too.
    """

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        self.futures: dict[int, list[str]] = {}
        self.common: dict[tuple[int, int], list[str]] = {}

    def add(self, words: list[str]) -> int | None:
        """The initial state of a sorted list of distinct words, None for none."""
        return self._state(words, 0, len(words), 0) if words else None

    def _state(self, words: list[str], low: int, high: int, depth: int) -> int:
        arcs = []
        while low < high and depth < len(words[low]):
            letter, end = words[low][depth], low + 1
            while end < high and words[end][depth] == letter:
                end += 1
            arcs.append((letter, self._state(words, low, end, depth + 1)))
            low = end
        own = tuple(arcs)
        number = self.states.get(own)
        if number is None:
            number = self.states[own] = len(self.arcs)
            self.arcs.append(own)
        return number

    def all_from(self, state: int) -> list[str]:
        """What the state accepts."""
        found = self.futures.get(state)
        if found is None:
            arcs = self.arcs[state]
            found = [letter + rest for letter, after in arcs for rest in self.all_from(after)] if arcs else [""]
            self.futures[state] = found
        return found

    def accepted_by_both(self, one: int, two: int) -> list[str]:
        """What both states accept: the product of the two."""
        if one == two:
            return self.all_from(one)
        pair = (one, two) if one < two else (two, one)
        found = self.common.get(pair)
        if found is None:
            left, right = self.arcs[one], dict(self.arcs[two])
            found = [
                letter + rest
                for letter, after in left
                if letter in right
                for rest in self.accepted_by_both(after, right[letter])
            ]
            self.common[pair] = found
        return found

    def one_edit(self, short: int | None, long: int | None, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs that one edit at their first difference makes alike: two words of
        the state ``short``, or one of it and one of ``long``, whose words have a
        code point more. ``at_end`` allows that one to come after all others."""
        if short is None:
            return
        todo = [("", short, long)]
        while todo:
            shared, one, more = todo.pop()
            arcs = self.arcs[one]
            for place, (letter, after) in enumerate(arcs):
                for other, other_after in arcs[:place]:
                    for rest in self.accepted_by_both(after, other_after):
                        yield shared + other + rest, shared + letter + rest
            longer = self.arcs[more] if more is not None else ()
            for letter, after in longer:
                for rest in self.accepted_by_both(one, after):
                    if rest[0] != letter if rest else at_end:
                        yield shared + rest, shared + letter + rest
            following = dict(longer)
            todo.extend((shared + letter, after, following.get(letter)) for letter, after in arcs)


def _pairs_of_part(
    acceptor: Acceptor, words: list[str], length: int, head: int, tail: int
) -> Iterator[tuple[int, int]]:
    """Places in ``words`` of the near pairs of a part: words of ``length`` or one
    more, of which the first ``head`` and last ``tail`` code points are fixed."""
    # Parts are told apart by a hash; what is fixed must really be equal.
    alike: dict[tuple[str, str], dict[str, int]] = {}
    for place, word in enumerate(words):
        end = len(word) - tail
        alike.setdefault((word[:head], word[end:]), {})[word[head:end]] = place
    free = length - head - tail
    for middles in alike.values():
        if len(middles) > 1:
            short = acceptor.add(sorted(m for m in middles if len(m) == free))
            long = acceptor.add(sorted(m for m in middles if len(m) > free))
            for one, two in acceptor.one_edit(short, long, at_end=tail == 0):
                yield middles[one], middles[two]


def _fixed(length: Column, head: Column, tail: Column) -> Column:
    """The part of a word, by what is fixed."""
    word, end = F.col("word"), F.char_length("word") - tail
    return F.xxhash64(length, head, tail, word.substr(F.lit(1), head), word.substr(end + 1, tail))


def _parts(vocabulary: DataFrame, part_words: int, free_length: int) -> Iterator[DataFrame]:
    """The words of every part of two or more: ``length, head, tail, part, words``
    (list of word and n), in one table a round of halving."""
    length = F.col("length")
    half = F.floor(length / 2).cast("int")
    sides = F.array(
        F.struct(half.alias("head"), F.lit(0).alias("tail")),
        F.struct(F.lit(0).alias("head"), (length - half).alias("tail")),
    )
    own = F.char_length("word")
    as_both = vocabulary.select("word", "n", F.explode(F.array(own, own - 1)).alias("length")).filter("length > 0")
    todo = as_both.select("*", F.inline(sides))
    while True:
        todo = todo.withColumn("part", _fixed(F.col("length"), F.col("head"), F.col("tail")))
        named = ["length", "head", "tail", "part"]
        free = F.col("length") - F.col("head") - F.col("tail")
        large = (F.col("size") > part_words) | ((free > free_length) & (F.col("size") > 1))
        sizes = todo.groupBy(*named).agg(F.count(F.lit(1)).alias("size"))
        # Written, so that the joins are planned from their size.
        halved = stored(sizes.filter(large & (free > 1)).select(*named))
        whole = todo.join(halved, named, "left_anti") if not halved.isEmpty() else todo
        collected = whole.groupBy(*named).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        yield collected.filter(F.size("words") > 1)
        if halved.isEmpty():
            return
        left = F.floor(free / 2).cast("int")
        again = F.array(
            F.struct((F.col("head") + left).alias("head"), F.col("tail").alias("tail")),
            F.struct(F.col("head").alias("head"), (F.col("tail") + free - left).alias("tail")),
        )
        rest = todo.join(halved, named, "left_semi")
        todo = stored(rest.select("word", "n", "length", F.inline(again)))


def _enumerated(vocabulary: DataFrame, each, schema: str, part_words: int, free_length: int) -> DataFrame:
    """``each(words, pairs)`` rows for every part, ``pairs`` being its near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor()
        for batch in batches:
            rows: list[tuple] = []
            for part in batch.to_pylist():
                if len(acceptor.common) + len(acceptor.arcs) > _HELD_PAIRS:
                    acceptor = Acceptor()
                words = [w["word"] for w in part["words"]]
                pairs = _pairs_of_part(acceptor, words, part["length"], part["head"], part["tail"])
                rows.extend(each(part["words"], pairs))
            columns = zip(*rows) if rows else [[] for _ in names]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [field.split()[0] for field in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[field.split()[1]] for field in schema.split(", ")]
    found = None
    for part in _parts(vocabulary, part_words, free_length):
        rows = part.select("length", "head", "tail", "words").mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def near_pairs(vocabulary: DataFrame, part_words: int = PART_WORDS, free_length: int = FREE_LENGTH) -> DataFrame:
    """All pairs of near words, each once: ``a`` and ``b``. ``vocabulary`` has distinct
    ``word`` and ``n``; null words are left out."""

    def each(words, pairs):
        return [(words[a]["word"], words[b]["word"]) for a, b in pairs]

    known = vocabulary.filter("word is not null").select("word", "n")
    return _enumerated(known, each, "a string, b string", part_words, free_length)


def near_summary(vocabulary: DataFrame, part_words: int = PART_WORDS, free_length: int = FREE_LENGTH) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest ``n`` (``best_n``, ``best``;
    ties: the first in code-point order) of every word that has a near one.

    Counted in the tasks, part by part, so pairs are not written.
    """

    def each(words, pairs):
        seen: dict[int, list] = {}
        for pair in pairs:
            for own, other in (pair, pair[::-1]):
                offer = (-words[other]["n"], words[other]["word"])
                entry = seen.get(own)
                if entry is None:
                    seen[own] = [1, offer]
                else:
                    entry[0] += 1
                    if offer < entry[1]:
                        entry[1] = offer
        return [(words[own]["word"], n, minus, word) for own, (n, (minus, word)) in seen.items()]

    known = vocabulary.filter("word is not null").select("word", "n")
    schema = "word string, n_near long, minus long, best string"
    by_part = _enumerated(known, each, schema, part_words, free_length)
    summed = by_part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "best")).alias("first"))
    return summed.select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words with a ``form``: where following forms ends.

    Every round follows twice as far as the one before. Forms grow in ``n`` by
    twice or more, so there are no circles and the rounds are few.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further, "root", "left")
        step = stored(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        reached = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return reached


def spelling_forms(vocabulary: DataFrame, ratio: int = 2, **limits: int) -> DataFrame:
    """Every word of ``vocabulary`` (distinct ``word``, and ``n``) with its more usual
    spelling: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point
    order), if that is at least ``ratio`` times the word's own, else null; ``root``
    is where following forms ends, the word itself without one; ``n_near`` counts
    near words. Words without near ones have zero and nulls. An empty vocabulary
    gives no rows. The vocabulary is written once, as are the near words.
    """
    words = stored(vocabulary.filter("word is not null").select("word", "n"))
    near = near_summary(words, **limits)
    usual = F.col("best_n") >= ratio * F.col("n")
    judged = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(usual, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(usual, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(judged.filter("form is not null"))
    found = judged.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
