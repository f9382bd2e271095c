"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic
programming carries the best score and the number of pieces to every position.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from stopwise.llm.common import pick, text_slices, texts_of, worker_store

SPACE = "▁"  # fixed value: the sign for a space
_UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character costs beyond the lowest score
_KEPT_WORDS = 400_000


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control and unknown pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not model.is_control(i) and not model.is_unknown(i)
    ]


class Lattice:
    """Best segmentation by summed piece scores, in double precision.

    Ties go to the path whose last piece starts first, at every position. A
    character that is no piece by itself may also be unknown, at the lowest
    score less a penalty; it counts as its UTF-8 bytes if the vocabulary has
    pieces for all bytes, else a run of unknowns counts as one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - _UNKNOWN_PENALTY
        self.has_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # Words can be cut before a space sign if no piece but runs of them holds one further in.
        inside = any(SPACE in p[1:] and p.strip(SPACE) for p in names) or any(
            SPACE in p and not p.startswith(SPACE) for p in names
        )
        self.cuts = SPACE in names and self.has_bytes and not inside
        ends = "" if any("\n" in p for p in names) else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|{ends}" if ends else ""))

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``."""
        n = len(word)
        score, start = [0.0] + [None] * n, [0] * (n + 1)
        single = [False] * (n + 1)
        matches: list[tuple[int, int, float]] = [(end + 1, *found) for end, found in self.automaton.iter(word)]
        at, total = 0, len(matches)
        unknown = self.unknown
        for end in range(1, n + 1):
            best, begin, alone = None, 0, False
            while at < total and matches[at][0] == end:
                _, length, own = matches[at]
                at += 1
                alone |= length == 1
                reached = score[end - length] + own
                if best is None or reached > best or (reached == best and end - length < begin):
                    best, begin = reached, end - length
            if not alone:
                reached = score[end - 1] + unknown
                if best is None or reached > best:
                    best, begin, single[end] = reached, end - 1, True
            score[end], start[end] = best, begin
        pieces, end, in_run = 0, n, False
        while end:
            if single[end] and start[end] == end - 1:
                pieces += len(word[end - 1].encode()) if self.has_bytes else not in_run
                in_run = True
            else:
                pieces += 1
                in_run = False
            end = start[end]
        return pieces

    def count_text(self, text: str, known: dict[str, int]) -> int:
        """Pieces of a whole text: a space sign goes before it and for every space."""
        if not text:
            return 0
        line = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.count(line)
        total = 0
        for word in self.words.findall(line):
            pieces = known.get(word)
            if pieces is None:
                pieces = self.count(word)
                if len(word) <= 64:
                    if len(known) >= _KEPT_WORDS:
                        known.clear()
                    known[word] = pieces
            total += pieces
        return total


def count_tokens(
    df: DataFrame, pieces: list[tuple[str, float]], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and ``n_tokens`` (long) of every row over its whole text.

    Equal to the number of ids that a unigram tokenizer with these pieces, byte
    fallback and spaces replaced (one sign before the text) gives. Null and empty
    text count 0. Rows are independent; one pass without a shuffle. Counts of
    words are kept in a bounded table of the worker.
    """
    content = df.sparkSession.sparkContext.broadcast(pickle.dumps(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("unigram")
        if store.get("key") != hash(content.value):
            store.clear()
            store.update(key=hash(content.value), lattice=Lattice(pickle.loads(content.value)), known={})
        lattice, known = store["lattice"], store["known"]
        for batch in batches:
            for part in text_slices(batch, 1):
                counts = [lattice.count_text(t, known) for t in texts_of(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["key", "n"])

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, n long").toDF(key, "n_tokens")
