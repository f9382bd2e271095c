"""Secret scan: fixed rules, and automata inferred from what the rules label.

The credentials that the rules find in the corpus are the labelled examples. A
probabilistic automaton of each kind is inferred from a bounded sample of them
(``grammar``); ordinary text is described by the symbol pairs of the whole
corpus. Every run of credential characters as long as the shortest labelled one,
and what rules leave of a run, is then scored by its likelihood as a credential
against that of ordinary text and against how common runs of its length are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import pick, stored, text_slices, texts_of, worker_store
from stopwise.llm.grammar import SYMBOL, SYMBOLS, Automaton, symbols

# The rules.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}

FORMAT = "format"  # kind of the spans that the automata add
EXAMPLES = 1000
_HEX_RUN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % _LEAST["hex"])
_CREDENTIAL, _SIGNS = "[A-Za-z0-9+/_.=-]", "+/_.=-"
_PARTS = (re.compile(r"[^.]+"), re.compile("[^/=]+"))  # what a run is taken apart into
_LONGEST = 64  # lengths from here on are counted as one
_REMEMBERED = 100_000  # runs whose result a task keeps
_LEAST_ODDS = 0.5  # nats a character, whatever the examples say
_SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


def rule_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of every rule match, by start, then kind."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _LEAST["assign"]:
                found.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= _LEAST["access"]:
                found.append((m.start(), m.end(), "access", m[0]))
    # A run of hexadecimal digits of that length lies within a run of credential characters.
    for run in _HEX_RUN.finditer(text):
        for m in _HEX.finditer(run[0]):
            if len(m[0]) >= _LEAST["hex"]:
                found.append((run.start() + m.start(), run.start() + m.end(), "hex", m[0]))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Formats:
    """Automata by kind, the ordinary text's log shares of symbol pairs, thresholds.

    ``prior`` has for every kind and length (to ``_LONGEST``) the logarithm of how
    many ordinary runs of that length or more come on one labelled credential.
    """

    automata: dict[str, Automaton] = field(default_factory=dict)
    ordinary: np.ndarray | None = None
    least_odds: dict[str, float] = field(default_factory=dict)
    shortest: dict[str, int] = field(default_factory=dict)
    prior: dict[str, list[float]] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)  # first and last characters of the examples
    ends: set[str] = field(default_factory=set)
    _runs: dict[str, list[tuple[int, int, float]]] = field(default_factory=dict, repr=False)
    _scores: dict[tuple[int, ...], float | None] = field(default_factory=dict, repr=False)

    def odds(self, kind: str, string: list[int]) -> float:
        """Nats a character by which ``kind`` is likelier than ordinary text."""
        common = sum(self.ordinary[a, b] for a, b in zip([SYMBOLS, *string], string))
        return (self.automata[kind].log_likelihood(string) - common) / len(string)

    def score(self, run: str) -> float | None:
        """The best odds above its kind's threshold that also outweigh the prior, else None."""
        string = tuple(symbols(run))
        if string in self._scores:
            return self._scores[string]
        best = None
        for kind in self.automata:
            if len(run) >= self.shortest[kind]:
                odds = self.odds(kind, string)
                likely = odds >= self.least_odds[kind] and odds * len(run) >= self.prior[kind][min(len(run), _LONGEST)]
                if likely and (best is None or odds > best):
                    best = odds
        if len(run) <= _LONGEST:
            if len(self._scores) >= _REMEMBERED:
                self._scores.clear()
            self._scores[string] = best
        return best

    def found(self, run: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the credentials in a run."""
        known = self._runs.get(run)
        if known is None:
            known = self._search(run, 0)
            if len(run) <= _LONGEST:
                if len(self._runs) >= _REMEMBERED:
                    self._runs.clear()
                self._runs[run] = known
        return known

    def _search(self, run: str, level: int) -> list[tuple[int, int, float]]:
        """The run with or without the signs at its ends, whichever is likelier, but
        without those no example has there; if neither is a credential, those among
        its parts."""
        if len(run) < min(self.shortest.values()):
            return []
        first, last = len(run) - len(run.lstrip(_SIGNS)), len(run.rstrip(_SIGNS))
        starts = {first} | ({0} if run[0] in self.starts else set())
        stops = {last} | ({len(run)} if run[-1] in self.ends else set())
        ends = {(a, b) for a in starts for b in stops if a < b}
        scored = [(score, b - a, a, b) for a, b in ends if (score := self.score(run[a:b])) is not None]
        if scored:
            score, _, start, end = max(scored)
            return [(start, end, score)]
        if level == len(_PARTS):
            return []
        return [
            (m.start() + start, m.start() + end, score)
            for m in _PARTS[level].finditer(run)
            for start, end, score in self._search(m[0], level + 1)
        ]


_PAIR_CODE = np.full(256, SYMBOLS, np.int64)
for _letter, _symbol in SYMBOL.items():
    _PAIR_CODE[ord(_letter)] = _symbol


def _pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols; what is no credential character is the edge."""
    counts = np.zeros((SYMBOLS + 1) ** 2, np.int64)
    for text in texts:
        codes = _PAIR_CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        counts += np.bincount(codes[:-1] * (SYMBOLS + 1) + codes[1:], minlength=len(counts))
    return counts


def _without(text: str, spans: list[tuple]) -> str:
    """The ordinary part of a text: blanks in the place of the rules' spans, which are
    in order of their starts."""
    parts, at = [], 0
    for start, end, *_ in spans:
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join(parts) + text[at:]


_ORDINARY_RUN = re.compile("%s{%d,}" % (_CREDENTIAL, min(_LEAST.values())))


def _lengths(texts: list[str]) -> Counter[int]:
    """How many runs of credential characters have each length."""
    return Counter(min(len(run), _LONGEST) for text in texts for run in _ORDINARY_RUN.findall(text))


def learn_formats(df: DataFrame, text: str = "text", examples: int = EXAMPLES, alpha: float = 0.05) -> Formats:
    """Automata from the credentials that the rules label in ``df``.

    All texts are scanned and counted; the automata see at most ``examples``
    distinct credentials of a kind, those of the smallest hash, which bounds what
    reaches the driver; the shortest length is that of all of a kind. Repeated credentials are added up before the shuffle. A
    kind needs 20 examples; without any kind nothing is added to the rules.
    """

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("secret_scan")  # what another operator left in the worker goes
        for batch in batches:
            for part in text_slices(batch, 0):
                texts = texts_of(part, 0)
                spans = [rule_spans(t) for t in texts]
                found = [(kind, value) for some in spans for _, _, kind, value in some]
                ordinary = [_without(t, some) if some else t for t, some in zip(texts, spans, strict=True)]
                pairs, lengths = _pairs(ordinary), _lengths(ordinary)
                seen = np.flatnonzero(pairs)
                kinds = [k for k, _ in found] + ["pair"] * len(seen) + ["length"] * len(lengths)
                values = [v for _, v in found] + [str(s) for s in [*seen, *lengths]]
                counts = [1] * len(found) + pairs[seen].tolist() + list(lengths.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())],
                    names=["kind", "value", "n"],
                )

    harvested = pick(df, text=text).mapInArrow(harvest, "kind string, value string, n long")
    counted = stored(harvested.groupBy("kind", "value").agg(F.sum("n").alias("n")))

    pairs = np.full((SYMBOLS + 1, SYMBOLS + 1), 0.1)
    for row in counted.filter("kind = 'pair'").collect():  # at most (SYMBOLS + 1)^2 rows
        pairs[divmod(int(row["value"]), SYMBOLS + 1)] += row["n"]
    lengths = np.zeros(_LONGEST + 1)
    for row in counted.filter("kind = 'length'").collect():
        lengths[int(row["value"])] = row["n"]
    as_long = lengths[::-1].cumsum()[::-1]
    labelled = {
        row["kind"]: row
        for row in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.min(F.length("value")).alias("shortest")).collect()
    }
    # An ordinary word's end is the step to the edge; it starts from the edge.
    formats = Formats(ordinary=np.log(pairs / pairs.sum(axis=1, keepdims=True)))
    for kind in KINDS:
        chosen = counted.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples)
        values = [row["value"] for row in chosen.select("value").collect()]
        if len(values) < 20:
            continue
        formats.starts |= {v[0] for v in values}
        formats.ends |= {v[-1] for v in values}
        strings = [symbols(v) for v in values]
        formats.automata[kind] = Automaton(strings, alpha)
        odds = sorted(formats.odds(kind, s) for s in strings)
        formats.least_odds[kind] = max(_LEAST_ODDS, odds[len(odds) // 100])
        formats.shortest[kind] = labelled[kind]["shortest"]
        formats.prior[kind] = np.log(np.maximum(1, as_long / labelled[kind]["n"])).tolist()
    return formats


def spans_of(text: str, formats: Formats | None) -> list[tuple[int, int, str, float | None]]:
    """All spans of a text: the rules', and those in the rest of it, whatever rule spans
    it touches, that fit a learned format."""
    spans = [(start, end, kind, None) for start, end, kind, _ in rule_spans(text)]
    if formats is not None and formats.automata:
        rest = _without(text, spans) if spans else text
        for run in re.finditer("%s{%d,}" % (_CREDENTIAL, min(formats.shortest.values())), rest):
            for start, end, score in formats.found(run[0]):
                spans.append((run.start() + start, run.start() + end, FORMAT, score))
    order = [*KINDS, FORMAT]
    return sorted(spans, key=lambda s: (s[0], order.index(s[2])))


def scan(
    df: DataFrame, formats: Formats | None, key: str = "doc_id", text: str = "text", keep: tuple = ()
) -> DataFrame:
    """``key``, ``text``, the columns of ``keep`` and ``spans`` (kind, start, end in code
    points, score; by start, then kind) of every row over its whole text.

    Null text has no spans and stays null; rows are independent, so repeated rows
    and null keys stay as they are. One pass without a shuffle.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("secret_scan")  # what another operator left in the worker goes
        for batch in batches:
            for part in text_slices(batch, 1):
                spans = [
                    [{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in spans_of(t, formats)]
                    for t in texts_of(part, 1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(spans, pa.list_(span))], names=[*part.schema.names, "spans"]
                )

    picked = pick(df, key=key, text=text, **{f"keep{i}": c for i, c in enumerate(keep)})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(run, f"{fields}, spans {_SPANS}").toDF(key, text, *keep, "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(scanned: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows of ``scan`` with every span, overlaps joined, replaced by ``[SECRET]``;
    rows without spans and other columns stay as they are."""
    whole = F.col(text)

    def step(done: Column, span: Column) -> Column:
        before = F.concat(done["out"], F.substring(whole, done["at"], span["start"] + 1 - done["at"]), F.lit("[SECRET]"))
        apart = span["start"] + 1 >= done["at"]
        return F.struct(
            F.when(apart, before).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"] + 1).alias("at"),
        )

    rest = F.lit(2**31 - 1)
    cut = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        step,
        lambda done: F.concat(done["out"], F.substring(whole, done["at"], rest)),
    )
    return scanned.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(whole))
