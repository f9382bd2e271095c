"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its hashed byte n-grams; a linear
layer and a softmax give the languages' shares. Both are trained in numpy by
stochastic gradient descent on a bounded sample of labelled rows. As mean and
layer are linear, the trained model is one table of scores by bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import pick, text_slices, texts_of, worker_store

UNDETERMINED = "und"
MAX_ROWS = 2000  # labelled rows the model is fitted on
BUCKETS = 1 << 12
DIMENSION = 16
_NGRAMS = (1, 2, 3, 4)
_MULTIPLIER = np.uint32(0x9E3779B1)
_LETTER = re.compile(r"[^\W\d_]")
# ASCII that is no letter stands for a border, as a space does.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_BORDERS = re.compile(b" +")


def has_letters(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def buckets_of(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text, as shares."""
    plain = b" " + _BORDERS.sub(b" ", text.lower().encode().translate(_TABLE)) + b" "
    codes = np.frombuffer(plain, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    counts = np.zeros(BUCKETS)
    value = np.zeros(len(codes), np.uint32)
    for n in range(1, max(_NGRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        value = value[:size] * np.uint32(257) + codes[n - 1 :]
        if n in _NGRAMS:
            mixed = (value ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _MULTIPLIER
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * _MULTIPLIER) >> shift, minlength=BUCKETS)
    return counts / max(1.0, counts.sum())


@dataclass
class Model:
    """Languages, their score table by bucket, and the least share to accept."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    least_share: float

    def shares(self, features: np.ndarray) -> np.ndarray:
        scores = features @ self.table + self.bias
        scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
        return scores / scores.sum(axis=-1, keepdims=True)


def _train(features: np.ndarray, labels: np.ndarray, languages: int, epochs: int, seed: int):
    """Embeddings and layer by stochastic gradient descent on the cross entropy."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSION, languages)).astype(np.float32)
    bias = np.zeros(languages, np.float32)
    # Shares are small: scaled to a root mean square of 1 over the used buckets.
    scale = np.float32(1 / max(1e-9, np.sqrt((features**2).sum(axis=1).mean())))
    steps, batch = 0, 32
    total = epochs * -(-len(features) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x = features[rows] * scale
            hidden = x @ embed
            scores = hidden @ layer + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            rate = np.float32(1.0 * (1 - steps / total))
            back = error @ layer.T
            layer -= rate * (hidden.T @ error)
            embed -= rate * (x.T @ back)
            bias -= rate * error.sum(axis=0)
            steps += 1
    return embed @ layer * scale, bias


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores at which held-back rows are likeliest."""

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)


def fit(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_rows: int = MAX_ROWS,
    epochs: int = 15,
    rejected: float = 0.001,
    most: float = 0.4,
    seed: int = 7,
) -> Model | None:
    """A model from the rows of ``df`` that have letters and a non-null ``lang``.

    About ``max_rows`` rows, chosen by a hash of their content and twice as many at
    most, are turned into features on the executors; only those reach the driver.
    Four fifths train the model. The others set the temperature and the least share:
    that below which the share ``rejected`` of the rightly named ones lies, ``most``
    at most. Without labelled rows there is no model (None).
    """
    labelled = pick(df, text=text, lang=lang).filter("lang is not null and text is not null")
    total = labelled.count()
    if not total:
        return None
    chosen = labelled
    if total > max_rows:
        share = int(max_rows / total * 1_000_000_000)
        chosen = labelled.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000_000)) < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("language_id")  # what another operator left in the worker goes
        for batch in batches:
            for part in text_slices(batch, 0):
                rows = [
                    (lang, buckets_of(t))
                    for t, lang in zip(texts_of(part, 0), part.column(1).to_pylist(), strict=True)
                    if has_letters(t)
                ]
                used = [np.flatnonzero(f) for _, f in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for lang, _ in rows], pa.string()),
                        pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                        pa.array([f[u].astype("<f4").tobytes() for (_, f), u in zip(rows, used)], pa.binary()),
                    ],
                    names=["lang", "at", "share"],
                )

    sample = chosen.mapInArrow(features, "lang string, at binary, share binary").limit(2 * max_rows).collect()
    sample = sorted((r["lang"], bytes(r["at"]), bytes(r["share"])) for r in sample)
    if not sample:
        return None
    languages = sorted({s[0] for s in sample})
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for row, (_, at, share) in enumerate(sample):
        x[row, np.frombuffer(at, "<u2")] = np.frombuffer(share, "<f4")
    y = np.array([languages.index(s[0]) for s in sample])
    order = np.random.default_rng(seed).permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    table, bias = _train(x[used], y[used], len(languages), epochs, seed)
    model = Model(languages, table.astype(np.float64), bias.astype(np.float64), 0.0)
    if len(held):
        t = _temperature(x[held] @ model.table + model.bias, y[held])
        model.table, model.bias = model.table / t, model.bias / t
        shares = model.shares(x[held].astype(np.float64))
        right = shares.argmax(axis=1) == y[held]
        if right.any():
            model.least_share = float(min(most, np.quantile(shares.max(axis=1)[right], rejected)))
    return model


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """``key``, the columns of ``keep``, ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    Only the text counts, all of it. Null text, text without letters, or no model:
    ``und`` with score 0, not accepted. Equal shares go to the language first by
    name. A score under the calibrated least share is not accepted, but named.
    Rows are independent; one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("language_id")  # what another operator left in the worker goes
        for batch in batches:
            for part in text_slices(batch, 0):
                names, scores, accepted = [], [], []
                for t in part.column(0).to_pylist():
                    if model is None or not has_letters(t):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        accepted.append(False)
                        continue
                    shares = model.shares(buckets_of(t))
                    best = int(shares.argmax())
                    names.append(model.languages[best])
                    scores.append(min(1.0, float(shares[best])))
                    accepted.append(scores[-1] >= model.least_share)
                found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[back:], *found], names=returned)

    # The text goes to Python once, and comes back only if it is kept.
    others = [c for c in keep if c != text]
    picked = pick(df, text=text, key=key, **{f"keep{i}": c for i, c in enumerate(others)})
    back = 0 if text in keep else 1
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema][back:]
    returned = [*picked.columns[back:], "lang_pred", "score", "accepted"]
    done = picked.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "accepted boolean"]))
    kept = [F.col("text" if c == text else f"keep{others.index(c)}").alias(c) for c in keep]
    return done.select(F.col("key").alias(key), *kept, "lang_pred", "score", "accepted")


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
