"""Spot signatures: fingerprints from chains of content words after common words.

Every common word (anchor) starts a chain of the content words that follow it;
the hashed chains are a text's signatures. Texts are compared by the Jaccard
likeness of their signature sets. For joins the sets are partitioned by size, so
that texts too different in size never meet, and shorter prefixes than the whole
set are enough to find partners.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import pick, shuffle_partitions, stored, text_slices, texts_of, worker_store

# Common words of the four languages, which serve as anchors and
# are left out of the chains.
ANCHORS = frozenset(
    "the a an and of to in is was are on that it as for with by from or be at this"
    " der die das den dem ein eine und in von mit ist zu sich auf nicht auch im es für"
    " le la les de des du un une et en est que qui dans pour pas sur au il elle"
    " el la los las de que y en un una es por con para se no su lo del al".split()
)
CHAIN = 3
SPACING = 1
_KEPT_WORDS = 400_000
_SIGNATURE_BYTES = 5  # of each hash in a fingerprint
_MASK = (1 << 8 * _SIGNATURE_BYTES) - 1
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) & 0xFFFFFFFFFFFFFFFF) for i in range(16)]


class Signer:
    """Signature sets of texts; hashes of words are kept in a bounded table.

    A word's hash is even if the word is an anchor, odd if it is content.
    """

    def __init__(self, chain: int = CHAIN, spacing: int = SPACING):
        self.chain, self.spacing = chain, spacing
        self.known: dict[bytes, int] = {}
        self.anchors = {a.encode() for a in ANCHORS}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        value = xxhash.xxh3_64_intdigest(word) | 1
        value = self.known[word] = value ^ 1 if word in self.anchors else value
        return value

    def signatures(self, text: str) -> np.ndarray:
        """The sorted distinct signatures of the whole text.

        The last anchors take shorter chains; an anchor that no content follows
        gives none. A text without signatures is signed as a whole, by its words,
        or by its characters if it has no word. Only the empty text has none.
        """
        words = text.lower().encode().translate(_TABLE).split()
        known = self.known
        values = [known.get(w) or self._hash(w) for w in words]
        hashes = np.array(values, dtype=np.uint64)
        content = (hashes & np.uint64(1)).astype(bool)
        anchors = np.flatnonzero(~content)
        places = np.flatnonzero(content)
        first = np.searchsorted(places, anchors)
        anchors, first = anchors[first < len(places)], first[first < len(places)]
        mixed = hashes[anchors] * _FACTORS[0]
        for step in range(self.chain):
            at = first + step * self.spacing
            there = at < len(places)
            part = np.where(there, hashes[places[np.minimum(at, len(places) - 1)]] if len(places) else 0, np.uint64(0))
            mixed = (mixed ^ (part * _FACTORS[step + 1])) * _FACTORS[-1]
            mixed ^= mixed >> np.uint64(29)
        found = np.unique(mixed & np.uint64(_MASK))
        if not len(found) and text:
            whole = b" ".join(words) or text.encode()
            found = np.array([xxhash.xxh3_64_intdigest(whole) & _MASK], dtype=np.uint64)
        return found


def likeness(one: np.ndarray, two: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; two empty ones are alike. Sets whose
    sizes alone keep them under ``least`` are not compared (0)."""
    small, large = sorted((len(one), len(two)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / (small + large - common)


def fingerprint(signatures: np.ndarray) -> str:
    """The signatures as text: ten hexadecimal digits each, in order."""
    rows = signatures.astype(">u8").tobytes().hex()
    width = 16 - 2 * _SIGNATURE_BYTES
    return "".join(rows[i + width : i + 16] for i in range(0, len(rows), 16))


def _signer() -> Signer:
    store = worker_store("spot_signatures")
    return store.setdefault("signer", Signer())


def sign(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` and ``n_signatures`` of every row's whole text.

    Null and empty text have the empty fingerprint; equal texts have equal ones.
    Rows are independent; one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer()
        for batch in batches:
            for part in text_slices(batch, 1):
                found = [signer.signatures(t) for t in texts_of(part, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([fingerprint(f) for f in found], pa.string()),
                        pa.array([len(f) for f in found], pa.int32()),
                    ],
                    names=["key", "fingerprint", "n"],
                )

    picked = pick(df, key=key, text=text)
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, f string, n int").toDF(key, "fingerprint", "n_signatures")


def similar(signed: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Pairs of different fingerprints that are alike to ``threshold`` or more:
    ``fingerprint_a, fingerprint_b, likeness``, each pair once.

    Rows of one fingerprint are one class and are not paired with each other; a
    caller joins the pairs to ``signed`` by fingerprint. Sets lie in partitions
    of sizes that grow by ``1 / threshold``, so partners are at most one
    partition apart; in a partition only sets that share a signature of their
    prefix meet, rare signatures first. Empty fingerprints have no partner.
    """
    cut = F.lit(".{%d}" % (2 * _SIGNATURE_BYTES))
    sets = stored(
        signed.filter("n_signatures > 0")
        .groupBy("fingerprint")
        .agg(F.first("n_signatures").alias("n"))
        .withColumn("id", F.xxhash64("fingerprint"))
        .withColumn("slot", F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int"))
    )
    each = sets.select(
        "id",
        "n",
        "slot",
        F.explode(F.regexp_extract_all("fingerprint", cut, 0)).alias("signature"),
    )
    often = each.groupBy("signature").agg(F.count("*").alias("often")).filter("often > 1")
    # Signatures of one set only come first in its order; they meet nobody.
    ranked = (
        each.join(often, "signature")
        .groupBy("id", "n", "slot")
        .agg(F.sort_array(F.collect_list(F.struct("often", "signature"))).alias("shared"))
        .withColumn("prefix", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        .withColumn("reach", F.col("prefix") - (F.col("n") - F.size("shared")))
        .filter("reach > 0")
        .select("id", "n", "slot", F.explode(F.expr("slice(shared, 1, cast(reach as int))")).alias("s"))
        .select("id", "n", "slot", F.col("s.signature").alias("signature"))
    )
    right = ranked.select(
        F.col("id").alias("id_b"),
        F.col("n").alias("n_b"),
        F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"),
        "signature",
        F.col("slot").alias("slot_b"),
    )
    met = (
        ranked.join(right, ["slot", "signature"])
        .filter((F.col("slot_b") > F.col("slot")) | (F.col("id") < F.col("id_b")))
        .filter(F.least("n", "n_b") >= threshold * F.greatest("n", "n_b") - F.lit(1e-9))
        .select("id", "id_b")
        .distinct()
    )
    a = sets.select("id", F.col("fingerprint").alias("fingerprint_a"), F.col("n").alias("n_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("fingerprint").alias("fingerprint_b"), F.col("n").alias("n_b"))

    pairs = met.join(a, "id").join(b, "id_b")
    common = F.size(
        F.array_intersect(*(F.regexp_extract_all(f"fingerprint_{x}", cut, 0) for x in "ab"))
    )
    verified = pairs.withColumn("likeness", common / (F.col("n_a") + F.col("n_b") - common))
    return verified.filter(F.col("likeness") >= threshold).select("fingerprint_a", "fingerprint_b", "likeness")


def half_replaced(text: str, other: str) -> str:
    """``text`` whose last half, in code points rounded down, is replaced by the
    first as many of ``other``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against its half-replaced edition and against the next text.

    Returns ``key, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next``. The order is by key, nulls first, rows of one key by a hash of the
    text, null text as empty; the row after the last is the first, so a single row
    follows itself.

    Rows are dealt into slices of neighbouring places, whose first rows are found
    beforehand without the texts, and sorted there. A slice also gets the first row
    of the next one. Texts are shuffled once; a task holds a few MB of them.
    """
    docs = pick(df, key=key, text=text).select("key", F.coalesce("text", F.lit("")).alias("text"))
    placed = docs.withColumn("place", F.xxhash64("text"))
    partitions = shuffle_partitions(df.sparkSession)
    firsts = (
        placed.select("key", "place")
        .repartitionByRange(4 * partitions, "key", "place")
        .groupBy(F.spark_partition_id())
        .agg(F.min(F.struct("key", "place")).alias("first"))
    )
    bounds = sorted(
        (r["first"]["key"] is not None, r["first"]["key"], r["first"]["place"]) for r in firsts.collect()
    )
    kind = docs.schema["key"].dataType.simpleString()

    def slices(keys, places):
        """The slices a row is for, the one it only ends as a negative number."""
        found = []
        for row_key, place in zip(keys, places, strict=True):
            row_key = None if row_key is None or row_key != row_key else row_key
            mark = (row_key is not None, row_key, place)
            own = bisect.bisect_right(bounds, mark) - 1
            first = bounds[own] == mark
            found.append([own, -1 - (own - 1) % len(bounds)] if first else [own])
        return found

    sliced = placed.withColumn("slice", F.explode(_arrow_udf(slices, "array<int>")("key", "place")))
    sliced = sliced.withColumn("ends", F.col("slice") < 0).withColumn(
        "slice", F.when(F.col("slice") < 0, -1 - F.col("slice")).otherwise(F.col("slice"))
    )
    dealt = sliced.repartition(partitions, "slice").sortWithinPartitions("slice", "ends", "key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer()
        waiting = None  # the row whose next one has not come
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                texts, ends = texts_of(part, 1), part.column(2).to_pylist()
                for row_key, text, end in zip(part.column(0).to_pylist(), texts, ends, strict=True):
                    if end and waiting is None:
                        continue  # a copy of the row that ends the slice
                    signatures = signer.signatures(text)
                    if waiting is not None:
                        rows.append(_compared(signer, *waiting, text, signatures))
                    waiting = None if end else (row_key, text, signatures)
                columns = list(zip(*rows, strict=True)) or [[]] * len(_COMPARED)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _compared_schema(part), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_compared_schema(part))

    fields = ", ".join(f"{n} {t}" for n, t in (("key", kind), *_COMPARED[1:]))
    compared = dealt.select("key", "text", "ends").mapInArrow(run, fields)
    return compared.withColumnRenamed("key", key)


_COMPARED = (
    ("key", ""),
    ("n_chars", "long"),
    ("edited", "string"),
    ("fingerprint", "string"),
    ("edited_fingerprint", "string"),
    ("near_edited", "double"),
    ("near_next", "double"),
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _compared_schema(part: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("key", part.schema.field(0).type), *((n, _ARROW[t]) for n, t in _COMPARED[1:])])


def _compared(signer: Signer, key, text: str, own: np.ndarray, following: str, next_signatures: np.ndarray) -> tuple:
    edited = half_replaced(text, following)
    changed = own if edited == text else signer.signatures(edited)
    return (
        key,
        len(text),
        edited,
        fingerprint(own),
        fingerprint(changed),
        likeness(own, changed),
        likeness(own, next_signatures),
    )


def _arrow_udf(function, kind: str):
    """A column function over whole batches of values."""

    def batched(keys: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(function(keys.tolist(), places.tolist()))

    return F.pandas_udf(batched, kind)
