import hashlib
from itertools import combinations

import numpy as np
import pytest

from stopwise.llm import queries, spot_signatures
from stopwise.llm.spot_signatures import Signer, fingerprint, likeness

SF = "/root/testdata/sf0.001"


def _sets(print_):
    return {print_[i : i + 10] for i in range(0, len(print_), 10)}


def _jaccard(a, b):
    a, b = _sets(a), _sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(texts):
    out = []
    for i, text in enumerate(texts):
        half, following = len(text) // 2, texts[(i + 1) % len(texts)]
        out.append(text[: len(text) - half] + following[:half])
    return out


def _check(rows, docs):
    """``docs``: distinct keys with texts."""
    docs = sorted((k, t or "") for k, t in docs)
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(found) == len(docs)
    edited = _edited([t for _, t in docs])
    for i, (key, text) in enumerate(docs):
        r, following = found[key], found[docs[(i + 1) % len(docs)][0]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(_jaccard(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(_jaccard(r["fingerprint"], following["fingerprint"]))


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _check(queries.op9_spot_signatures(spark, SF).collect(), docs)


@pytest.mark.parametrize(
    "docs",
    [
        [(3, "a house of cards and the big red dog is here")],
        [(1, None), (2, ""), (5, "x"), (9, "é the end of every long day in the year")],
        [(i * i, f"the number {i} is a square of some whole number " * i) for i in range(60)],
        [(1, "the word " * 20_000), (2, "...")],
    ],
)
def test_small_tables(spark, tmp_path, docs):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, place string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    _check(queries.op9_spot_signatures(spark, str(tmp_path)).collect(), docs)


def test_nulls_and_repeated_keys_have_an_order(spark):
    docs = [(None, "first of all"), (None, None), (4, "the same text of all"), (4, "the same text of all"), (4, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = spot_signatures.compare_with_next(df).collect()
    assert len(rows) == 5
    signs = {t or "": fingerprint(Signer().signatures(t or "")) for _, t in docs}
    assert sorted(r["fingerprint"] for r in rows) == sorted(signs[t or ""] for _, t in docs)
    assert spot_signatures.compare_with_next(df.limit(0)).count() == 0


def test_signatures_are_chains_after_anchors():
    signer = Signer()
    text = "The quick brown fox jumps over the lazy dog of my neighbour."
    same = "the QUICK, brown fox! jumps over the lazy dog; of my neighbour"
    other = "The quick brown fox jumps over the lazy cat of my neighbour."
    one, two, three = (signer.signatures(t) for t in (text, same, other))
    assert len(one) == 3 and likeness(one, two) == 1.0
    # The chains of the second and the third anchor: lazy dog neighbour, my neighbour.
    assert likeness(one, three) == pytest.approx(2 / 4)
    assert len(signer.signatures("")) == 0
    assert len(signer.signatures("of the and")) == len(signer.signatures("no anchors here?")) == 1
    assert signer.signatures("!") != signer.signatures("?")


def test_sizes_prune_only_what_cannot_be_alike():
    a, b = np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64)
    assert likeness(a, b, 0.8) == 0.8 and likeness(a[:79], b, 0.8) == 0.0 and likeness(a[:79], b) == 0.79


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_similar_pairs_equal_brute_force(spark, threshold):
    words = "cat dog bird fish cow horse sheep goat duck hen".split()
    rng = np.random.default_rng(2)
    rows = []
    for group in range(12):
        base = [f"the {rng.choice(words)} {rng.choice(words)} {rng.choice(words)}{group}" for _ in range(12)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = f"the {rng.choice(words)} x{rng.integers(99)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (None, rows[0][1])]
    signed = spot_signatures.sign(spark.createDataFrame(rows, "doc_id long, text string"))
    prints = sorted({r["fingerprint"] for r in signed.collect()} - {""})
    expected = {(a, b) for a, b in combinations(prints, 2) if _jaccard(a, b) >= threshold - 1e-12}
    found = spot_signatures.similar(signed, threshold).collect()
    assert {tuple(sorted((r["fingerprint_a"], r["fingerprint_b"]))) for r in found} == expected
    assert len(found) == len(expected) > 10
    assert all(r["likeness"] == pytest.approx(_jaccard(r["fingerprint_a"], r["fingerprint_b"])) for r in found)
