import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stopwise.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return byte_bpe.Encoder(byte_bpe.Vocabulary(f.read()))


def _ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


HARD = [
    "",
    " ",
    "  ",
    "\n a\n  b \n",
    "a \xa0b\x1c c\x85d",
    "x<|endoftext|>  y <|endoftext|>",
    "we'll DON'T 's 12३ ½²",
    "日本語😀 é é​﻿",
    "a" * 5000,
    " " * 700 + "z",
    "=-" * 90,
]


def test_equal_to_the_library(encoder, library):
    assert [_ids(p) for p in encoder.encode(HARD)] == [library.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'abcdst1.<|>é")), st.characters(exclude_categories=["Cs"])))))
def test_any_text_is_encoded_as_by_the_library(encoder, library, texts):
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [_ids(p) for p in encoder.encode(texts)] == expected


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_KEPT", 5)
    with open(PATH, "rb") as f:
        small = byte_bpe.Encoder(byte_bpe.Vocabulary(f.read()))
    texts = [f"some words {i} and more words {i % 3}" for i in range(40)]
    for start in range(0, 40, 7):
        part = texts[start : start + 7]
        assert [_ids(p) for p in small.encode(part)] == [library.encode(t).ids for t in part]


def test_whole_table_and_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for row in rows:
        assert row["ids"] == library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["text"] == library.decode(row["ids"], skip_special_tokens=False) == texts[row["doc_id"]]


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "a b", "x"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((r["doc_id"] or 0, r["ids"]) for r in byte_bpe.encode(df, PATH).collect())
    assert found == [(0, []), (1, []), (1, [64, 275]), (1, [64, 275])]
    assert byte_bpe.encode(df.limit(0), PATH).count() == 0


def test_decoding_what_is_no_text(spark, library):
    ids = [[50256, 10, 447], [447, None, 99999, -3], None, []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in byte_bpe.decode(df, PATH).collect()}
    assert found == {0: library.decode([50256, 10, 447], skip_special_tokens=False), 1: "�", 2: "", 3: ""}


def test_one_pass_gives_the_same(spark):
    rows = [(i, t) for i, t in enumerate([None, *HARD, "twice", "twice"])] + [(None, "no id")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, decoded string, ids int")
    two = byte_bpe.decode(byte_bpe.encode(df, PATH), PATH).withColumnRenamed("text", "decoded")
    one = byte_bpe.encode_and_decode(df, PATH)
    order = lambda r: (r["doc_id"] is None, r["doc_id"])
    assert sorted(one.collect(), key=order) == sorted(two.collect(), key=order)
    assert byte_bpe.encode_and_decode(df.limit(0), PATH).count() == 0
