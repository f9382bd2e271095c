import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stopwise.llm import queries, residual_packing
from stopwise.llm.plain_bpe import ByteLevelIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _library(plain=False):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = plain
    library.no_truncation()
    library.no_padding()
    return library


HARD = [
    "",
    " ",
    "x" * 9000,
    "word " * 5000,
    " \n\t  two  spaces \r\n\r\n ",
    "a<|endoftext|>b <|endoftext|> <|ENDOFTEXT|>",
    "ÀÉ é İ ΑΣ\x1cy \xa0z 日本 　  ﬁ \U0001f600‍ é",
    "it's we'll I'M 'tis ''s",
    " " * 300_000 + "x",  # beyond the encoder's pattern
]


@pytest.mark.parametrize("added", [True, False])
def test_ids_are_the_librarys(added):
    ids, library = ByteLevelIds(open(PATH, "rb").read(), added=added), _library(plain=not added)
    rng = random.Random(3)
    letters = "ab Ze'\n\t.,1é日​<|>" + chr(0x1F469)
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        assert ids.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def _best_fit_by_search(lengths, capacity):
    """The rule as worded, by looking at every bin; the contents of the bins."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + length <= capacity]
        if fitting:
            max(fitting, key=sum).append(length)
        else:
            bins.append([length])
    return sorted(sum(b) for b in bins)


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_equals_a_search(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 120))]
    bins, offsets, held = residual_packing.best_fit(np.array(lengths, dtype=np.int64), 64)
    assert sorted(held) == _best_fit_by_search(lengths, 64)
    by_bin = {}
    for length, number, offset in zip(lengths, bins, offsets):
        by_bin.setdefault(number, []).append((offset, length))
    for number, inside in by_bin.items():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at == held[number] <= 64


def test_cuts():
    assert residual_packing.spans_of(1, 2048) == [(0, 1)]
    assert residual_packing.spans_of(2048, 2048) == [(0, 2048)]
    assert residual_packing.spans_of(4099, 2048) == [(0, 3), (3, 2048), (2051, 2048)]


def _check_sequences(rows, capacity=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in by_sequence.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def _check_pieces(rows, ids):
    """Every document is one piece, or a shorter first one and full ones after it."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        expected = residual_packing.spans_of(len(ids[key]), 2048)
        pieces.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(i, *s) for i, s in enumerate(expected)]
        for r in pieces:
            part = ids[key][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op11_residual_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    library = _library()
    ids = {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0] for d in docs}
    _check_pieces(rows, ids)
    lengths = [length for i in ids.values() for _, length in residual_packing.spans_of(len(i), 2048)]
    assert _check_sequences(rows) <= 1.01 * len(_best_fit_by_search(lengths, 2048)) + 1


def test_hard_texts_and_clashing_names(spark):
    texts = [None, *HARD, "twice", "twice"]
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "no id", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, bin int, `group` int")
    packed = residual_packing.pack(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    library = _library()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in rows}
    _check_pieces(packed, ids)
    _check_sequences(packed)


def _pieces(spark, lengths):
    return spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")


@pytest.mark.parametrize("group_items, fan_in", [(64, 2), (100, 4), (128, 16)])
def test_a_tree_of_many_groups(spark, group_items, fan_in):
    """Several levels: all pieces stay, and few sequences more than in one group."""
    rng = random.Random(group_items)
    lengths = [rng.choice([rng.randint(1, 300), rng.randint(300, 2048)]) for _ in range(3000)]
    rows = residual_packing.assign(_pieces(spark, lengths), group_items=group_items, fan_in=fan_in).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted(enumerate(lengths))
    assert _check_sequences(rows) <= 1.02 * len(_best_fit_by_search(lengths, 2048)) + 1


def test_underfull_bins_of_distant_groups_meet(spark):
    """Groups that each keep one small bin give one sequence for all of them."""
    rows = residual_packing.assign(_pieces(spark, [1] * 1500), group_items=64, fan_in=4).collect()
    assert _check_sequences(rows) == 1


def test_pieces_that_never_fit_together_stay_bounded(spark):
    """All over half a sequence: no bin takes two, and no task gets more than its bound."""
    rows = residual_packing.assign(_pieces(spark, [1100] * 1000), group_items=50, fan_in=5).collect()
    assert _check_sequences(rows) == 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert residual_packing.pack(df, PATH).count() == 0
