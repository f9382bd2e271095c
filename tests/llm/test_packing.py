import json
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stopwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _best_largest(lengths, windows):
    """The smallest possible largest window, by trying all ways."""
    best = [sum(lengths)]

    def place(i, sums):
        if max(sums) >= best[0]:
            return
        if i == len(lengths):
            best[0] = max(sums)
            return
        for w in range(windows):
            place(i + 1, [s + lengths[i] * (j == w) for j, s in enumerate(sums)])
            if not sums[w]:
                break

    place(0, [0] * windows)
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_differencing_is_near_the_best(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
    windows = rng.randint(1, 4)
    dealt = packing.difference(lengths, windows)
    assert sorted(i for w in dealt for i in w) == list(range(len(lengths)))
    assert len(dealt) <= windows
    largest = max(sum(lengths[i] for i in w) for w in dealt)
    assert largest <= 4 / 3 * _best_largest(lengths, windows) + 1


def test_the_classic_example():
    dealt = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in dealt) == [14, 16]


def test_windows_grow_until_they_hold():
    assert packing.pack_bin([], 10) == []
    assert len(packing.pack_bin([6, 6, 6], 10)) == 3
    for seed in range(5):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 512) for _ in range(700)]
        dealt = packing.pack_bin(lengths, 2048)
        assert max(sum(lengths[i] for i in w) for w in dealt) <= 2048
        assert 2048 * len(dealt) - sum(lengths) < 0.02 * sum(lengths)


def _check(packed, texts):
    """Every id of every text lies in one piece, sequences are gapless and hold."""
    library = Tokenizer.from_file(PATH)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[key][at : at + r["length"]]
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            assert (r["start"], r["doc_tokens"], r["length"] > 0) == (at, len(ids[key]), True)
            assert bytes(r["ids"]) == raw and r["crc"] == zlib.crc32(raw)
            at += r["length"]
        assert at == len(ids[key])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return len(by_sequence), sum(map(len, ids.values()))


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, PATH).withColumn("crc", F.crc32("ids")).collect()
    sequences, tokens = _check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sequences * packing.CAPACITY < 1.03 * tokens


def test_hard_texts(spark):
    texts = {
        0: None,
        1: "",
        2: " \n\t ",
        3: "x" * 9000,
        4: "word " * 5000,
        5: "a<|endoftext|>b ÀÉ é İ ΑΣ\x1cy \xa0z 日本",
        None: "no id",
    }
    df = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, start int")
    rows = packing.pack(df, PATH).withColumn("crc", F.crc32("ids")).collect()
    _check(rows, texts)


def test_repeated_rows_and_small_bins(spark):
    df = spark.createDataFrame([(7, "one two three " * 30)] * 50, "doc_id long, text string")
    pieces = packing.token_pieces(df, PATH).drop("ids")
    rows = packing.assign(pieces, bin_tokens=3000).collect()
    assert len(rows) == 50 and sum(r["length"] for r in rows) == 50 * rows[0]["doc_tokens"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0


def test_added_tokens_keep_their_case(spark):
    texts = {1: "a <|ENDOFTEXT|> <|EndOfText|>, B<|endoftext|>C <|STARTOFTEXT|>", 2: "<|endoftext|> The THE"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _check(packing.pack(df, PATH).withColumn("crc", F.crc32("ids")).collect(), texts)


def test_words_are_ranked_without_the_library_and_not_remembered():
    with open(PATH, "rb") as f:
        words = packing.WordIds(f.read())
    before = set(vars(words))
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    known = [t.removesuffix("</w>") for t in library.get_vocab()]
    texts = [" ".join(w for w in known if w.isascii() and w not in words.added), "It's 'SURE'LL 've--'s 3rd 12.5%!?'re"]
    texts += ["".join(rng.choices("abcdeéÀßЖ中'stre.,-–“0 9\n\tĿŸ", k=rng.randint(1, 90))) for _ in range(2000)]
    same = lambda t: words.encode(t) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
    assert words.fast is not None and all(map(same, texts))
    assert set(vars(words)) == before  # no library was loaded, no table of words made
    odd = "aß'sİſŉΑΣé²½ª×\xad\xa0\x85\x1ć̆ и日한ｱ \n<|>"
    mixed = ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(2000)]
    mixed += [f"one two{chr(c)}s 's{chr(c)} three" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert all(map(same, mixed))


def test_a_file_of_other_splitting_goes_to_the_library():
    file = json.loads(Tokenizer.from_file(PATH).to_str())
    file["normalizer"] = {"type": "Lowercase"}
    words = packing.WordIds(json.dumps(file).encode())
    ids = words.library.encode("The é", add_special_tokens=False).ids
    assert words.fast is None and words.encode("The é") == b"".join(i.to_bytes(4, "little") for i in ids)
