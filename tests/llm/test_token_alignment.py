import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stopwise.llm import queries, token_alignment
from stopwise.llm.token_alignment import Alignment, GroupText

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")


def _by_offsets(ends_a, ends_b):
    """Groups and links as worded: common ends, and overlaps of all pairs."""
    common = sorted(set(ends_a) & set(ends_b))
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links = {
        (i, j)
        for i, (s, e) in enumerate(zip(starts_a, ends_a))
        for j, (t, f) in enumerate(zip(starts_b, ends_b))
        if max(s, t) < min(e, f)
    }
    groups, low = [], 0
    for end in common:
        groups.append(
            (
                [i for i, e in enumerate(ends_a) if low < e <= end],
                [j for j, e in enumerate(ends_b) if low < e <= end],
            )
        )
        low = end
    return groups, links


def _groups(aligned):
    def parts(last):
        ends = np.flatnonzero(last) + 1
        return [list(range(a, b)) for a, b in zip([0, *ends[:-1]], ends)]

    return list(zip(parts(aligned.last_a), parts(aligned.last_b)))


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6, 0.95, 1.0])
def test_alignment_equals_all_pairs(share):
    rng = random.Random(int(100 * share))
    for _ in range(60):
        size = rng.randint(1, 60)
        ends = [sorted({e for e in range(1, size) if rng.random() < share} | {size}) for _ in range(2)]
        if rng.random() < 0.5:  # long stretches one to one
            ends[1] = sorted((set(ends[0]) - {rng.randint(1, size)}) | {size})
        aligned = Alignment(np.array(ends[0]), np.array(ends[1]))
        groups, links = _by_offsets(*ends)
        assert _groups(aligned) == groups and aligned.groups == len(groups)
        found = list(zip(aligned.link_a.tolist(), aligned.link_b.tolist()))
        assert len(found) == len(links) and set(found) == links


def test_no_tokens():
    aligned = Alignment(np.empty(0, np.int64), np.empty(0, np.int64))
    assert aligned.groups == 0 and len(aligned.link_a) == 0
    assert GroupText(9).sha256(np.empty(0, np.int64), np.empty(0, np.int64), aligned) == ""


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_group_text(monkeypatch, block):
    monkeypatch.setattr(token_alignment, "_BLOCK", block)
    rng = random.Random(block)
    for _ in range(30):
        size = rng.randint(1, 50)
        ends = [sorted({e for e in range(1, size) if rng.random() < 0.5} | {size}) for _ in range(2)]
        ids = [np.array([rng.choice([0, 7, 10, 99, 100, 12345, 50256]) for _ in e]) for e in ends]
        aligned = Alignment(np.array(ends[0]), np.array(ends[1]))
        expected = ";".join(
            ",".join(str(ids[0][i]) for i in a) + "|" + ",".join(str(ids[1][j]) for j in b) for a, b in _groups(aligned)
        )
        written = b"".join(GroupText(50256).blocks(*ids, aligned))
        assert written.decode() == expected


def _libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def _letters():
    printable = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _expected(docs):
    """Everything by the libraries' own pieces, document by document."""
    a, b = _libraries()
    letters, found, pairs = _letters(), [], Counter()
    for key, text in docs:
        if not text:
            found.append((key, [], [], [], []))
            continue
        coded, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in coded.ids]
        raw_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            found.append((key, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in raw]).tolist() for raw in (raw_a, raw_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, low, links, j = [], 0, [], 0
        for i, end in enumerate(ends[0]):  # overlaps by walking both lists
            start = ends[0][i - 1] if i else 0
            while j and ends[1][j - 1] > start:
                j -= 1
            while j < len(ends[1]) and (ends[1][j - 1] if j else 0) < end:
                if ends[1][j] > start:
                    links.append((coded.ids[i], ids_b[j]))
                j += 1
        at = [0, 0]
        for end in common:
            to = [e.index(end, p) + 1 for e, p in zip(ends, at)]
            groups.append((coded.ids[at[0] : to[0]], ids_b[at[1] : to[1]]))
            at = to
        pairs.update(links)
        found.append((key, coded.ids, ids_b, groups, links))
    best = Counter()
    for (_, two), n in pairs.items():
        best[two] = max(best[two], n)
    rows = []
    for key, ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append(
            (
                key,
                len(ids_a),
                len(ids_b),
                len(groups),
                len(links),
                sum(pairs[p] == best[p[1]] for p in links),
                sum(pairs[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return rows


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *[x for x in r if x is not None]))


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op13_token_alignment(spark, sf_dir)
    assert found.columns == _COLUMNS
    assert _sorted(map(tuple, found.collect())) == _sorted(_expected([tuple(d) for d in docs]))


HARD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "a▁b is not a space"),
    (5, "  two  spaces \n\n\t tabs\r\n "),
    (6, "<|endoftext|> <s> </s> <unk> <0x0A>"),
    (7, "日本語 ÀÉ é İ \x00 \U0001f600‍ ﬁ 　 é ̈"),
    (8, "it's 1234567890 !!!??? ---"),
    (9, "word " * 30_000),
    (9, "x" * 50_000),
    (None, "no id, twice"),
    (None, "no id, twice"),
    (2**60 + 1, "a large id"),
]


@pytest.mark.parametrize("chunk_bytes", [1, 200, token_alignment.CHUNK_BYTES])
def test_hard_texts(spark, chunk_bytes):
    df = spark.createDataFrame([(*d, 1, 2) for d in HARD], "doc_id long, text string, chunk int, code int").repartition(3)
    found = token_alignment.link_statistics(df, PATH_A, PATH_B, chunk_bytes=chunk_bytes)
    assert _sorted(map(tuple, found.collect())) == _sorted(_expected(HARD))


def test_alignments_themselves(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    a, b = _libraries()
    for r in token_alignment.align_tokens(df, PATH_A, PATH_B).join(df.distinct(), "doc_id").collect():
        assert sum(r["groups_a"]) == len(r["ids_a"]) and sum(r["groups_b"]) == len(r["ids_b"])
        assert len(r["groups_a"]) == len(r["groups_b"]) and all(r["groups_a"]) and all(r["groups_b"])
        if r["ids_a"]:
            raw = a.decode(r["ids_a"], skip_special_tokens=False)
            assert raw in (" " + t for k, t in HARD if k == r["doc_id"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.link_statistics(df, PATH_A, PATH_B).count() == 0
    assert token_alignment.align_tokens(df, PATH_A, PATH_B).count() == 0
