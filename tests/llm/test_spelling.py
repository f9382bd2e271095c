import random
import re
import zlib
from collections import Counter

import pytest

from stopwise.llm import queries, spelling


def _near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _forms(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        rows[w] = (f, root, counts[w], len(near[w]), counts[f] if f is not None else None)
    return rows


def _as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def _vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def _random_words(seed, how_many, letters="abé", longest=7):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(how_many)}


@pytest.mark.parametrize("part_words, free_length", [(4096, 32), (3, 32), (1, 1), (5, 2)])
def test_pairs_equal_all_pairs(spark, part_words, free_length):
    """Whatever parts are halved: each near pair once and nothing else."""
    words = sorted(_random_words(1, 300) | {"a" * n for n in range(1, 12)} | {"a" * 9 + "b", "b" + "a" * 9})
    found = spelling.near_pairs(_vocabulary(spark, dict.fromkeys(words, 1)), part_words, free_length)
    found = [tuple(sorted(r)) for r in found.collect()]
    expected = {(a, b) for a in words for b in words if a < b and _near(a, b)}
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_acceptor_is_minimal():
    """States are told apart by what they accept."""
    acceptor = spelling.Acceptor()
    starts = [acceptor.add(w) for w in (["bat", "cat", "hat"], ["bat", "cat", "hat"], ["bit", "cat"])]
    assert starts[0] == starts[1] != starts[2]
    futures = [tuple(sorted(acceptor.all_from(s))) for s in range(len(acceptor.arcs))]
    assert len(futures) == len(set(futures))
    assert acceptor.add([]) is None


@pytest.mark.parametrize("seed", range(3))
def test_forms_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = {w: rng.choice([3, 3, 5, 6, 11, 24, 50, 100, 400]) for w in _random_words(seed, 250, "abcé", 6)}
    assert _as_rows(spelling.spelling_forms(_vocabulary(spark, counts), part_words=20)) == _forms(counts)


def test_long_chain_of_forms(spark):
    words = ["z" * 6 + "a" * i for i in range(40)]
    counts = {w: 3 << i for i, w in enumerate(words)}
    assert _as_rows(spelling.spelling_forms(_vocabulary(spark, counts))) == _forms(counts)


def test_large_part_of_one_beginning(spark):
    """A third and more of all words share beginning and end."""
    rng = random.Random(5)
    same = {"common" + "".join(rng.choice("abcdef") for _ in range(6)) + "ending" for _ in range(600)}
    counts = {w: rng.randint(3, 99) for w in sorted(same | _random_words(5, 300, "abcdefgh", 9))}
    assert _as_rows(spelling.spelling_forms(_vocabulary(spark, counts), part_words=40)) == _forms(counts)


def test_very_long_words(spark):
    long = "ab" * 20_000
    counts = {long: 9, long[:7] + long[8:]: 4, long + "b": 3, long[:-1] + "c": 3, "x" + long[1:]: 30}
    assert _as_rows(spelling.spelling_forms(_vocabulary(spark, counts))) == _forms(counts)


def _counted(docs, slip_every):
    counts = Counter()
    for key, text in docs:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            drawn = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip_every and drawn % slip_every == 0:
                run = run[: drawn % len(run)] + run[drawn % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("slip_every", [None, 2, 7])
def test_counts_of_hard_texts(spark, slip_every):
    docs = [
        (1, None),
        (2, ""),
        (3, "Hello hello HELLO, ÀÉÎãé ÀÉÎãé àéîãé À×÷ÿa ΑΣΑΣΑ İstanbul İstanbul İstanbul ﬁnance"),
        (None, "hello-World worldly_worldly1worldly\x00worldly"),
        (5, "word" * 30_000 + " tiny tiny tiny tiny"),
        (5, "word" * 30_000),
        (6, "word" * 30_000),
        (7, "repeated repeated"),
        (7, "repeated repeated"),
    ]
    df = spark.createDataFrame([(*d, "word", 1) for d in docs], "doc_id long, text string, word string, n long")
    found = {r["word"]: r["n"] for r in spelling.count_words(df, slip_every=slip_every).collect()}
    assert found == _counted(docs, slip_every)


def test_a_task_passes_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD_WORDS", 3)
    docs = [(i, " ".join(f"word{'abcdefgh'[j % 8]}" for j in range(i))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == _counted(docs, None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_forms(spelling.count_words(df)).count() == 0
    alone = _vocabulary(spark, {"alone": 3, "other": 4, None: 5})
    assert _as_rows(spelling.spelling_forms(alone)) == {"alone": (None, "alone", 3, 0, None), "other": (None, "other", 4, 0, None)}


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = _counted(docs, 97)
    rows = _as_rows(queries.op12_spelling(spark, sf_dir))
    assert {w: r[2] for w, r in rows.items()} == counts
    deleted = {}
    for w in counts:
        for i in range(len(w)):
            deleted.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: {v for i in range(len(w)) for v in deleted[i, w[:i] + w[i + 1 :]] if v != w} for w in counts}
    for w in counts:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in counts:
                near[w].add(v)
                near[v].add(w)
    assert {w: r[3] for w, r in rows.items()} == {w: len(v) for w, v in near.items()}
    for w, (form, root, n, _, form_n) in rows.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        expected = best if best is not None and counts[best] >= 2 * n else None
        assert (form, form_n) == (expected, counts.get(expected))
        assert root == (w if form is None else rows[form][1])
