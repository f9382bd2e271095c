import random
import re

import numpy as np
import pytest

from stopwise.llm import jaccard_join

WORDS = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingle_set(text, n=5):
    words = WORDS.findall((text or "").translate(_LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, percent=80):
    """(key, set size, smallest reachable key) of every row, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return sorted(((k, len(sets[i]), smallest.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def corpus(seed=4):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows, key = [], 100
    for _ in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 150))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = passage
        for _ in range(rng.randint(1, 5)):
            rows.append((key, rng.choice([" ", "\n", " \t"]).join(_edited(rng, words, rng.randint(0, 4)))))
            key += 1
    base = [f"g{i}" for i in range(120)]
    # A large group of near copies, and two that share most of a passage only.
    rows += [(key + i, " ".join(_edited(rng, base, rng.randint(0, 2)))) for i in range(60)]
    key += 60
    rows += [(key + i, " ".join(passage + [f"x{i % 2}{j}" for j in range(9 + i % 3)])) for i in range(20)]
    key += 20
    rows += [(key, "A B c"), (key + 1, "a b C"), (key + 2, "a b"), (key + 3, ""), (key + 4, None), (key + 5, " \n")]
    rows += [(key + 6, "É a b c d"), (key + 7, "é a b c d"), (None, "a b c"), (None, "lonely words that have no number"), (None, None)]
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], "another text under the number of a different one")]
    rows += [(key + 8, "\xa0a b c d e"), (key + 9, " a b c d e"), (key + 10, "long " * 5000), (key + 11, "long " * 7000)]
    rng.shuffle(rows)
    return rows


def _found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, `class` string")
    found = jaccard_join.similarity_components(df.repartition(5), **options).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_equal_to_all_pairs(spark, percent):
    rows = corpus()
    assert _found(spark, rows, percent=percent) == brute_components(rows, percent)


def test_small_buckets_and_flushes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_FLUSH", 300)
    monkeypatch.setattr(jaccard_join, "_BUCKET", 500)
    monkeypatch.setattr(jaccard_join, "_CHAIN", 7)
    monkeypatch.setattr(jaccard_join, "_BROADCAST_ROWS", 0)
    rows = corpus(9)
    assert _found(spark, rows) == brute_components(rows)


def test_the_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    # n more words at the end add n shingles: alike to 100 / (100 + n).
    rows = [(0, " ".join(words)), (1, " ".join(words + [f"x{i}" for i in range(25)])), (2, " ".join(words + [f"y{i}" for i in range(26)]))]
    assert _found(spark, rows) == [(0, 100, 0), (1, 125, 0), (2, 126, 2)]


def test_components_name_groups(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "d e f"), (6, "D E F"), (None, "")], "doc_id long, text string")
    rows = jaccard_join.similarity_components(df).collect()
    by_class = {r["class"]: r["component"] for r in rows}
    assert len(set(by_class.values())) == 3 and by_class[None] is None


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")], [(1, "one text")] * 3])
def test_hardly_any_rows(spark, rows):
    assert _found(spark, rows) == brute_components(rows)


def test_packed_shingles_come_back():
    rng = np.random.default_rng(1)
    classes = np.repeat(np.array([-5, 0, 2**62]), [3, 1, 4])
    hashes = rng.integers(0, 1 << 40, 8).astype(np.uint64)
    again = jaccard_join._unpack(jaccard_join._pack(classes, hashes))
    assert (again[0] == classes).all() and (again[1] == hashes).all()


def test_classes_need_no_shingles(spark, monkeypatch):
    def shingles(self, words):
        raise AssertionError("shingles are made where they are counted")

    monkeypatch.setattr(jaccard_join.Shingler, "shingles", shingles)
    df = spark.createDataFrame([(1, "a b c d e f a b c d e f"), (2, "a b"), (3, " "), (4, None)], "k long, t string")
    rows = jaccard_join.document_classes(df, "k", "t", 5).collect()
    assert sorted((r["key"], r["places"], r["class"] is None) for r in rows) == [
        (1, 8, False), (2, 1, False), (3, 0, True), (4, 0, True),
    ]


def test_sizes_come_with_the_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_FLUSH", 3)
    texts = ["a b c d e f a b c d e f", "a b c d e f", "a b", "q r s t u v w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    counts = {r["class"]: (r["n"], r["shared"]) for r in jaccard_join._shared_counts(df, "t", 5, 2).collect()}
    assert [counts[jaccard_join.class_of(t.encode().split())] for t in texts] == [(6, 2), (2, 2), (1, 0), (3, 0)]


def test_copies_too_far_apart_make_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"g{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(5, 145, 10), 2):  # ten shingles go, ten of its own come
            words[at + rng.randrange(5)] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    verified, made = jaccard_join._verified, []

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    assert _found(spark, rows) == brute_components(rows)
    assert max(made) <= len(rows) ** 2 // 8  # of nearly half its square


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for size, other in [(0, 5), (1, 1), (100, 120), (3000, 2500)]:
        a, b = rng.choice(pool, size, replace=False), rng.choice(pool, other, replace=False)
        one, two = jaccard_join.parities(a), jaccard_join.parities(b)
        assert len(one) == jaccard_join._SKETCH
        assert sum(int(x).bit_count() for x in (one ^ two).view(np.uint64)) <= len(np.setxor1d(a, b))
