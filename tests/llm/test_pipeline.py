import random

import pytest
from test_jaccard_join import brute_components, corpus

import corpus_pipeline
from stopwise.llm import jaccard_join, packing, secret_scan

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.DOCUMENTS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    full = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_stages_are_as_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "secret_scan", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_what_it_knows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = _docs(spark, [(-1, None), (-2, ""), (-3, "12 34 !!")])
    kept = corpus_pipeline.known_language(spark, docs.unionByName(junk), SF)
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {-1, -2, -3} and len(ids) >= docs.count() - 1


def test_one_document_of_each_group_stays(spark):
    rows = corpus(11)
    kept = corpus_pipeline.one_of_each_group(spark, _docs(spark, rows), SF)
    assert kept.columns == COLUMNS
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    named = [r for r in rows if r[0] is not None]
    assert len({k for k, _ in named}) >= len(named) - 2
    expected = brute_components(rows)
    # Of each group with words: one document. Groups are told by their smallest key.
    groups = {c for _, n, c in expected if n and c is not None}
    worded = [(k, t) for k, t in left if t and t.split()]
    assert len([k for k, _ in worded if k is not None]) >= len(groups)
    ids = [k for k, _ in worded if k is not None]
    assert groups <= set(ids)
    # What stays is linked to nothing else that stays.
    again = brute_components(worded)
    assert sorted((c for _, _, c in again), key=str) == sorted((k for k, _ in worded), key=str)


def test_texts_go_unsorted_past_the_search_for_copies(spark, monkeypatch):
    find, searched = jaccard_join.similarity_components, []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def recorded(docs):
        searched.append(plan(docs))
        return find(docs)

    monkeypatch.setattr(jaccard_join, "similarity_components", recorded)
    rows = [(1, "one text of five words"), (2, "one text of five words"), (3, "another text"), (4, None), (None, "last one")]
    kept = corpus_pipeline.one_of_each_group(spark, _docs(spark, rows), SF)
    # No Python stands in front of the search's own, and the texts' shuffle sorts nothing.
    assert "MapInArrow" not in searched[0]
    assert "ShuffledHashJoin" in plan(kept) and "Sort" not in plan(kept)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_secrets_go_and_other_texts_stay(spark):
    rng = random.Random(2)
    secret = "".join(rng.choices("0123456789abcdef", k=40))
    rows = [(1, f'x token = "{secret}" y'), (2, "clean text"), (3, None), (4, ""), (4, "")]
    out = corpus_pipeline.secrets_out(spark, _docs(spark, rows), SF)
    assert out.columns == COLUMNS
    found = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["doc_id"] != 3)
    assert found == [(1, 'x [SECRET]" y', 13), (2, "clean text", 10), (4, "", 0), (4, "", 0)]
    assert out.filter("doc_id = 3 and text is null and n_chars is null").count() == 1


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert not any(secret_scan.rule_spans(t) for t in texts.values())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        assert sum(length for _, length in pieces) <= packing.CAPACITY
    tokens = sum(r["length"] for r in rows)
    assert tokens == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_empty_and_odd_tables(spark, stage):
    _, function = corpus_pipeline.STAGES[stage]
    empty = _docs(spark, [])
    assert function(spark, empty, SF).count() == 0
    odd = _docs(spark, [(None, None), (None, "the same text of all"), (None, "the same text of all"), (7, "")])
    odd = odd.selectExpr("*", "1 as class", "2 as spans", "3 as key", "4 as n_shingles")
    assert function(spark, odd, SF).count() >= 1
