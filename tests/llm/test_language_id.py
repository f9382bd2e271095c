import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        doc = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in doc["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and doc["lang"]:
            right.append(r["lang_pred"] == doc["lang"])
    assert len(right) > 100 and np.mean(right) > 0.98


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_rejection_is_rare_and_hits_what_is_none(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = language_id.predict(docs, model)
    assert judged.filter("not accepted").count() <= 3
    rows = [(1, None), (2, ""), (3, "12 + 3 = 15 ..."), (4, "the of and in that"), (4, "the of and in that"), (None, "der die und das")]
    df = spark.createDataFrame([(*r, "en", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    found = sorted(((r["doc_id"] or 0, r["lang_pred"], r["accepted"]) for r in language_id.predict(df, model).collect()))
    assert found == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True)]


def test_predictions_use_the_text_alone(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", -F.col("doc_id"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    b = {-r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(changed, model).collect()}
    assert a == b


def test_whole_texts_count(spark, model):
    text = "der die und das ist nicht auch " + "the of and that was with from " * 3000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert language_id.predict(df, model).first()["lang_pred"] == "en"


def test_sample_is_bounded(spark):
    rows = [("the same text",) for _ in range(500)]
    df = spark.createDataFrame(rows, "text string").withColumn("lang", F.lit("en"))
    fitted = language_id.fit(df, max_rows=40)
    assert fitted is None or fitted.languages == ["en"]


@pytest.mark.parametrize("rows", [[], [("text", None)], [(None, "en")], [("...", "en")]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1))
    fitted = language_id.fit(df)
    assert fitted is None
    assert language_id.predict(df, fitted).filter("lang_pred = 'und' and score = 0 and not accepted").count() == len(rows)
