"""From raw documents to packed sequences.

Each stage takes all that the one before kept; its result is a table that the next
one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import jaccard_join, language_id, queries, secret_scan
from stopwise.llm.common import pick, stored

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in DOCUMENTS})


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` stays as it was. Null texts,
    such without letters and those under the calibrated share go."""
    docs = _documents(docs)
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(docs, model, keep=DOCUMENTS[1:])
    return judged.filter("accepted").select(*DOCUMENTS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null ids
    last; of rows with that id and the same words any one. Documents without words
    stay."""
    docs = _documents(docs)
    groups = jaccard_join.similarity_components(docs).filter("class is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "class", "copies")
    chosen = stored(
        groups.groupBy("component", "doc_id", "class")
        .agg(F.count("*").alias("copies"))
        .groupBy("component")
        .agg(F.min(order).alias("one"))
        .select(F.col("one.doc_id").alias("kept_id"), F.col("one.class").alias("kept_class"), F.col("one.copies").alias("copies"))
    )
    # The texts pass through Python and a shuffle once more, beside the choice and unsorted.
    named = jaccard_join.with_class(docs)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("class") == F.col("kept_class"))
    kept = named.join(chosen.hint("shuffle_hash"), same, "left").filter("class is null or copies is not null")
    once = kept.filter("class is null or copies = 1").select(*DOCUMENTS)
    if chosen.filter("copies > 1").isEmpty():
        return once
    return once.unionByName(kept.filter("copies > 1").dropDuplicates(["doc_id", "class"]).select(*DOCUMENTS))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    docs = _documents(docs)
    formats = secret_scan.learn_formats(docs)
    scanned = secret_scan.redacted(secret_scan.scan(docs, formats, keep=DOCUMENTS[2:]))
    changed = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return scanned.withColumn("n_chars", changed).select(*DOCUMENTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences; see ``op5_packing``."""
    return queries.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("secret_scan", secrets_out),
    ("packing", sequences),
]
# Models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
