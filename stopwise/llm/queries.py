"""The queries of this package's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import (
    byte_bpe,
    jaccard_join,
    language_id,
    packing,
    residual_packing,
    rotated_codes,
    secret_scan,
    spelling,
    spot_signatures,
    token_alignment,
    unigram_count,
    url_rules,
    warc,
)
from stopwise.session import shared_folder

# The host rules of the URL query.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_BYTE_BPE = "byte_bpe_50k.json"
_WORD_BPE = "word_bpe_49k.json"
_PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    folder = f"{shared_folder(spark)}/archives"
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _kind_count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by the rules and by learned formats."""
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn_formats(docs))
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.FORMAT)
    return found.select(
        "doc_id",
        *[_kind_count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    pieces = unigram_count.pieces_of(public_tokenizers.path(_PIECES))
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    index = rotated_codes.build_index(_table(spark, sf_dir, "embeddings"))
    found = rotated_codes.search(index, index.filter("key % 20 = 0"), 20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids in the place of the ids."""
    pieces = packing.token_pieces(docs, public_tokenizers.path(_WORD_BPE))
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign(narrow)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the host rules and by rules mined from the labels."""
    pages = _table(spark, sf_dir, "pages")
    judged = url_rules.judge(pages, mined_url_rules(spark, sf_dir), HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# A quarter of the labelled pages is blocked: a rule must stand well above that.
URL_CONFIDENCE = 0.35


def mined_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of ``op6_url_filter``, from all labelled pages."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels")
    blocked = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", blocked.alias("blocked"))
    return url_rules.mine_rules(labelled, min_confidence=URL_CONFIDENCE)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    path = public_tokenizers.path(_BYTE_BPE)
    coded = byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 5-gram sets are alike to 0.8."""
    found = jaccard_join.similarity_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their half-replaced editions and of the next ones."""
    compared = spot_signatures.compare_with_next(_table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    predicted = language_id.predict(docs, language_id.fit(docs.filter(~held_out)))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed whole into sequences of 2048 tokens by best fit."""
    docs = _table(spark, sf_dir, "documents")
    pieces = residual_packing.token_pieces(docs, public_tokenizers.path(_BYTE_BPE))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return residual_packing.assign(narrow)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More usual spellings of all words of the documents, with planted slips."""
    words = spelling.count_words(_table(spark, sf_dir, "documents"), slip_every=97)
    return spelling.spelling_forms(words)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over all documents, aligned and linked."""
    docs = _table(spark, sf_dir, "documents")
    paths = [public_tokenizers.path(name) for name in (_BYTE_BPE, _PIECES)]
    return token_alignment.link_statistics(docs, *paths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        op1_warc,
        op2_secret_scan,
        op3_token_counts,
        op4_nearest,
        op5_packing,
        op6_url_filter,
        op7_bpe,
        op8_jaccard_join,
        op9_spot_signatures,
        op10_language_id,
        op11_residual_packing,
        op12_spelling,
        op13_token_alignment,
    ]
    return {q.__name__: q for q in registered}
