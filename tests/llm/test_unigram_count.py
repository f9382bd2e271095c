import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from stopwise.llm import unigram_count
from stopwise.llm.unigram_count import SPACE, Lattice

BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def _library(pieces, byte_fallback=True):
    return Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=byte_fallback))


def _expected(library, text):
    return len(library.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids) if text else 0


@settings(max_examples=150, deadline=None)
@given(
    st.dictionaries(st.text(alphabet="abc" + SPACE, min_size=1, max_size=4), st.integers(-6, -1), min_size=1, max_size=25),
    st.text(alphabet="abcdé \n", max_size=40),
    st.booleans(),
)
def test_ties_and_unknowns_count_as_in_the_library(vocabulary, text, with_bytes):
    pieces = [(p, float(s)) for p, s in vocabulary.items()] + (BYTES if with_bytes else [])
    assert Lattice(pieces).count_text(text, {}) == _expected(_library(pieces, with_bytes), text)


def test_a_public_vocabulary(spark):
    pieces = unigram_count.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    library = _library(pieces)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(None, None), (-1, ""), (-2, "  a  \n\n b\t日本 😀" + "x" * 3000), (-2, "a")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    expected = sorted((r["doc_id"] or 0, _expected(library, r["text"] or "")) for r in rows.collect())
    found = unigram_count.count_tokens(rows, pieces).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == expected


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ab", 7)], "doc_id long, text string, n_tokens int")
    pieces = [("a", -1.0), ("ab", -3.0), ("b", -1.0), (SPACE, -1.0), *BYTES]
    assert [tuple(r) for r in unigram_count.count_tokens(df, pieces).collect()] == [(1, 3)]
    assert unigram_count.count_tokens(df.limit(0), pieces).count() == 0
