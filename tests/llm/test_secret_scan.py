import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stopwise.llm import grammar, secret_scan

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def _base(text):
    """The rules as they are worded."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def _hex(rng, n=40):
    return "".join(rng.choices("0123456789abcdef", k=n))


def _mixed(rng, n=32):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n))


PARTS = st.one_of(
    st.sampled_from(["token", "PassWord", "api_key", "APIKEY", "ſecret", "toKen", "AKIA", "=", ": ", '"', " ", "é", "\n", "'"]),
    st.text(alphabet="abcdef0123456789", max_size=40),
    st.text(alphabet="AKIZ019", max_size=25),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_rules_as_worded(text):
    assert [f"{k}:{s}:{e}" for s, e, k, _ in secret_scan.rule_spans(text)] == _base(text)


def _corpus(rng):
    words = ["the", "Donaudampfschifffahrtsgesellschaft", "of", "and", "letters", "in", "2024-01-02", "x"]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            text.insert(10, f'token = "{_hex(rng)}"')
        if i % 4 == 1:
            text.insert(7, f"secret: {_mixed(rng)}")
        if i % 5 == 0:
            text.insert(3, "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)))
        rows.append((i, " ".join(text)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame(_corpus(random.Random(5)), "doc_id long, text string")
    return df, secret_scan.learn_formats(df)


def test_learned_formats_add_spans_and_leave_words_alone(spark, learned):
    df, formats = learned
    rng = random.Random(6)
    bare = _mixed(rng)
    rows = [
        (1, f"é see {bare} there"),
        (2, "Rechtsschutzversicherungsgesellschaften 1234-5678-9012-3456-7890 a-b-c-d-e-f-g-h-i-j-k-l-m"),
        (3, "9" * 40),
    ]
    found = {
        r["doc_id"]: r["spans"]
        for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), formats).collect()
    }
    assert [(s["kind"], s["start"], s["end"]) for s in found[1]] == [("format", 6, 38)]
    assert found[1][0]["score"] > 0 and found[2] == []


def test_base_spans_stay(spark, learned):
    df, formats = learned
    for row in secret_scan.scan(df, formats).collect():
        base = [s for s in row["spans"] if s["kind"] != secret_scan.FORMAT]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in base] == _base(row["text"])
        assert len(base) == len(row["spans"])


def test_whole_table_by_query(spark):
    import hashlib

    from stopwise.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(b.startswith(k) for b in base) for k in secret_scan.KINDS
        ]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == base


def test_redaction(spark):
    text = 'é token = "' + "a1" * 20 + '" and ' + "0f" * 15 + "."
    df = spark.createDataFrame([(1, text, 2), (2, None, 3), (3, "", 4), (4, "plain", 5)], "doc_id long, text string, spans int")
    scanned = secret_scan.scan(df, None)
    found = {r["doc_id"]: r["text"] for r in secret_scan.redacted(scanned).collect()}
    assert found == {1: 'é [SECRET]" and [SECRET].', 2: None, 3: "", 4: "plain"}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "token"), (1, "token")], "doc_id long, text string")
    for rows in (df, df.limit(0)):
        formats = secret_scan.learn_formats(rows)
        assert not formats.automata
        assert all(r["spans"] == [] for r in secret_scan.scan(rows, formats).collect())


def test_automaton_generalises():
    rng = random.Random(1)
    strings = [grammar.symbols(_hex(rng)) for _ in range(300)]
    automaton = grammar.Automaton(strings)
    assert len(automaton.states) < 10
    unseen, words = grammar.symbols(_hex(rng)), grammar.symbols("internationalisationsmassnahmenabcdefghi")
    assert automaton.log_likelihood(unseen) > automaton.log_likelihood(words) + 50


def test_automaton_tells_branches_apart():
    strings = [grammar.symbols("0" * 5 + "A" * 5)] * 100 + [grammar.symbols("g" * 10)] * 100
    automaton = grammar.Automaton(strings)
    like = [automaton.log_likelihood(grammar.symbols(s)) for s in ("00000AAAAA", "gggggggggg", "0000000ggg")]
    assert min(like[:2]) > like[2]


def _labelled(spark, value, n=400):
    """Formats learned from ``value`` behind a label, among plain words."""
    rng = random.Random(11)
    words = ["the", "Meeting", "of", "another", "letters", "in", "Saturday.", "end.", "U.S.A.", "12", "x"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        if i % 2 == 0:
            text.insert(9, f"secret: {value(rng)}")
        if i % 4 == 1:
            text.insert(3, "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, secret_scan.learn_formats(df)


@pytest.mark.parametrize(
    "value",
    [
        lambda rng: _mixed(rng, 14),
        lambda rng: ".".join(_mixed(rng, 12) for _ in range(3)),
        lambda rng: "".join(rng.choices(string.ascii_letters, k=30)),
        lambda rng: "".join(rng.choices(string.digits, k=21)),
    ],
    ids=["short", "dotted", "letters", "digits"],
)
def test_bare_credentials_of_any_labelled_form(spark, value):
    df, formats = _labelled(spark, value)
    rng = random.Random(12)
    for _ in range(20):
        bare = value(rng)
        text = f"see {bare} there"
        found = [(k, text[s:e]) for s, e, k, _ in secret_scan.spans_of(text, formats)]
        assert found == [("format", bare)] or found[0][0] == "hex"
    for row in secret_scan.scan(df, formats).collect():
        assert all(s["kind"] != secret_scan.FORMAT for s in row["spans"])


def test_second_secret_beside_a_rule_span(learned):
    _, formats = learned
    rng = random.Random(13)
    one, two, access = _mixed(rng), _mixed(rng), "AKIA" + "Q7" * 8
    text = f"{access}/{one} and {two}/token={_hex(rng)} end"
    found = [text[s:e] for s, e, k, _ in secret_scan.spans_of(text, formats) if k == secret_scan.FORMAT]
    assert found == [one, two]
    sentence = f"see {one}."
    assert [sentence[s:e] for s, e, _, _ in secret_scan.spans_of(sentence, formats)] == [one]
