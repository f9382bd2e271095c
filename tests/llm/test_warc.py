import base64
import gzip
import hashlib
import os
import random

import pytest

from stopwise.llm import warc
from stopwise.session import shared_folder


def _expected(rows, least=0):
    """Brute force: (page, size, digest, kind, refers_to) of every row, in order."""
    last = {}
    for place, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        mark = (page is not None, page or 0, place)
        if len(payload) >= least:
            last[payload] = max(last.get(payload, mark), mark)
    out = []
    for place, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        mark = (page is not None, page or 0, place)
        revisit = len(payload) >= least and last[payload] != mark
        kind = "revisit" if revisit else "response"
        to = (last[payload][1] if last[payload][0] else None) if revisit else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, kind, to))
    return sorted(out, key=str)


def _round_trip(spark, rows, least=0, split=warc.SPLIT_BYTES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark)
    warc.write_archives(df, folder, least=least)
    return folder, warc.read_archives(spark, folder, split).collect()


def _facts(records):
    return sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records),
        key=str,
    )


ROWS = [
    (1, "http://a/é?x=1", "<p>ä</p>"),
    (5, None, "<p>ä</p>"),
    (3, "no\r\nX-Page-ID: 9", "<p>ä</p>"),
    (2, "", ""),
    (9, "http://b", None),
    (9, "http://b", None),
    (None, "http://c", "alone"),
    (None, "http://c", "pair"),
    (None, "http://d", "pair"),
    (4, "http://e", "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://f", "x" * 300_000),
]


@pytest.mark.parametrize("split", [97, 1000, warc.SPLIT_BYTES])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, split, least):
    _, records = _round_trip(spark, ROWS, least, split)
    assert _facts(records) == _expected(ROWS, least)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in records if r["payload"] is not None}
    assert (4, ROWS[9][2].encode()) in payloads and (6, b"x" * 300_000) in payloads


def test_revisits_name_their_record(spark):
    _, records = _round_trip(spark, ROWS)
    ids = {r["record_id"]: r for r in records}
    assert len(ids) == len(records)
    for r in records:
        if r["record_type"] == "revisit":
            original = ids[r["refers_to_id"]]
            assert original["page_id"] == r["refers_to"] and original["payload_digest"] == r["payload_digest"]


def test_files_are_plain_gzip_members(spark):
    folder, records = _round_trip(spark, ROWS)
    text = b"".join(
        gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-")
    )
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) == len(records)


def test_members_of_16_mb_and_more(spark):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("ab", k=1000)) * 17_000) for i in range(2)]
    _, records = _round_trip(spark, rows, split=1 << 17)
    assert _facts(records) == _expected(rows)


def test_damage_costs_its_record_only(spark):
    rows = [(i, "u", f"text {i} " * 50) for i in range(20)]
    folder, records = _round_trip(spark, rows)
    name = next(f for f in os.listdir(folder) if f.startswith("part-"))
    places = sorted(r["place"] for r in records)
    with open(os.path.join(folder, name), "r+b") as f:
        f.seek(places[7] + 30)
        f.write(b"\xff" * 40)
    os.unlink(os.path.join(folder, f".{name}.crc"))
    left = {r["page_id"] for r in warc.read_archives(spark, folder, 150).collect()}
    lost = next(r["page_id"] for r in records if r["place"] == places[7])
    assert left == set(range(20)) - {lost}


def test_magic_that_is_no_member(spark):
    folder = shared_folder(spark)
    os.makedirs(folder)
    member = warc._record(1, 1, "u", b"payload", None)
    with open(os.path.join(folder, "a.warc.gz"), "wb") as f:
        f.write(b"\x1f\x8b\x08junk" + gzip.compress(b"no archive") + member + b"\x1f\x8b\x08" + member + b"\x1f\x8b")
    open(os.path.join(folder, "empty.warc.gz"), "wb").close()
    assert [r["page_id"] for r in warc.read_archives(spark, folder, 11).collect()] == [1, 1]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "h", 3, "d")], "page_id long, url string, html string, row int, digest string")
    folder = shared_folder(spark)
    warc.write_archives(df, folder)
    assert _facts(warc.read_archives(spark, folder).collect()) == _expected([(1, "u", "h")])
    folder = shared_folder(spark)
    warc.write_archives(df.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0
