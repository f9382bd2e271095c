"""WARC archives: writing with revisits, and a splittable reader.

An archive is a sequence of gzip members with one record each. A reading task
takes a byte range, looks for the gzip magic in it, takes a candidate for a
member if it decodes to a WARC header, and owns the records that start inside its
range; the last one is read beyond its end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import pick, text_slices

SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_START = b"WARC/"
_CHUNK = 1 << 18
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: name space of URLs
_DATE = "2000-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A header's value may hold no line break; such and other control characters
    are escaped."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def _record_id(page: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{row}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    record = f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record(page: int | None, row: int, url: str | None, payload: bytes, original: tuple | None) -> bytes:
    """A response, or a revisit of ``original`` (page, row), as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, row)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if url is None else _header_value(url)),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", None if page is None else str(page)),
    ]
    if original is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(*original)),
            ("X-Refers-To-Page-ID", None if original[0] is None else str(original[0])),
        ]
    return _member(headers, http + (payload if original is None else b""))


def write_archives(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0
) -> None:
    """A record for every row of ``df``, in ``.warc.gz`` style part files in ``folder``.

    Of rows with equal payloads (UTF-8, null as empty) of ``least`` bytes or more,
    that with the largest key is the response and the others revisit it; of equal
    keys the row that comes last in the scan. Null keys come before all others. The
    key is a whole number. Groups are found by digest with partial maxima, so a
    payload that a third of the rows have costs a row per task; its rows are joined
    to one row, which adaptive execution splits. ``df`` is read twice and must give its
    rows in the same order both times, as a stored table does. Spark's text writer commits the
    files, so lost executors leave no half-written ones.
    """
    rows = pick(df, page=key, url=url, html=payload).select(
        F.col("page").cast("long").alias("page"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )
    size = F.octet_length("html")
    rows = rows.withColumn("digest", F.when(size >= least, F.concat_ws(":", F.sha1("html"), size)))
    last = F.max(F.struct(F.col("page").isNotNull().alias("known"), "page", "row")).alias("last")
    groups = rows.filter("digest is not null").groupBy("digest").agg(last, F.count("*").alias("n")).filter("n > 1")
    shared = groups.select(F.col("digest").alias("shared"), "last")
    joined = rows.join(shared, rows["digest"] == shared["shared"], "left").select(
        "page", "row", "url", "html", F.col("last.page").alias("last_page"), F.col("last.row").alias("last_row")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 3):
                members = []
                for page, row, address, html, last_page, last_row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    original = None if last_row is None or last_row == row else (last_page, last_row)
                    member = _record(page, row, address, html, original)
                    # The writer ends every row with a zero byte, which is the last of
                    # the member's size below 16 MB; an empty member ends the others.
                    if member[-1]:
                        member += zlib.compressobj(6, zlib.DEFLATED, 31).flush()
                    members.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])

    packed = joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").text(folder)


class _Range:
    """Bytes of a file from a position on, read as they are needed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.ended = file, start, b"", False

    def _more(self) -> bool:
        if not self.ended:
            self.file.seek(self.start + len(self.data))
            new = self.file.read(_CHUNK)
            self.ended = not new
            self.data += new
        return not self.ended

    def find(self, magic: bytes, at: int) -> int:
        """Absolute place of the next ``magic`` from ``at`` on, -1 at the end of file."""
        while True:
            found = self.data.find(magic, at - self.start)
            if found >= 0:
                return self.start + found
            at = max(at, self.start + len(self.data) - len(magic) + 1)
            if not self._more():
                return -1

    def drop(self, before: int) -> None:
        gone = min(max(0, before - self.start), len(self.data))
        self.data, self.start = self.data[gone:], self.start + gone

    def chunks(self, at: int) -> Iterator[bytes]:
        while True:
            if at - self.start < len(self.data):
                chunk = self.data[at - self.start : at - self.start + _CHUNK]
                at += len(chunk)
                yield chunk
            elif not self._more():
                return


def _decoded(source: _Range, at: int, whole: bool) -> tuple[bytes, int] | None:
    """The member at ``at`` and the place after it, or its first bytes only; None if
    it is no member or breaks off."""
    unpacker, out = zlib.decompressobj(31), []
    used = at
    try:
        for chunk in source.chunks(at):
            out.append(unpacker.decompress(chunk, 0 if whole else 64))
            used += len(chunk)
            if unpacker.eof:
                return b"".join(out), used - len(unpacker.unused_data)
            if not whole and sum(map(len, out)) >= len(_START):
                return b"".join(out), used
    except zlib.error:
        return None
    return None


def _parsed(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block; None if it is no whole record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith(_START.decode()):
        return None
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), value.strip())
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) > len(rest):
        return None
    return headers, rest[: int(length)]


def range_records(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records whose members start in [start, end).

    Inside the range a member follows the one before; after damage, and at the
    start, the next place is found by the magic, and a candidate counts only if it
    decodes to a WARC header.
    """
    source, at = _Range(file, start), start
    while True:
        at = source.find(_MAGIC, at)
        if at < 0 or at >= end:
            return
        source.drop(at)
        first = _decoded(source, at, whole=False)
        member = None
        if first is not None and first[0].startswith(_START):
            member = _decoded(source, at, whole=True)
        record = _parsed(member[0]) if member else None
        if record is None:
            at += 1
            continue
        yield at, *record
        at = member[1]


_FIELDS = (
    "file string, place long, record_type string, record_id string, refers_to_id string, url string,"
    " payload_digest string, payload_bytes long, page_id long, refers_to long, payload binary"
)
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives under ``path``: ``file, place`` (byte offset),
    ``record_type, record_id, refers_to_id, url, payload_digest`` (without its
    ``sha1:``), ``payload_bytes`` (of the full payload, for revisits too), ``page_id,
    refers_to, payload`` (null for revisits).

    Tasks take byte ranges of ``split_bytes``, whatever the files' sizes, through
    pyarrow's file systems (local, HDFS, S3, GCS by the path's scheme); they hold one
    record and a quarter MB at a time. Damaged members are passed over. Empty files
    have no records.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", F.explode(starts).alias("start"))
    # A range is a few bytes, so only a stated number keeps them from one task.
    dealt = ranges.repartition(max(1, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with system.open_input_file(local) as file:
                    for place, headers, block in range_records(file, start, start + split_bytes):
                        rows.append((name, place, *_described(headers, block)))
                        held += len(block)
                        if held > 2_000_000:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return dealt.mapInArrow(read, _FIELDS)


def _described(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    revisit = kind == "revisit"
    size = int(told[0]) if revisit and told and told[0].isdigit() else len(payload)
    return (
        kind,
        headers.get("warc-record-id"),
        headers.get("warc-refers-to"),
        headers.get("warc-target-uri"),
        headers.get("warc-payload-digest", "").removeprefix("sha1:"),
        size,
        _number(headers.get("x-page-id")),
        _number(headers.get("x-refers-to-page-id")),
        None if revisit else payload,
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)
