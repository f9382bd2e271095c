import csv
import gzip
import io
import random
from collections import Counter

import pandas as pd
import pytest

from stopwise import schemas
from stopwise.sources import csv_files

CASES = {
    "long and short lines": "a,b,c\n1,2,3\n4,5\n6,7,8,9\n",
    "trailing comma is one field too many": "a,b,c\n1,2,3\n1,2,3,\n4,,\n",
    "quoted separators": 'a,b,c\n1,"x,y",3\n2,"q""z,,,",4\n3,"p,q",4,5\n4,"r,s"\n',
    "blank lines": "a,b,c\n\n1,2,3\n\n",
    "missing values": "a,b,c\n" + "".join(f"k{n},{t},1\n" for n, t in enumerate(csv_files.NA_TOKENS)),
}


@pytest.mark.parametrize("name", CASES)
def test_lines_are_kept_and_skipped_as_by_pandas(spark, tmp_path, name):
    (tmp_path / "x.csv").write_text(CASES[name])
    df = csv_files.read_text_csv(spark, str(tmp_path))
    cleaned = df.select([csv_files.null_na_tokens(df[c]).alias(c) for c in df.columns])
    ours = [tuple(r) for r in cleaned.collect()]
    frame = pd.read_csv(io.StringIO(CASES[name]), on_bad_lines="skip", dtype=str)
    theirs = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    assert ours == theirs
    assert df.count() == len(theirs)
    assert df.select("a").count() == len(theirs)


def test_raw_records_are_typed_by_header_name(spark, tmp_path):
    names = [n for n, _ in schemas.RAW_FIELDS][::-1]
    values = {"DirectionRef": "1.0", "OriginLat": "40.5", "OriginLong": "NaN", "VehicleRef": "NA",
              "DistanceFromStop": "far"}
    line = ",".join(values.get(n, "x" if n.endswith(("Name", "Text")) else "") for n in names)
    (tmp_path / "x.csv").write_text(",".join(names) + "\n" + line + "\n")
    raw = csv_files.read_raw_csv(spark, str(tmp_path))
    assert raw.schema == schemas.raw_schema()
    row = raw.first()
    assert (row.DirectionRef, row.OriginLat, row.OriginLong) == (1, 40.5, None)
    assert (row.VehicleRef, row.DistanceFromStop, row.OriginName) == (None, None, "x")


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n')
    (tmp_path / "y.csv").write_text("a,b\n3,plain\n")
    df = csv_files.read_text_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [("1", "two\nlines"), ("3", "plain")]


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("\nb,a,c\n4,3,5\n6,5\n")
    (tmp_path / "z a.csv").write_text("b\n7\n")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "w.csv.gz", "wt") as f:
        f.write("b,a\n9,8\n")
    df = csv_files.read_text_csv(spark, str(tmp_path))
    rows = sorted(((r.a, r.b, r.c) for r in df.collect()), key=str)
    assert rows == sorted([("1", "2", None), ("3", "4", "5"), ("5", "6", None), (None, "7", None), ("8", "9", None)], key=str)


def test_no_files(spark, tmp_path):
    assert csv_files.read_raw_csv(spark, str(tmp_path)).count() == 0


def _read_in_ranges(spark, path, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(size))
        df = csv_files.read_text_csv(spark, str(path))
        return df.rdd.getNumPartitions(), Counter(tuple(r) for r in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _random_csv(seed, rows=160):
    """Records of three fields with line breaks, commas and doubled quotes in quotes."""
    rng = random.Random(seed)
    inside = ["x", "long words here", ",", "\n", "\n\n", '"', "é", "z,y\n"]
    records = [["".join(rng.choice(inside) for _ in range(rng.randint(0, 6))) for _ in range(3)] for _ in range(rows)]
    for n in range(0, rows, 5):
        records[n] = [f"plain {n}", 'unquoted 5" mark', str(n)]  # a quote that opens nothing
    out = io.StringIO()
    for n, r in enumerate(records):
        if n % 5:
            csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerow(r)
        else:
            out.write(",".join(r) + "\n")
    return "a,b,c\n" + out.getvalue(), Counter(tuple(v or None for v in r) for r in records)


@pytest.mark.parametrize("size", [37, 300, 1 << 20])
def test_records_over_several_ranges(spark, tmp_path, size):
    """Ranges that begin in the middle of fields, and some that lie wholly inside one."""
    text, expected = _random_csv(size)
    text += '"' + "inside\n" * 60 + '",last,1\n'
    expected[("inside\n" * 60, "last", "1")] += 1
    (tmp_path / "x.csv").write_text(text)
    tasks, rows = _read_in_ranges(spark, tmp_path, size)
    assert Counter({tuple(v or None for v in r): n for r, n in rows.items()}) == expected
    assert tasks > 5 or size > 300


def test_headers_over_lines_and_blank_lines_before(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\n\n"a\nb",c\n1,"x\ny"\n\n2,z,too many\n3\n')
    (tmp_path / "y.csv").write_text('\nc,d\n"5\n6",7\n')
    _, rows = _read_in_ranges(spark, tmp_path, 11)
    columns = csv_files.read_text_csv(spark, str(tmp_path)).columns
    assert sorted(columns) == ["a\nb", "c", "d"]
    named = Counter(tuple(sorted((c, v) for c, v in zip(columns, r) if v is not None)) for r in rows)
    assert named == Counter([(("a\nb", "1"), ("c", "x\ny")), (("a\nb", "3"),), (("c", "5\n6"), ("d", "7"))])


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n3,"open\nto the\nend\n')
    _, rows = _read_in_ranges(spark, tmp_path, 9)
    assert rows[("1", "2")] == 1 and sum(rows.values()) <= 2
