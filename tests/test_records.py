"""Records that fail to parse: block parsing against the strict reading of each record."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import records as R
from quillspark.operators.records import diagnose, parse_records

CASES = [
    ("1\t2\t3\ttext", "\t", None),
    (" 1a\t2 \t\t", "\t", None),
    ('1,"2",3,"a, ""b"""', ",", None),
    ('1,2,3,"two\nlines"\r', ",", None),
    ("1,2,3,two\nlines", ",", None),
    ('1,2,3,a "b" c', ",", "quoting"),
    ('1,2,3,"open', ",", "quoting"),
    ('1,2,3, "late"', ",", "quoting"),
    ('1,2,3,"shut" ', ",", "quoting"),
    ("1,2,3", ",", "columns"),
    ("1,2,3,4,5", ",", "columns"),
    (None, ",", "columns"),
    ("", ",", "columns"),
    ("\t\t\t", "\t", "columns"),
    (" \r", ",", "columns"),
    ("1;2;3;4", ",", "columns"),
    ("01,2,3,x", ",", "value"),
    ("12345,2,3,x", ",", "value"),
    ("1ab,2,3,x", ",", "value"),
    ("1,x,3,x", ",", "value"),
    ("1,2,3,x\x07", ",", "value"),
    ("1,2,3,x�", ",", "value"),
    ("1,2,3,x\r\r", ",", "value"),
    ("1,2,3,x\ty", ",", None),
    ("﻿1,2,3,x", ",", "value"),
    ('"1","2"', None, "quoting"),
    ("1,2,3,4", None, "columns"),
    ("1,2,3,4", "", "columns"),
    ('1"2"3"4', '"', "quoting"),
    ("1¦2¦3¦x", "¦", None),
    ('1¦2¦3¦"a¦b ""c"""', "¦", None),
    ("1¦2¦3¦x\x1f", "¦", "value"),
    ("1¦2¦3", "¦", "columns"),
    ("1ab2ab3abx", "ab", None),
    ('1,2,3,"a', ",", "quoting"),
    ('b"', ",", "quoting"),
    ("1,2,3,x\ry", ",", "value"),
]


def test_strict_cases():
    for raw, sep, reason in CASES:
        assert diagnose(raw, sep).reason == reason, (raw, sep)


def test_blocks_agree_with_strict_reading(spark):
    rows = [(k, sep, raw, "x", "y") for k, (raw, sep, _) in enumerate(CASES * 40)]
    df = spark.createDataFrame(rows, "id long, sep string, raw string, reason string, text string")
    got = {r["id"]: r for r in parse_records(df, "id", "sep", "raw").collect()}
    assert len(got) == len(rows)
    for k, sep, raw, *_ in rows:
        want = diagnose(raw, sep)
        assert got[k]["reason"] == want.reason
        fields = want.fields or (None,) * 4
        assert tuple(got[k][c] for c in ("chapter", "section", "line", "text")) == fields
    bad = {(r["id"], r["reason"]) for r in parse_records(df, "id", "sep", "raw", only_failures=True).collect()}
    assert bad == {(k, diagnose(raw, sep).reason) for k, sep, raw, *_ in rows if diagnose(raw, sep).reason}


def test_empty_table_repeats_and_long_text(spark):
    schema = "id long, sep string, raw string"
    assert parse_records(spark.createDataFrame([], schema), "id", "sep", "raw").count() == 0
    long = "1,2,3," + "x" * 3_000_000
    out = parse_records(spark.createDataFrame([(1, ",", long), (1, ",", long)], schema), "id", "sep", "raw").collect()
    assert [len(r["text"]) for r in out] == [3_000_000] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='12a",\n\r\t x;', max_size=14), min_size=1, max_size=90), st.sampled_from([",", "\t", ";"]))
def test_any_records(raws, sep):
    array = pa.array(raws, pa.string())
    got = [None] * len(raws)
    for places, cols, found in R._solve(array, sep):
        for k, at in enumerate(places):
            got[at] = (None, tuple(c[k].as_py() for c in cols)) if cols is not None else (found[k].reason, found[k].fields)
    assert got == [(p.reason, p.fields) for p in (diagnose(r, sep) for r in raws)]


def test_bad_records_are_isolated_by_bisection():
    raws = [f"{k % 900 + 1},2,3,text {k}" for k in range(3000)]
    failed: list[int] = []
    assert all(cols is not None for _, cols, _ in R._solve(pa.array(raws), ",", failed)) and failed == []
    raws[1700] = '1,2,3,a "b"'
    strict = [(list(places), [p.reason for p in found]) for places, cols, found in R._solve(pa.array(raws), ",", failed) if cols is None]
    assert failed[0] == 3000 and failed[-1] <= R.STRICT_ROWS and len(failed) == 10
    ((places, reasons),) = strict
    assert len(places) <= R.STRICT_ROWS and dict(zip(places, reasons, strict=True))[1700] == "quoting" and reasons.count(None) == len(places) - 1


def test_planted_records_are_bisected():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/citation_rows.parquet")
    failed: list[int] = []
    for sep in (",", ";", "\t"):
        part = table.filter(pa.compute.equal(table.column("sep_char"), sep)).column("raw_line").combine_chunks()
        for _ in R._solve(part, sep, failed):
            pass
    assert len(failed) > 50


def test_columns_passed_through(spark):
    df = spark.createDataFrame([(1, ",", "1,2,3,x", "f", 5), (2, ",", "1,2", None, 6)], "id long, sep string, raw string, text string, k1 int")
    out = parse_records(df, "id", "sep", "raw", keep=("k1",))
    assert out.columns == ["id", "k1", "chapter", "section", "line", "text", "reason"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, "1", "2", "3", "x", None), (2, 6, None, None, None, None, "columns")]
