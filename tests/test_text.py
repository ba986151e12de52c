import re
import sys
import unicodedata
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from veilcraft.functions import text as tx

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def test_strip_removes_what_python_strips(evaluate):
    texts = [f"{s}a{s}b{s}" for s in SPACES] + ["", "x", "​x​", " \t\n"]
    assert evaluate(tx.py_strip, texts) == [t.strip() for t in texts]


def test_casefold_agrees_where_the_result_is_ascii(evaluate):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [chr(c) for c in points if any("a" <= x <= "z" for x in chr(c).casefold())]
    assert len(texts) > 60
    assert evaluate(tx.casefold, texts) == [t.casefold() for t in texts]


@pytest.mark.parametrize("make", [tx.normalize_label])
def test_normalize_label(evaluate, make):
    texts = ["Client  Name!", "Straße_12", "ﬁeld", "", None, "###", " a-b "]
    assert evaluate(make, texts) == ["client name", "strasse 12", "field", "", None, "", "a b"]


def test_slug_pairs(spark):
    pairs = [
        ("Client Name", "A", "client-name"),
        ("Portfolio / Account #", "B", "portfolio-account"),
        ("", "A", "column-a"),
        ("Client: Internal ID", "C", "client-internal-id"),
        (None, "AB", "column-ab"),
        ("x" * 63 + " y", "A", "x" * 63),
        ("Größe", "A", "gr-sse"),
    ]
    df = spark.createDataFrame(pairs, "h string, c string, want string")
    for row in df.withColumn("got", tx.namespace_slug(F.col("h"), F.col("c"))).collect():
        assert row["got"] == row["want"]


def test_skip_values(evaluate):
    texts = ["Total", " (Blank) ", "GRAND TOTAL ", "", "  ", "totals", "\x1ftotal", None, "Grand  Total"]
    want = [True, True, True, True, True, False, True, False, False]
    assert evaluate(tx.is_skip_value, texts) == want


def test_looks_numeric(evaluate):
    cases = {
        "(2.180)": True, "(652)": True, "1,234.50": True, "+-12": True, " 12 ": True, "()": False,
        "": False, "-": False, "12-": False, "1e5": False, "(-5": False, "((5))": False, "²": True,
        "①": True, "٣": True, "Ⅷ": False, "1 000": True, "( 12 )": True, "a1": False, "(": False,
    }
    assert evaluate(tx.looks_numeric, list(cases)) == list(cases.values())


def test_every_digit_counts_as_numeric(evaluate):
    texts = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isdigit() or unicodedata.category(chr(c)) == "No"]
    assert evaluate(tx.looks_numeric, texts) == [t.isdigit() for t in texts]


def _is_float(text):
    try:
        float(text)
    except ValueError:
        return False
    return True


def test_float_spellings(evaluate):
    texts = [
        "1", "1.", ".5", "1.5e3", "1_000", "1__0", "_1", "1_", "1e1_0", "nan", "+NaN", "-inf", "Infinity", "infinit",
        "0x10", "1d", "1f", " 7 ", "\x1c7", "00123", "", " ", "1 2", "٣.٤", "1e", "e5", "--1", "+.5", ".", "1._5", "1_.5",
        "1\n", "²", "1,5",
    ]
    assert evaluate(tx.looks_float, texts) == [_is_float(t) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123_.eE+-naif \t", max_size=7), min_size=30, max_size=60))
def test_float_property(evaluate, texts):
    assert evaluate(tx.looks_float, texts) == [_is_float(t) for t in texts]


def test_cell_and_key_references(evaluate):
    got = evaluate(tx.cell_position, ["A1", "XFD1048576", "a1", "A", "1", "A1b", "$A$1", "A1\n"])
    assert [(r["col"], r["row"]) if r else None for r in got] == [
        ("A", 1), ("XFD", 1048576), None, None, None, None, None, ("A", 1),
    ]
    got = evaluate(tx.column_key_parts, ["0|A", "12|ZZ", "|A", "0|a", "0A", "x|A"])
    assert [(r["sheet_index"], r["col"]) if r else None for r in got] == [
        (0, "A"), (12, "ZZ"), None, None, None, None,
    ]


def test_column_order(spark, evaluate):
    names = ["A", "B", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert evaluate(tx.column_ordinal, names) == [1, 2, 26, 27, 52, 53, 702, 703]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "c string")
    assert [r["c"] for r in df.orderBy(tx.column_order(F.col("c"))).collect()] == names
    assert evaluate(tx.column_ordinal, ["A" * 40]) == [None]


def test_base64_round_trip(evaluate):
    data = [b"", b"a", bytes(range(256)), b"x" * 100, b"\xfb\xff\xfe"]
    coded = evaluate(tx.b64url_encode, data, "binary")
    assert all(re.fullmatch("[A-Za-z0-9_-]*", c) for c in coded)
    assert [bytes(b) for b in evaluate(tx.b64url_decode, coded)] == data


def test_token_shape(evaluate):
    body = "A" * 22
    cases = {
        f"note:{body}": True, f"note:{body[:-1]}": False, f"note:{body}\n": False, f"Note:{body}": False,
        f"-a:{body}": False, f"a-:{body}": False, f"a-b:{body}AAA": False, f"{'a' * 64}:{body}": True,
        f"{'a' * 65}:{body}": False, f"a:{body}=": False, f"a:b:{body}": False, body: False, f":{body}": False,
        f"a:{body}A": True, f"a:{body}AAAA": True,
    }
    assert evaluate(tx.is_token, list(cases)) == list(cases.values())
    assert evaluate(tx.is_token, [None]) == [False]
    parts = evaluate(tx.token_parts, [f"note:{body}", "plain"])
    assert (parts[0]["namespace"], parts[0]["ciphertext"], parts[1]) == ("note", body, None)


def test_relationship_targets(spark):
    cases = [
        ("xl/workbook.xml", "worksheets/sheet1.xml", "xl/worksheets/sheet1.xml"),
        ("xl/workbook.xml", "/xl/worksheets/sheet1.xml", "xl/worksheets/sheet1.xml"),
        ("xl/pivotTables/p.xml", "../pivotCache/d.xml", "xl/pivotCache/d.xml"),
        ("xl/a.xml", "..\\b\\.\\c.xml", "b/c.xml"),
        ("a.xml", "../../b.xml", "../../b.xml"),
        ("x/y.xml", "..", "."),
    ]
    df = spark.createDataFrame(cases, "s string, t string, want string")
    for row in df.withColumn("got", tx.resolve_target(F.col("s"), F.col("t"))).collect():
        assert row["got"] == row["want"]
    parts = spark.createDataFrame([("xl/workbook.xml",), ("a.xml",)], "s string")
    got = [r[0] for r in parts.select(tx.relationship_part(F.col("s"))).collect()]
    assert got == ["xl/_rels/workbook.xml.rels", "_rels/a.xml.rels"]


def test_suffixes(evaluate):
    names = ["a.XLSX", "b.tar.gz", ".xlsx", "a.", "noext", "x/y.z/q", "..pdf", "a.b", "ſ.DOCX", "a .pdf"]
    assert evaluate(tx.part_suffix, names) == [PurePosixPath(n).suffix.casefold() for n in names]
