import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilcraft.operators import (
    audit, cells as cell_ops, columns, dictionary, discover, gates, jobs, joins, overlay, paragraphs, pivot,
)
from veilcraft.functions.cipher import TokenCipher, CipherKey
from veilcraft.functions import names
from veilcraft.operators.discover import _outline, discover_columns
from veilcraft.plans.workbook import Workbooks, token_namespaces, unscrub
from pathlib import PurePosixPath


def cells_of(spark, sheets, formulas=()):
    """Cells of one file from {sheet: [(ref letters, row, value), …]}."""
    rows = [
        ("f", i, name, row, col, n, None, None, value, None)
        for i, (name, listed) in enumerate(sheets.items())
        for n, (col, row, value) in enumerate(listed)
    ]
    return spark.createDataFrame(rows, cell_ops.CELLS_SCHEMA)


def described(df):
    return {
        r["sheet_name"]: [(c["col"], c["header"], c["start_row"]) for c in r["columns"]]
        for r in discover.describe_sheets(df).collect()
    }


def test_header_choice(spark):
    cells = cells_of(spark, {
        "single": [("A", 3, "Only"), ("A", 4, "x"), ("B", 12, "late"), ("C", 1, "")],
        "deep": [("B", 20, "Name"), ("A", 21, "v"), ("C", 20, "old"), ("C", 20, "new"), ("AA", 40, "w")],
        "tie": [("A", 1, "Alpha"), ("B", 1, "Beta"), ("A", 2, "Gamma"), ("B", 2, "Delta")],
        "wide": [("A", 1, "Title"), ("B", 1, "12"), ("A", 2, "ab c"), ("B", 2, "de f"), ("C", 2, "  "), ("D", 9, "z")],
        "empty": [("A", 1, ""), ("B", 2, None)],
    })
    assert described(discover.discover_columns(cells)) == {
        "single": [("A", "Only", 4), ("B", "Column B", 4)],
        "deep": [("A", "Column A", 21), ("B", "Name", 21), ("C", "new", 21), ("AA", "Column AA", 21)],
        "tie": [("A", "Alpha", 2), ("B", "Beta", 2)],
        "wide": [("A", "ab c", 3), ("B", "de f", 3), ("C", "  ", 3), ("D", "Column D", 3)],
    }
    picked = {r["sheet_name"]: r["header_row"] for r in discover.header_pick(cells).collect()}
    assert picked == {"single": 3, "deep": 20, "tie": 1, "wide": 2}


def test_last_duplicate_reference_wins(spark):
    cells = cells_of(spark, {"s": [("A", 1, "First Name"), ("B", 1, "Other"), ("A", 1, "Last Name")]})
    assert described(discover.discover_columns(cells))["s"] == [("A", "Last Name", 2), ("B", "Other", 2)]
    scores = {r["row"]: (r["n_cells"], r["score"]) for r in discover.header_scores(cells).collect()}
    assert scores == {1: (2, 4 + 1 + 4 + 2)}


def test_rules_may_change_the_header(spark, cipher):
    from veilcraft.plans import workbook as plan

    cells = cells_of(spark, {"s": [("A", 1, "Client Name"), ("B", 1, "Notes"), ("A", 2, "Ann"), ("B", 2, "total")]})
    done = plan.scrub(plan.Workbooks(cells), cipher, None, [("Client", "Party")])
    assert [(r["namespace"], r["n"]) for r in done.counts.collect()] == [("party-name", 1)]
    with pytest.raises(gates.GateError, match="No values were found to encrypt"):
        plan.scrub(plan.Workbooks(cells), cipher, cell_ops.requested_keys(spark, ["0|B"])).require_changes("encrypt")
    with pytest.raises(gates.GateError, match="No replacement values were found in the workbook"):
        plan.replace_only(plan.Workbooks(cells), [("absent", "x")]).require_changes("replace")
    with pytest.raises(ValueError, match="At least one replacement rule"):
        plan.replace_only(plan.Workbooks(cells), [])


def test_data_rows(spark, cipher):
    cells = cells_of(spark, {"s": [
        ("A", 1, "Head One"), ("B", 1, "Head Two"), ("A", 2, "x"), ("A", 3, " Total "), ("A", 4, "  "), ("A", 5, ""), ("B", 2, "y"),
    ]})
    found = discover.discover_columns(cells)
    for small in (True, False):
        rows = cell_ops.data_rows(cells, cell_ops.select_columns(found, cell_ops.requested_keys(spark, ["0|A", "3|A", "zz"])), small)
        assert rows.count() == cells.count()
        assert [(r["col"], r["row"], r["namespace"]) for r in rows.where("namespace IS NOT NULL").collect()] == [("A", 2, "head-one")]


def test_refuses_to_encrypt_twice(spark, cipher):
    cells = cells_of(spark, {"s": [("A", 1, "Head"), ("B", 1, "Two"), ("A", 2, "note:" + "A" * 22)]})
    with pytest.raises(PySparkException, match="already contains an encrypted value"):
        cell_ops.encrypt_cells(cells, discover.discover_columns(cells), cipher, True).collect()


def test_lenient_decryption_flags_failures(spark, cipher):
    bad = "note:" + "A" * 22
    cells = cells_of(spark, {"s": [("A", 1, bad), ("B", 1, "plain")]})
    rows = {r["col"]: (r["value"], r["failed"]) for r in cell_ops.decrypt_cells(cells, cipher, strict=False).collect()}
    assert rows == {"A": (bad, True), "B": ("plain", False)}
    with pytest.raises(PySparkException, match="key is wrong"):
        cell_ops.decrypt_cells(cells, cipher).collect()
    entries = spark.createDataFrame([("f", 0, [bad, "x"])], "file_path string, ss_index bigint, runs array<string>")
    opened = dictionary.decrypt_dictionary(entries, cipher, strict=False).first()
    assert (opened["runs"], opened["failed"]) == ([bad, "x"], 1)
    values = spark.createDataFrame([(bad,), ("x",)], "v string")
    assert {(r["v"], r["failed"]) for r in pivot.decrypt_values(values, cipher, strict=False).collect()} == {(bad, True), ("x", False)}


def test_lookup_join_forms_agree_under_skew(spark):
    rng = random.Random(3)
    facts = spark.createDataFrame(
        [(0 if i % 3 == 0 else None if i % 7 == 0 else rng.randrange(40), i) for i in range(3000)], "k int, i int"
    )
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k int, v string")
    small, salted = (joins.lookup_join(facts, lookup, ["k"], small=s) for s in (True, False))
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    assert salted.columns == small.columns
    assert joins.fits_broadcast(lookup) and not joins.fits_broadcast(lookup, rows=29)
    assert not joins.fits_broadcast(lookup, size=100)


def test_column_forms(spark, cipher):
    df = spark.createDataFrame(
        [("Ann", "open"), ("Bob", "open"), (None, ""), ("Total", None), ("Ann", "shut")], "`Client Name` string, status string"
    )
    direct = columns.encrypt_columns(df, ["Client Name", "status"], cipher)
    reused = columns.encrypt_columns(df, ["Client Name", "status"], cipher, repeated=["Client Name", "status"])
    assert sorted(map(str, direct.collect())) == sorted(map(str, reused.collect()))
    back = columns.decrypt_columns(reused, ["Client Name", "status"], cipher)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert {r[0].split(":")[0] for r in direct.where("status <> ''").select("status").collect()} == {"status"}
    assert columns.repeated_columns(df, ["status"], share=0.7) == ["status"]
    named = columns.encrypt_columns(df, ["status"], cipher, {"status": "custom"})
    assert named.where("status LIKE 'custom:%'").count() == 3


def test_dictionary_rebuild_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "RANGE_ENTRIES", 7)
    rng = random.Random(5)
    entries = [(f, i, [f"{f}{i}"]) for f in "ab" for i in range(50)]
    refs = [(f, rng.randrange(50)) for f in "ab" for _ in range(40)]
    shared = dictionary.with_value(spark.createDataFrame(entries, "file_path string, ss_index bigint, runs array<string>"))
    cells = spark.createDataFrame(
        [(f, 0, "s", n, "A", n, "s", i, "", None) for n, (f, i) in enumerate(refs)], cell_ops.CELLS_SCHEMA
    )
    rebuilt = dictionary.rebuild_dictionary(cells, shared)
    got = {(r["file_path"], r["ss_index"]): (r["value"], r["old_index"], r["uses"]) for r in rebuilt.collect()}
    want = {}
    for f in "ab":
        used = sorted({i for g, i in refs if g == f})
        want.update({(f, n): (f"{f}{i}", i, refs.count((f, i))) for n, i in enumerate(used)})
    assert got == want
    assert cell_ops.decode_cells(dictionary.remap_cells(cells, rebuilt), rebuilt).count() == len(refs)
    dangling = cells.withColumn("ss_index", F.lit(99).cast("bigint"))
    assert dictionary.dangling_references(dangling, shared).count() == 2
    with pytest.raises(PySparkException, match="out of range"):
        dictionary.remap_cells(dangling, rebuilt).collect()


def test_overlays_against_every_pair(spark):
    rng = random.Random(11)
    box = lambda w, h: (lambda x, y: (x, y, x + rng.randrange(0, w), y + rng.randrange(1, h)))(rng.randrange(-90, 300) / 2, rng.randrange(-60, 300) / 2)
    spans = [("d", p, n, *map(float, box(200, 60)), rng.choice([0.0, None, 9.0, 90.0]), rng.choice([None, 255, 0x102030]), rng.choice([None, "Courier", "ZapfDingbats", "x"]), rng.choice([None, 5.0])) for p in range(3) for n in range(40)]
    spans += [(d, p, n + 100, *rest) for d, p, n, *rest in spans[:20]]
    hits = [("d", p, f"h{n}", 0, *map(float, box(90, 30))) for p in range(4) for n in range(25)]
    cols = "x0 double, y0 double, x1 double, y1 double"
    got = overlay.overlay_styles(
        spark.createDataFrame(hits, f"doc string, page int, hit_id string, rule_id int, {cols}"),
        spark.createDataFrame(spans, f"doc string, page int, span_id int, {cols}, size double, color int, font string, origin_y double"),
    ).collect()
    assert len(got) == len(hits)
    for row in got:
        def area(s):
            w, h = min(row["x1"], s[5]) - max(row["x0"], s[3]), min(row["y1"], s[6]) - max(row["y0"], s[4])
            return w * h if w > 0 and h > 0 else 0.0

        near = [s for s in spans if s[1] == row["page"] and area(s) > 0]
        best = max(near, key=lambda s: (area(s), -s[2]), default=None)
        assert row["span_id"] == (best[2] if best else None)
        height = row["y1"] - row["y0"]
        size = min(72.0, max(4.0, (best and best[7]) or min(72.0, max(4.0, height * 0.78))))
        assert row["font_size"] == size
        if best is None or best[10] is None:
            assert row["baseline"] == row["y1"] - max(0.0, (height - size) / 2)
        else:
            assert row["baseline"] == best[10]
        shade = (best[8] if best else None) or 0
        assert (row["red"], row["green"], row["blue"]) == tuple((shade >> s & 255) / 255 for s in (16, 8, 0))
        assert row["font"] == {"Courier": "cour", "ZapfDingbats": "zadb"}.get(best and best[9], "helv")


def test_page_hits_ignore_case_and_do_not_cascade(spark):
    from veilcraft.plans.documents import plan_overlays

    spans = spark.createDataFrame(
        [("d", 0, 1, 72.0, 60.0, 472.0, 75.0, 18.0, 255, "Helvetica", 72.0, "John Smith owns john smith.x"), ("e", 0, 1, 0.0, 0.0, 9.0, 9.0, 9.0, 0, "", None, "none")],
        "doc string, page int, span_id int, x0 double, y0 double, x1 double, y1 double, size double, color int, font string, origin_y double, text string",
    )
    overlays, totals = plan_overlays(spans, [("John Smith", "owns"), ("OWNS", "x"), (".", "!"), ("", "y")])
    rows = sorted((r["rule_id"], r["hit_no"], r["start"], r["replace"], r["font_size"], r["blue"]) for r in overlays.collect())
    assert rows == [(0, 0, 0, "owns", 18.0, 1.0), (0, 1, 16, "owns", 18.0, 1.0), (1, 0, 11, "x", 18.0, 1.0), (2, 0, 26, "!", 18.0, 1.0)]
    assert {r["doc"]: (r["replacements"], r["error"]) for r in totals.collect()} == {
        "d": (4, None), "e": (0, "No replacement values were found in the PDF"),
    }


def test_very_large_boxes_find_their_spans(spark):
    schema = "doc string, page int, span_id int, x0 double, y0 double, x1 double, y1 double, size double, color int, font string, origin_y double"
    spans = spark.createDataFrame(
        [("d", 0, 1, 0.0, 0.0, 1e12, 10.0, 5.0, 0, "a", None), ("d", 0, 2, 5.0, 100.0, 400.0, 300.0, 6.0, 0, "b", None), ("d", 1, 3, 0.0, 0.0, 9.0, 9.0, 7.0, 0, "c", None)],
        schema,
    )
    hits = spark.createDataFrame(
        [("d", 0, 1.0, 1.0, 5.0, 5.0), ("d", 0, -1e12, 90.0, 1e12, 400.0), ("d", 0, 60.0, 120.0, 330.0, 290.0), ("d", 1, 100.0, 0.0, 120.0, 9.0)],
        "doc string, page int, x0 double, y0 double, x1 double, y1 double",
    )
    found = {(r["page"], r["x0"]): r["span"]["span_id"] for r in overlay.best_spans(hits, spans).collect()}
    assert found == {(0, 1.0): 1, (0, -1e12): 2, (0, 60.0): 2}


def test_hits_run_over_spans_of_a_line(spark):
    from veilcraft.plans.documents import plan_overlays

    texts = [("d", 0, 7, 0.0, 20.0, "Jo"), ("d", 0, 3, 20.0, 30.0, "h"), ("d", 0, 5, 30.0, 30.0, ""), ("d", 0, 4, 30.0, 90.0, "n Smit"), ("d", 0, 9, 90.0, 130.0, "h ow")]
    rows = [(d, p, i, a, 0.0, b, 10.0, 8.0 + i, 0, "Arial", 9.0, text) for d, p, i, a, b, text in reversed(texts)]
    rows += [("d", 0, 8, 0.0, 20.0, 50.0, 30.0, 9.0, 0, "Arial", 29.0, "n Smith"), ("d", 1, 1, 0.0, 0.0, 10.0, 10.0, 9.0, 0, "Arial", None, "John"),
             ("d", 1, 2, 10.0, 0.0, 20.0, 10.0, 9.0, 0, "Arial", None, " Smith"), ("e", 0, 1, 0.0, 0.0, 1.0, 1.0, 1.0, 0, "", 9.0, None)]
    spans = spark.createDataFrame(rows, "doc string, page int, span_id int, x0 double, y0 double, x1 double, y1 double, size double, color int, font string, origin_y double, text string")
    overlays, totals = plan_overlays(spans, [("john smith", "CLIENT_001"), ("ohn", "x")])
    got = sorted((r["rule_id"], r["part"], r["found_in"], r["start"], r["replace"], r["x0"], r["x1"], r["font_size"]) for r in overlays.collect() if r["page"] == 0)
    assert got == [
        (0, 0, 7, 0, "CLIENT_001", 0.0, 20.0, 15.0), (0, 1, 3, 0, "", 20.0, 30.0, 11.0), (0, 2, 4, 0, "", 30.0, 90.0, 12.0), (0, 3, 9, 0, "", 90.0, 100.0, 17.0),
        (1, 0, 7, 1, "x", 10.0, 20.0, 15.0), (1, 1, 3, 0, "", 20.0, 30.0, 11.0), (1, 2, 4, 0, "", 30.0, 40.0, 12.0),
    ]
    # the first line has one hit of either rule, and "John" on the second page holds one; a line is the bound
    assert {r["doc"]: r["replacements"] for r in totals.collect()} == {"d": 3, "e": 0}


def test_a_page_of_large_boxes_stays_linear(spark):
    size = "doc string, page int, {}x0 double, y0 double, x1 double, y1 double"
    at = lambda n: (n % 40) * 5000.0
    wide = [("d", 0, n, at(n), (n // 40) * 5000.0, at(n) + 4000, (n // 40) * 5000.0 + 4000) for n in range(1600)]
    spans = spark.createDataFrame(wide, size.format("span_id int, ")).selectExpr("*", "1D size", "0 color", "'' font", "0D origin_y")
    hits = spark.createDataFrame([(d, p, x0 + 10, y0 + 10, x1 - 10, y1 - 10) for d, p, _, x0, y0, x1, y1 in wide], size.format(""))
    best = overlay.best_spans(hits, spans)
    assert [r["n"] for r in best.selectExpr("count(*) n", "count(distinct span.span_id)").collect()] == [1600]
    assert {(r["x0"] - 10, r["y0"] - 10): r["span"]["span_id"] for r in best.collect()} == {(x0, y0): n for _, _, n, x0, y0, _, _ in wide}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((" in plan and "_gx" in plan and plan.count("Join ") == 1  # one level, one join by square


def test_gathering_keeps_order_and_every_document(spark):
    runs = spark.createDataFrame(
        [("a", "p", 0, 2, "c"), ("a", "p", 0, 0, "a"), ("a", "p", 0, 1, None), ("big", "p", 0, 0, "x" * 500_000)],
        "doc string, part string, para_index int, run_index int, text string",
    )
    kept = paragraphs.gather_paragraphs(runs).collect()
    assert {r["doc"]: r["runs"] for r in kept} == {"a": ["a", None, "c"], "big": ["x" * 500_000]}


def test_jobs(spark):
    made = spark.createDataFrame(
        [("old", "2024-01-01 00:00:00"), ("edge", "2024-01-01 00:15:00"), ("new", "2024-01-01 00:15:01")], "token string, t string"
    ).select("token", F.to_timestamp("t").alias("created_at"))
    assert [r["token"] for r in jobs.expired_jobs(made, "2024-01-01 00:30:00").collect()] == ["old"]
    used = made.select(F.lit("t").alias("token"), F.col("created_at").alias("redeemed_at"), F.col("token").alias("redemption_id"))
    assert [(r["redemption_id"], r["refused"]) for r in jobs.first_redemptions(used).collect()] == [("old", 2)]


def test_output_names(spark):
    cases = [
        ("Client list.xlsx", "encrypt", "Client list.encrypted.xlsx"),
        ("C:\\dir\\a/b.docx", "replace", "b.replaced.docx"),
        ("sample.pdf", "replace", "sample.replaced.pdf"),
        ("x.Encrypted.ENCRYPTED.xlsx", "decrypt", "x_restored.xlsx"),
        (None, "replace", "workbook.replaced.xlsx"),
        ("", "decrypt", "workbook_restored.xlsx"),
        (".encrypted.xlsx", "decrypt", "encrypted_restored.xlsx"),
        ("..", "replace", "document.replaced.xlsx"),
        ("a/", "encrypt", "workbook.encrypted.xlsx"),
        ("é#.csv", "replace", "_.replaced.xlsx"),
        ("x" * 130 + ".PDF", "replace", "x" * 120 + ".replaced.pdf"),
    ]
    df = spark.createDataFrame([(i, n, m) for i, (n, m, _) in enumerate(cases)], "i int, n string, m string")
    got = {r["i"]: r["o"] for r in df.select("i", names.output_name(F.col("n"), F.col("m")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]
    ok = {r["i"]: r["o"] for r in df.select("i", names.is_supported(F.col("n"), F.col("m")).alias("o")).collect()}
    assert [i for i in ok if ok[i]] == [0, 1, 2, 3, 6, 10]
    assert PurePosixPath("..").suffix == ""


def test_error_messages_take_the_first_match(spark):
    cases = [
        ("Password-protected DOCX packages are not supported", "encrypt", "The selected file is not a supported or readable .docx document."),
        ("Document contains too many package members", "replace", "The selected document could not be processed safely. No output was created."),
        ("Find and replace rules could not be read", "replace", names.DEFAULT_MESSAGE),
        ("PDF replacement requires the local PyMuPDF package", "replace", names.PDF_LIBRARY_MISSING),
        ("No values were found to decrypt", "decrypt", names.NOTHING_TO_DECRYPT),
        ("No values were found to encrypt", None, "No values were found in the selected fields to encrypt."),
        ("Workbook contains too many package members", "encrypt", "This workbook is too large or complex to process safely."),
        ("whatever", None, names.DEFAULT_MESSAGE),
    ]
    df = spark.createDataFrame(cases, "t string, m string, want string")
    for row in df.withColumn("got", names.public_message(F.col("t"), F.col("m"))).collect():
        assert row["got"] == row["want"]


def test_audit_order(spark):
    cells = spark.createDataFrame(
        [("f", 0, "s", 5, "B", 1, "ns-b", "B head"), ("f", 0, "s", 3, "C", 2, "ns-c", "C head"), ("f", 0, "s", 3, "A", 3, "ns-a", "A head"), ("f", 0, "s", 9, "A", 4, "ns-a", "A head"), ("f", 0, "s", 1, "D", 0, None, None)],
        "file_path string, sheet_index int, sheet_name string, row int, col string, ordinal int, namespace string, header string",
    )
    listed = audit.encrypted_columns(cells)
    assert audit.headers_by_sheet(listed).first()["headers"] == ["B head", "C head", "A head"]
    assert audit.total_values(audit.namespace_counts(cells)).first()["total"] == 4


def test_known_and_unknown_namespaces_open_alike(spark, cipher):
    known = TokenCipher(spark, CipherKey(bytes(range(64))), ["a"])
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "n string, t string").select(cipher.encrypt_by("n", "t").alias("c"))
    assert sorted(r[0] for r in df.select(known.decrypt("c")).collect()) == ["x", "y"]
    assert sorted(token_namespaces(df, "c")) == ["a", "b"] and token_namespaces(df, "c", limit=1) == []


def test_states_are_joined_for_any_number_of_namespaces(spark, cipher):
    named = spark.range(300).selectExpr("concat('space-', id % 150) AS n", "concat('text ', id) AS t", "CAST(id AS INT) AS id")
    token = cipher.encrypt_by("n", "t")
    cells = named.select(
        F.lit("f").alias("file_path"), F.lit(0).alias("sheet_index"), F.lit("s").alias("sheet_name"), F.col("id").cast("bigint").alias("row"), F.lit("A").alias("col"),
        F.col("id").cast("bigint").alias("ordinal"), F.lit("str").alias("cell_type"), F.lit(None).cast("bigint").alias("ss_index"),
        F.when(F.col("id") % 3 == 0, F.col("t")).otherwise(token).alias("value"), F.lit(None).cast("string").alias("formula"),
    )
    runs = F.array(F.lit("plain "), token, cipher.encrypt_by("'other'", "t"))
    strings = named.select(F.lit("f").alias("file_path"), F.col("id").cast("bigint").alias("ss_index"), runs.alias("runs"), F.array_join(runs, "").alias("value"))
    values = named.select(F.lit("f").alias("file_path"), F.lit("p").alias("part"), F.col("id").alias("item"), F.lit("s").alias("tag"), token.alias("v"))
    book = Workbooks(cells, strings, pivot_items=values)
    for strict in (True, False):
        done = unscrub(book, cipher, strict)
        assert {(r.row, r.value) for r in done.book.cells.collect()} == {(i, f"text {i}") for i in range(300)}
        assert {(r.ss_index, r.value) for r in done.book.shared_strings.collect()} == {(i, f"plain text {i}text {i}") for i in range(300)}
        assert {(r["item"], r.v) for r in done.book.pivot_items.collect()} == {(i, f"text {i}") for i in range(300)}
        assert not {"_namespace", "_state"} & {c for df in (done.book.cells, done.book.shared_strings, done.book.pivot_items) for c in df.columns}
    told = TokenCipher(spark, CipherKey(bytes(range(64))), ["space-1"])
    assert unscrub(book, told).counts.orderBy("namespace").collect() == unscrub(book, cipher).counts.orderBy("namespace").collect()
    broken = cells.withColumn("value", F.when(F.col("row") == 1, F.regexp_replace("value", ":.", ":_")).otherwise(F.col("value")))
    failed = unscrub(Workbooks(broken), cipher, strict=False).book.cells
    assert [r.row for r in failed.where("failed").collect()] == [1]
    # the states are made of the stored names, not per token
    plan = unscrub(Workbooks(cells), cipher).book.cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan


def test_discovery_reads_the_cells_once_and_late_sheets_again(spark, tmp_path):
    rows = [("f", 0, "a", r, c, n, v) for n, (r, c, v) in enumerate([(1, "A", "Client Name"), (1, "B", "Account ID"), (2, "A", "x"), (1, "A", "Last Name"), (12, "C", "late")])]
    rows += [("f", 1, "b", r, c, n, v) for n, (r, c, v) in enumerate([(30, "A", "Deep Title"), (30, "B", "old"), (30, "B", "Other Title"), (31, "C", "below"), (5, "D", "")])]
    cells = spark.createDataFrame(rows, "file_path string, sheet_index int, sheet_name string, row bigint, col string, ordinal bigint, value string")
    found = {(r.sheet_name, r.col): (r.header, r.start_row) for r in discover_columns(cells).collect()}
    assert found == {
        ("a", "A"): ("Last Name", 2), ("a", "B"): ("Account ID", 2), ("a", "C"): ("Column C", 2),
        ("b", "A"): ("Deep Title", 31), ("b", "B"): ("Other Title", 31), ("b", "C"): ("Column C", 31),
    }
    outline = _outline(cells)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in outline and "SortAggregate" not in outline


def test_spans_of_a_line_are_shuffled_in_pieces(spark):
    rng = random.Random(5)
    rows = []
    for doc in (None, "a", "b"):
        for page in (None, 0, 1):
            for y in (1.0, 0.1 + 0.2):
                x = -3.0
                for i in range(40):
                    text = rng.choice(["jo", "hn", "", None, "x", "john", "\x00", "\x00jo"])
                    x0, x = x, x + rng.random()
                    rows.append((doc, page, rng.choice([i, i, None]), x0, y - 1, rng.choice([x, x, None]), y, y, text))
    rng.shuffle(rows)
    kinds = "doc string, page int, span_id long, x0 double, y0 double, x1 double, y1 double, origin_y double, text string"
    spans = spark.createDataFrame(rows, kinds).repartition(3)
    pieces = overlay._pieces(spans).count()
    assert 18 <= pieces <= 18 * 3  # a row for each line and batch, not for each of 720 spans
    _, lined = overlay.text_lines(spans)
    plain = spans.groupBy("doc", "page", "origin_y").agg(F.array_sort(F.collect_list(F.struct("x0", "span_id", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text")))).alias("spans"))
    expected = [(r["doc"], r["page"], r["spans"][0]["span_id"], "".join(s["text"] for s in r["spans"]), [tuple(s) for s in r["spans"]]) for r in plain.collect()]
    got = [(r["doc"], r["page"], r["line"], r["text"], [tuple(s) for s in r["spans"]]) for r in lined.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    hits = overlay.find_hits(spans, [("john", "J")]).collect()
    assert sum(r["part"] == 0 for r in hits) == sum(len(e[3].split("john")) - 1 for e in expected)
    whole = spans.select("doc", "page", "span_id", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "origin_y", "text")
    assert overlay.text_lines(whole)[1].select(F.sum(F.size("spans"))).first()[0] == 720


def test_boxes_of_a_line_of_text_stand_in_few_squares(spark):
    rng = random.Random(3)
    corners = [(rng.uniform(0, 600), rng.uniform(0, 800)) for _ in range(2000)]
    boxes = spark.createDataFrame([(x, y, x + 50, y + 30) for x, y in corners], "x0 double, y0 double, x1 double, y1 double")
    squares = boxes.withColumn("_level", overlay._level("x0", "y0", "x1", "y1")).withColumn("_gx", overlay._squares("x0", "x1")).withColumn("_gy", overlay._squares("y0", "y1"))
    assert squares.count() < 1.5 * 2000  # every row of these is shuffled


def test_lines_are_cut_into_spans_in_one_pass(spark, tmp_path):
    from veilcraft.plans.catalog import HIT_RULES, QUERIES

    rng = random.Random(8)
    text = "".join(rng.choice(["the ", "THE", "nation", "en ", "ä", "😀", "x"]) for _ in range(20_000))
    spark.createDataFrame([(7, text), (8, None), (9, "\n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    hits = QUERIES["pdf_hits_across_spans"](spark, str(tmp_path))
    # a substring is counted from the start of its text, so that long lines took a time of the square of their length
    assert "substring(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    expected = []
    for rule_id, (find, put) in enumerate(HIT_RULES):
        for hit_no, found in enumerate(re.finditer(find, text, re.IGNORECASE)):
            at, end = found.span()
            for part, i in enumerate(range(at // 3, (end - 1) // 3 + 1)):
                box = (max(at, 3 * i) * 6.0, min(end, 3 * i + 3) * 6.0)
                expected.append((7, -i, rule_id, hit_no, part, max(at - 3 * i, 0), "" if part else put, *box))
    assert sorted(map(tuple, hits.collect())) == sorted(expected)


def test_pieces_of_even_spans_are_small(spark):
    even = spark.range(0, 4000, 1, 1).select(
        F.lit("d").alias("doc"), F.lit(0).alias("page"), (-F.col("id")).alias("span_id"), (F.col("id") * 18.0).alias("x0"), F.lit(1.0).alias("y0"),
        (F.col("id") * 18.0 + 17.25).alias("x1"), F.lit(9.0).alias("y1"), F.lit(7.0).alias("origin_y"), F.lit("abc").alias("text"),
    )
    assert overlay._pieces(even).toArrow().nbytes < 8 * 4000  # 3 bytes of text for each span, and few numbers
    lines = overlay.text_lines(even)[1].collect()
    assert [(r["line"], len(r["text"]), [(s["x0"], s["x1"]) for s in r["spans"]] == [(i * 18.0, i * 18.0 + 17.25) for i in range(4000)]) for r in lines] == [(0, 12_000, True)]


def test_hits_over_spans_are_those_of_the_whole_line(spark):
    """Letters that match others when case is ignored, and lines whose pieces come in many batches."""
    rng = random.Random(4)
    letters = ["a", "A", "s", "S", "ſ", "k", "K", "K", "i", "I", "İ", "ı", "ß", "ẞ", "σ", "ς", "Σ", "\U00010400", "\U00010428", "😀", ".", "$", "\0", "µ", "μ", "å", "Å"]
    rules = [(find, str(i)) for i, find in enumerate(["aa", "s", "st", "k", "ik", "ß", "ßa", "σa", "\U00010428", "a\U00010428", "", ".", "$a", "\0", "å", "µa", "ia", "ss", "aaa", "never"])]
    whole, cut = [], []
    for n in range(60):
        text = "".join(rng.choices(letters, k=rng.choice([1, 40, 200])) + ["a"] * rng.choice([0, 5]))
        whole.append(("d", n, 0, 0.0, 1.0, 6.0 * len(text), 9.0, None, text))
        at = 0
        while at < len(text):
            size = rng.choice([0, 1, 2, 7])
            cut.append(("d", n, at * 10 + size, at * 6.0, 1.0, (at + len(text[at : at + size])) * 6.0, 9.0, 7.0, text[at : at + size]))
            at += size
    rng.shuffle(cut)
    kinds = "doc string, page int, span_id long, x0 double, y0 double, x1 double, y1 double, origin_y double, text string"
    hits = lambda rows: overlay.find_hits(spark.createDataFrame(rows, kinds).repartition(3), rules)
    expected = sorted((r["page"], r["rule_id"], r["hit_no"], r["x0"], r["x1"], r["replace"]) for r in hits(whole).collect())
    for records in ("10000", "2"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            rows = hits(cut).orderBy("page", "rule_id", "hit_no", "part").collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        joined = {}
        for r in rows:
            first = joined.setdefault((r["page"], r["rule_id"], r["hit_no"]), [r["x0"], r["x1"], ""])
            assert r["part"] == 0 or abs(first[1] - r["x0"]) < 1e-6
            first[1], first[2] = r["x1"], first[2] + r["replace"]
        got = sorted((*key, *value) for key, value in joined.items())
        assert [(*g[:3], g[5]) for g in got] == [(*e[:3], e[5]) for e in expected]
        assert all(abs(g[3] - e[3]) + abs(g[4] - e[4]) < 1e-6 for g, e in zip(got, expected))
