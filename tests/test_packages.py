import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import builders as b
from veilcraft.operators.gates import REQUIRED_PARTS, GateError, package_gate, upload_gate
from veilcraft.operators.paragraphs import document_totals, replace_paragraphs
from veilcraft.plans import documents as document_plan, workbook as plan
from veilcraft.operators import cells as cell_ops
from veilcraft.sources import packages
from veilcraft.sources.tables import write_table

RULES = [("John Smith", "CLIENT_001"), ("ABC Retirement Portfolio", "PORTFOLIO_001")]


def read(spark, folder, kind="xlsx"):
    return packages.read_packages(spark, str(folder), kind)


def values(cells):
    return {f"{r['col']}{r['row']}": r["value"] for r in cells.collect()}


def test_full_run_on_the_clients_sheet(spark, cipher, tmp_path):
    b.write_zip(tmp_path / "clients.xlsx", b.workbook({"Ad Hoc Clients": b.clients_sheet()}))
    book = plan.load_workbooks(read(spark, tmp_path))
    seen = plan.peek(book).first()
    assert [c["header"] for c in seen["columns"]] == [
        "Client Name", "Account ID", "Portfolio Label", "Notes", "Formula Cache",
    ]
    assert [c["ns_label"] for c in seen["columns"]][0] == "Ad Hoc Clients: Client Name"

    done = plan.scrub(book, cipher, cell_ops.requested_keys(spark, ["0|A", "0|C"]), RULES)
    done.require_changes("encrypt")
    assert done.replacements.first()["replacements"] == 5
    assert {(r["namespace"], r["n"]) for r in done.counts.collect()} == {("client-name", 1), ("portfolio-label", 1)}
    assert [(r["sheet_name"], r["header"]) for r in done.columns.orderBy("first_ordinal").collect()] == [
        ("Ad Hoc Clients", "Client Name"), ("Ad Hoc Clients", "Portfolio Label"),
    ]
    sealed = values(done.book.cells)
    assert sealed["A3"].startswith("client-name:") and sealed["C3"].startswith("portfolio-label:")
    assert sealed["B3"] == "ACC-100" and sealed["D3"] == "CLIENT_001 review note"
    assert sealed["E3"] == "CLIENT_001 - PORTFOLIO_001"
    kinds = {f"{r['col']}{r['row']}": r["cell_type"] for r in done.book.cells.collect()}
    assert kinds["A3"] == "inlineStr" and kinds["E3"] == "str"

    back = plan.unscrub(done.book, cipher)
    back.require_changes("decrypt")
    opened = values(back.book.cells)
    assert (opened["A3"], opened["B3"], opened["C3"]) == ("CLIENT_001", "ACC-100", "PORTFOLIO_001")
    assert opened["D3"] == "CLIENT_001 review note"
    assert values(book.cells)["A3"] == "John Smith"


def test_header_of_a_pivot_like_sheet(spark, tmp_path):
    xml = b.sheet(
        b.inline("A1", "Portfolio Name"), b.inline("B1", "Account Name"), b.inline("C1", "Total"),
        b.inline("A2", "A"), b.inline("B2", "A"), b.inline("C2", "(2.180)"), b.inline("D2", "Internal"),
        b.inline("A3", "B"), b.inline("B3", "B"), b.inline("C3", "(652)"),
    )
    b.write_zip(tmp_path / "p.xlsx", b.workbook({"Pivot Summary": xml}))
    seen = plan.peek(plan.load_workbooks(read(spark, tmp_path))).first()["columns"]
    assert [c["header"] for c in seen] == ["Portfolio Name", "Account Name", "Total", "Column D"]
    assert [c["namespace"] for c in seen][:3] == ["portfolio-name", "account-name", "total"]


def shared_book():
    xml = b.sheet(
        '<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>',
        '<c r="A2" t="s"><v>3</v></c>', '<c r="B2" t="s"><v>4</v></c>',
        '<c r="A3" t="s"><v>3</v></c>', '<c r="B3" t="s"><v>1</v></c>',
        '<c r="A4"><v>00123</v></c>', '<c r="B4" t="s"/>',
    )
    shared = [["First ", "Header"], ["Second Header"], ["never used"], ["Jane", " Doe"], ["kept text"]]
    definition = (
        f'<pivotCacheDefinition xmlns="{b.MAIN}"><cacheFields>'
        '<cacheField name="FIRST header"><sharedItems containsNumber="1" minValue="1">'
        '<s v="Jane Doe"/><n v="7"/><s v="(blank)"/><m/></sharedItems></cacheField>'
        '<cacheField name="Other"><sharedItems><s v="Jane Doe"/></sharedItems></cacheField>'
        '</cacheFields></pivotCacheDefinition>'
    )
    records = (
        f'<pivotCacheRecords xmlns="{b.MAIN}"><r><x v="0"/><s v="o"/></r><r><s v="Jane Doe"/><n v="2"/></r></pivotCacheRecords>'
    )
    extra = {
        "xl/pivotCache/pivotCacheDefinition1.xml": definition,
        "xl/pivotCache/pivotCacheRecords1.xml": records,
        "xl/pivotCache/_rels/pivotCacheDefinition1.xml.rels": b.rels(
            ("r0", "other", "nothing.xml"), ("r1", "pivotCacheRecords", "pivotCacheRecords1.xml")
        ),
    }
    return b.workbook({"Data": xml}, shared, extra)


def test_dictionaries_and_pivots(spark, cipher, tmp_path):
    b.write_zip(tmp_path / "s.xlsx", shared_book())
    book = plan.load_workbooks(read(spark, tmp_path))
    plain = values(plan.decoded(book))
    assert plain == {
        "A1": "First Header", "B1": "Second Header", "A2": "Jane Doe", "B2": "kept text",
        "A3": "Jane Doe", "B3": "Second Header", "A4": "00123", "B4": "",
    }
    done = plan.scrub(book, cipher, ["00|A", "bad"], [("Doe", "Roe")])
    # once per dictionary run, shared item and record
    assert done.replacements.first()["replacements"] == 4
    assert {(r["namespace"], r["n"]) for r in done.counts.collect()} == {
        ("first-header", 3), ("pivot-first-header", 2), ("pivot-record-first-header", 1),
    }
    rebuilt = sorted((r["ss_index"], r["value"]) for r in done.book.shared_strings.collect())
    assert rebuilt == [(0, "First Header"), (1, "Second Header"), (2, "kept text")]
    again = values(plan.decoded(done.book))
    assert again["B2"] == "kept text" and again["B3"] == "Second Header" and again["A2"] == again["A3"]
    assert again["A2"].startswith("first-header:")
    fields = {r["name"]: r for r in done.book.pivot_fields.collect()}
    assert fields["FIRST header"]["contains_string"] == "1" and fields["FIRST header"]["contains_number"] is None
    items = {(r["field_index"], r["item_index"]): (r["tag"], r["v"]) for r in done.book.pivot_items.collect()}
    assert items[0, 0][0] == "s" and items[0, 1][0] == "s" and items[0, 1][1].startswith("first-header:")
    assert items[0, 2] == ("s", "(blank)") and items[0, 3] == ("m", None) and items[1, 0] == ("s", "Jane Roe")
    records = {(r["row"], r["field_index"]): (r["tag"], r["v"]) for r in done.book.pivot_records.collect()}
    assert records[0, 0] == ("x", "0") and records[1, 0][1].startswith("first-header:") and records[1, 1] == ("n", "2")

    back = plan.unscrub(done.book, cipher)
    opened = values(plan.decoded(back.book))
    assert opened["A2"] == "Jane Roe" and opened["A4"] == "00123"
    kinds = {f"{r['col']}{r['row']}": r["cell_type"] for r in back.book.cells.collect()}
    assert kinds["A4"] == "n" and kinds["A2"] == "inlineStr"
    assert {(r["namespace"], r["n"]) for r in back.counts.collect()} == {("first-header", 3), ("pivot-first-header", 3)}
    items = {(r["field_index"], r["item_index"]): (r["tag"], r["v"]) for r in back.book.pivot_items.collect()}
    assert items[0, 1] == ("s", "7") and items[0, 0] == ("s", "Jane Roe")


def test_dangling_index_is_an_error(spark, tmp_path):
    xml = b.sheet('<c r="A1" t="s"><v>5</v></c>', '<c r="B1" t="s"><v>-1</v></c>', '<c r="C1" t="s"><v>x</v></c>')
    b.write_zip(tmp_path / "s.xlsx", b.workbook({"Data": xml}, [["only"]]))
    book = plan.load_workbooks(read(spark, tmp_path))
    with pytest.raises(PySparkException, match="Invalid shared-string index in cell"):
        plan.decoded(book).collect()
    rows = cell_ops.decode_cells(book.cells, book.shared_strings, strict=False).collect()
    assert sorted(r["error"] for r in rows) == [f"Invalid shared-string index in cell {c}1" for c in "ABC"]


def test_broken_files_become_error_rows(spark, tmp_path):
    (tmp_path / "junk.xlsx").write_bytes(b"not a zip")
    b.write_zip(tmp_path / "good.xlsx", b.workbook({"Data": b.clients_sheet()}))
    b.write_zip(tmp_path / "stored.xlsx", b.workbook({"Data": b.clients_sheet()}), compress=0)
    raw = (tmp_path / "stored.xlsx").read_bytes().replace(b"ACC-100", b"ACC-999")
    (tmp_path / "stored.xlsx").write_bytes(raw)
    parts = read(spark, tmp_path)
    errors = {r["file_path"].rsplit("/", 1)[1]: r["error"] for r in parts.where("error IS NOT NULL").collect()}
    assert errors == {
        "junk.xlsx": "Input is not a readable XLSX workbook", "stored.xlsx": "Workbook contains a corrupt package member",
    }
    missing = b.workbook({"A": b.clients_sheet(), "B": b.clients_sheet(), "C": "<broken"})
    del missing["xl/worksheets/sheet2.xml"]
    missing["xl/_rels/workbook.xml.rels"] = b.rels(("rId2", "worksheet", "worksheets/sheet2.xml"), ("rId3", "worksheet", "/xl/worksheets/sheet3.xml"))
    (tmp_path / "m").mkdir()
    b.write_zip(tmp_path / "m" / "m.xlsx", missing)
    parts = read(spark, tmp_path / "m")
    sheets = {r["sheet_name"]: r["error"] for r in packages.workbook_sheets(parts).collect()}
    assert sheets == {
        "A": "Missing relationship for worksheet 'A'", "B": "Missing or invalid worksheet part for 'B'", "C": None,
    }
    assert [r["error"][:26] for r in packages.cells(parts).collect()] == ["xl/worksheets/sheet3.xml: "]


def test_members_are_read_like_packages(spark, tmp_path):
    draw = random.Random(3)
    noise = "".join(draw.choices("abcdefgh", k=400_000))
    many = b.workbook({f"S{i}": b.sheet(b.inline("A1", "Name"), b.inline("A2", f"{i}{noise}")) for i in range(40)}, extra={"xl/styles.xml": noise})
    b.write_zip(tmp_path / "a many.xlsx", many)
    (tmp_path / "junk.xlsx").write_bytes(b"not a zip")
    (tmp_path / "tiny.xlsx").write_bytes(b"P")
    b.write_zip(tmp_path / "short.xlsx", {"[Content_Types].xml": "<Types/>"})
    good = b.workbook({"Data": b.clients_sheet()}, extra={"xl/media/unused.txt": "UNUSED-1"})
    for name, mark in (("stored", b"ACC-100"), ("unused", b"UNUSED-1")):
        b.write_zip(tmp_path / f"{name}.xlsx", good, compress=0)
        raw = (tmp_path / f"{name}.xlsx").read_bytes()
        (tmp_path / f"{name}.xlsx").write_bytes(raw.replace(mark, mark[:-1] + b"9"))
    with zipfile.ZipFile(tmp_path / "twice.xlsx", "w") as archive, pytest.warns(UserWarning):
        for part, text in [*good.items(), ("xl/worksheets/sheet1.xml", b.sheet(b.inline("A1", "the last counts")))]:
            archive.writestr(part, text)
    b.write_zip(tmp_path / "locked.xlsx", good)
    locked = bytearray((tmp_path / "locked.xlsx").read_bytes())
    locked[locked.find(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.xlsx").write_bytes(bytes(locked))

    def rows(parts):
        return sorted((tuple(r) for r in parts.select(*packages_columns).collect()), key=repr)

    packages_columns = [field.split()[0] for field in packages.PARTS_SCHEMA.split(", ")]
    whole, members = rows(read(spark, tmp_path)), packages.read_members(spark, str(tmp_path))
    assert rows(members) == whole
    assert {r[0].rsplit("/", 1)[1] for r in whole if r[-1]} == {"junk.xlsx", "tiny.xlsx", "short.xlsx", "stored.xlsx", "unused.xlsx", "locked.xlsx"}
    tasks = members.where(F.col("file_path").endswith("many.xlsx")).select(F.spark_partition_id()).distinct().count()
    assert tasks > 1
    with pytest.raises(GateError):
        plan.load_workbooks(members).cells.count()
    assert plan.load_workbooks(members, strict=False).cells.where(F.col("file_path").endswith("many.xlsx")).count() == 80


def test_package_gates(spark, tmp_path):
    files = {"good.xlsx": [*REQUIRED_PARTS["xlsx"]], "none.xlsx": ["a.txt"], "many.xlsx": [f"{i}" for i in range(9)]}
    members = [(name, part, 8, 5000 if part == "a.txt" else 1) for name, parts in files.items() for part in parts]
    parts = spark.createDataFrame(members, "file_path string, part string, flag_bits int, file_size long")

    def verdicts(**limits):
        return {r["file_path"][:4]: r["error"] for r in package_gate(parts, **limits).collect()}

    invalid = "Input is not a valid XLSX workbook package"
    assert verdicts() == {"good": None, "none": invalid, "many": invalid}
    assert verdicts(max_members=8)["many"] == "Workbook contains too many package members"
    assert verdicts(max_bytes=4999)["none"] == "Workbook expands beyond the safe processing limit"
    assert verdicts(max_bytes=5000)["none"] == invalid
    locked = package_gate(parts.withColumn("flag_bits", F.lit(9)), "docx").collect()
    assert {r["error"] for r in locked} == {"Password-protected DOCX packages are not supported"}
    b.write_zip(tmp_path / "good.xlsx", b.workbook({"Data": b.clients_sheet()}))
    small = packages.read_packages(spark, str(tmp_path), max_file_bytes=10)
    assert {r["error"] for r in small.collect()} == {"File exceeds the 25 MiB upload limit"}
    listed = upload_gate(packages.list_files(spark, str(tmp_path)).select("path", "length"))
    assert listed.where("error IS NOT NULL").count() == 0


def test_files_are_judged_before_content_is_read(spark, tmp_path, monkeypatch):
    good = b.workbook({"Data": b.clients_sheet()})
    for name in ("locked", "large", "GOOD"):
        b.write_zip(tmp_path / f"{name}.xlsx", good)
    (tmp_path / "GOOD.xlsx").rename(tmp_path / "GOOD.XLSX")
    (tmp_path / "other.bin").write_bytes(b"x")
    locked = bytearray((tmp_path / "locked.xlsx").read_bytes())
    locked[locked.find(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.xlsx").write_bytes(bytes(locked))
    large = bytearray((tmp_path / "large.xlsx").read_bytes())
    at = large.rfind(b"PK\x01\x02")
    large[at + 24 : at + 28] = (300 << 20).to_bytes(4, "little")  # claims to expand beyond the limit
    (tmp_path / "large.xlsx").write_bytes(bytes(large))
    read_all = packages.read_packages(spark, str(tmp_path))
    rows = {r["file_path"].rsplit("/", 1)[1]: r["error"] for r in read_all.where("part IS NULL").collect()}
    assert rows == {
        "locked.xlsx": "Password-protected XLSX packages are not supported", "large.xlsx": "Workbook expands beyond the safe processing limit",
    }
    kept = {r["part"] for r in read_all.where("content IS NOT NULL").collect()}
    assert "xl/workbook.xml" in kept and "[Content_Types].xml" not in kept
    assert plan.load_workbooks(read_all, strict=False).cells.count() > 0


def test_document_faults(spark, tmp_path):
    b.write_zip(tmp_path / "sound.docx", b.document(["John ", "Smith"]))
    b.write_zip(tmp_path / "empty.docx", b.document())
    broken = b.document(["John Smith"])
    broken["word/header1.xml"] = "<broken"
    b.write_zip(tmp_path / "broken.docx", broken)
    b.write_zip(tmp_path / "bodyless.docx", {"[Content_Types].xml": "<Types/>"})
    (tmp_path / "junk.docx").write_bytes(b"junk")
    parts = read(spark, tmp_path, "docx")
    with pytest.raises(GateError):
        document_plan.load_documents(parts)
    loaded = document_plan.load_documents(parts, strict=False)
    _, totals = document_plan.replace_documents(loaded.paragraphs, RULES, loaded.files)
    got = {r["doc"].rsplit("/", 1)[1][:-5]: (r["replacements"], r["error"]) for r in totals.unionByName(loaded.errors, allowMissingColumns=True).collect()}
    assert got == {
        "sound": (1, None), "empty": (0, "No replacement values were found in the document"), "broken": (None, "DOCX document XML could not be read"),
        "bodyless": (None, "Input is not a valid DOCX document"), "junk": (None, "Input is not a readable DOCX document"),
    }


def test_documents_across_runs(spark, tmp_path):
    parts = b.document(["John ", "Smith"], ["ABC Retirement Portfolio"])
    parts["word/header1.xml"] = parts["word/document.xml"].replace("ABC", "John Smith")
    parts["word/styles.xml"] = parts["word/document.xml"]
    b.write_zip(tmp_path / "d.docx", parts)
    b.write_zip(tmp_path / "e.docx", b.document(["nothing", " here"]))
    found = packages.paragraphs(read(spark, tmp_path, "docx"))
    done = replace_paragraphs(found, RULES)
    texts = {
        (r["part"], r["para_index"]): r["runs"] for r in done.where(F.col("doc").endswith("d.docx")).collect()
    }
    assert texts == {
        ("word/document.xml", 0): ["CLIENT_001", ""], ("word/document.xml", 1): ["PORTFOLIO_001"],
        ("word/header1.xml", 0): ["CLIENT_001", ""], ("word/header1.xml", 1): ["CLIENT_001 Retirement Portfolio"],
    }
    totals = {r["doc"].rsplit("/", 1)[1]: (r["replacements"], r["error"]) for r in document_totals(done).collect()}
    assert totals == {"d.docx": (4, None), "e.docx": (0, "No replacement values were found in the document")}


def test_nested_paragraphs(spark, tmp_path):
    b.write_zip(tmp_path / "d.docx", b.document(["a", ["John", " Smith"], "z"], ["x"]))
    rows = packages.paragraphs(read(spark, tmp_path, "docx")).orderBy("para_index").collect()
    assert rows[0]["runs"] == ["a", "John", " Smith", "z"]
    assert [tuple(s) for s in rows[0]["spans"]] == [(0, 4), (1, 2)]
    assert rows[1]["runs"] == ["x"]


def test_tables_are_never_overwritten_by_accident(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(3)
    write_table(df, out)
    with pytest.raises(PySparkException):
        write_table(df, out)
    write_table(spark.range(5), out, force=True)
    assert spark.read.parquet(out).count() == 5
    with pytest.raises(ValueError, match="must be different"):
        write_table(spark.read.parquet(out), out, force=True)


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "out"
    bad = spark.range(100).repartition(4).selectExpr("id", "IF(id = 97, raise_error('no'), id) AS x")
    with pytest.raises(PySparkException):
        write_table(bad, str(out))
    assert not out.exists() and list(tmp_path.iterdir()) == []
    write_table(spark.range(5), str(out), partition_by=())
    with pytest.raises(PySparkException):
        write_table(bad, str(out), force=True)
    assert spark.read.parquet(str(out)).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    write_table(spark.range(6).selectExpr("id", "id % 2 AS k"), str(out), force=True, partition_by=("k",))
    assert spark.read.parquet(str(out)).where("k = 1").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_one_fault_rejects_the_whole_file(spark, tmp_path):
    b.write_zip(tmp_path / "good.xlsx", b.workbook({"Data": b.clients_sheet()}))
    (tmp_path / "junk.xlsx").write_bytes(b"not a zip")
    b.write_zip(tmp_path / "half.xlsx", b.workbook({"A": b.clients_sheet(), "B": "<broken"}))
    b.write_zip(tmp_path / "bare.xlsx", {"xl/workbook.xml": "<x/>"})
    parts = read(spark, tmp_path)
    with pytest.raises(GateError):
        plan.load_workbooks(parts)
    book = plan.load_workbooks(parts, strict=False)
    assert {r[0].rsplit("/", 1)[1] for r in book.cells.select("file_path").distinct().collect()} == {"good.xlsx"}
    errors = {r["file_path"].rsplit("/", 1)[1]: r["error"] for r in book.errors.collect()}
    assert errors["junk.xlsx"] == "Input is not a readable XLSX workbook"
    assert errors["bare.xlsx"] == "Input is not a valid XLSX workbook package"
    assert errors["half.xlsx"].startswith("xl/worksheets/sheet2.xml") and len(errors) == 3


def test_batches_are_bounded_in_rows_and_bytes():
    made = []

    def rows():
        for i in range(40):
            made.append(i)
            yield f"{i}", ["x" * 500_000] * 2, None

    types = packages.arrow_types("part string, runs array<string>, error string")
    first, *others = packages.in_batches(rows(), types)
    assert [batch.num_rows for batch in (first, *others)] == [9, 9, 9, 9, 4]
    assert sum(batch.num_rows for batch in packages.in_batches((("", [], None) for _ in range(20_000)), types)) == 20_000
    assert max(batch.num_rows for batch in packages.in_batches((("", [], None) for _ in range(20_000)), types)) == packages.BATCH_ROWS
    made.clear()
    next(packages.in_batches(rows(), types))
    assert len(made) == 9  # no row is made before it is wanted
    values = packages.each_row(iter([first, *others]))
    assert next(values) == ("0", ["x" * 500_000] * 2, None) and sum(1 for _ in values) == 39
    assert list(packages.in_batches([], types)) == []
