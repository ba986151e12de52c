"""Small office files, written by the tests."""

import zipfile

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def rels(*entries):
    body = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in entries)
    return f'<Relationships xmlns="{RELS}">{body}</Relationships>'


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


def sheet(*cells):
    """Cells as XML; they are grouped into rows by the digits of their reference."""
    rows = {}
    for cell in cells:
        ref = cell.split('r="', 1)[1].split('"', 1)[0]
        rows.setdefault(int("".join(ch for ch in ref if ch.isdigit())), []).append(cell)
    body = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items())
    return f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'


def write_zip(path, parts, compress=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", compress) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)


def workbook(sheets, shared=None, extra=None):
    """Parts of a workbook: sheet name to sheet XML, shared strings as lists of runs."""
    names = "".join(
        f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, start=1)
    )
    parts = {
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(
            *[(f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]
        ),
    }
    for i, xml in enumerate(sheets.values(), start=1):
        parts[f"xl/worksheets/sheet{i}.xml"] = xml
    if shared is not None:
        items = "".join("<si>" + "".join(f'<r><t xml:space="preserve">{t}</t></r>' for t in runs) + "</si>" for runs in shared)
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{items}</sst>'
    return {**parts, **(extra or {})}


def clients_sheet():
    return sheet(
        inline("A1", "Client Export"),
        inline("A2", "Client Name"), inline("B2", "Account ID"), inline("C2", "Portfolio Label"),
        inline("D2", "Notes"), inline("E2", "Formula Cache"),
        inline("A3", "John Smith"), inline("B3", "ACC-100"), inline("C3", "ABC Retirement Portfolio"),
        inline("D3", "John Smith review note"),
        '<c r="E3"><f>CONCAT(A3," - ",C3)</f><v>John Smith - ABC Retirement Portfolio</v></c>',
    )


def document(*paragraphs):
    """Parts of a document; a paragraph is a list of runs, a nested list a paragraph inside."""

    def one(items):
        inside = "".join(one(i) if isinstance(i, list) else f"<w:r><w:t>{i}</w:t></w:r>" for i in items)
        return f"<w:p>{inside}</w:p>"

    body = "".join(one(p) for p in paragraphs)
    return {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>',
    }
