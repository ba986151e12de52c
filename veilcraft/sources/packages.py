"""Office packages as tables.

``read_packages`` unzips files into a ``parts`` table, one row per member. A file
is judged by its list of members first; content is read only of a file that passes,
and kept only of members that some scan needs. ``read_members`` gives the same table
for large files: it reads the list of members alone, deals the members out, and each task reads
the bytes of its own. Each scan below parses its members
one by one where they are; no file passes through the driver. Rows leave an Arrow batch one
at a time (``each_row``) and are gathered to batches of a bounded number and size (``map_rows``).
Python does only what Spark has no reader for: the zip container and the XML
of one member. Decoding, joins and checks are DataFrame operations.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing
from itertools import groupby
from typing import BinaryIO
from urllib.parse import quote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import ArrowInvalid, fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veilcraft.functions import text as tx
from veilcraft.operators.gates import MAX_MEMBERS, MAX_UNCOMPRESSED_BYTES, PACKAGE_ERRORS, REQUIRED_PARTS, UPLOAD_ERROR
from veilcraft.session import materialize

# --- fixed values -----------------------------------------------------------
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PIVOT_PART = r"^xl/pivotCache/(?:pivotCacheDefinition|pivotCacheRecords)\d+\.xml\z"
PIVOT_DEFINITION = r"^xl/pivotCache/pivotCacheDefinition\d+\.xml\z"
DOCUMENT_PART = r"(?s)^word/(?:.*/)?(?:document\.xml|(?:header|footer|footnotes|endnotes|comments)[^/]*\.xml)\z"
UNREADABLE = {
    "xlsx": "Input is not a readable XLSX workbook",
    "docx": "Input is not a readable DOCX document",
}
CORRUPT = {
    "xlsx": "Workbook contains a corrupt package member",
    "docx": "Document contains a corrupt package member",
}
NO_SHEETS = "Workbook does not contain any worksheets"
MISSING_RELATIONSHIP = "Missing relationship for worksheet "
MISSING_SHEET = "Missing or invalid worksheet part for "
# ----------------------------------------------------------------------------

PARTS_SCHEMA = (
    "file_path string, part string, ordinal int, flag_bits int, file_size bigint, "
    "content binary, error string"
)
MEMBER_SCHEMA = "file_path string, part string, ordinal int, flag_bits int, file_size bigint, needed boolean, error string"
BATCH_ROWS = 8192
BATCH_BYTES = 8 * 1024 * 1024
VALUE_BYTES = 50  # what a Python value costs beside its content, about
MEMBERS_PER_TASK = 64


ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, _arrow_type(field.dataType)) for field in kind.fields])
    return ARROW_TYPES[kind.simpleString()]


def arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a schema."""
    return [(field.name, _arrow_type(field.dataType)) for field in T.StructType.fromDDL(schema).fields]


def each_row(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one: of a batch, which may hold thousands of files, only one row at a time becomes Python objects."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in batch.columns)


def _weight(value: object) -> int:
    """About the bytes of a value as a Python object."""
    if isinstance(value, (str, bytes)):
        return VALUE_BYTES + len(value)
    if isinstance(value, dict):
        value = value.values()
    elif not isinstance(value, (list, tuple)):
        return VALUE_BYTES
    return VALUE_BYTES + sum(map(_weight, value))


def in_batches(rows: Iterable[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BATCH_ROWS`` rows that end once they weigh ``BATCH_BYTES``; only a row beyond that makes a larger one."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*held), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in types])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += _weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def map_rows(df: DataFrame, run: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` makes of the values of each row, in batches of bounded size."""
    types = arrow_types(schema)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((made for row in each_row(given) for made in run(*row)), types)

    return df.mapInArrow(batches, schema)


def list_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """path, length and modification time of files; content is not read unless selected.

    Files of another suffix are left out by name, in any case of its letters, before any is opened. Spark lists no file without bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix is None:
        return reader.load(path)
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return reader.option("pathGlobFilter", f"*{letters}").load(path).where(tx.part_suffix(F.col("path")) == suffix)


def read_packages(spark: SparkSession, path: str, kind: str = "xlsx", max_file_bytes: int | None = None) -> DataFrame:
    """Members of all packages below ``path``; files that are unreadable or break a limit are error rows.

    ``max_file_bytes`` is for uploads (see :func:`veilcraft.operators.gates.upload_gate`); a bulk scan has none.
    """
    files = list_files(spark, path, f".{kind}")
    if max_file_bytes is None:
        return unzip(files, kind)
    oversize = files.where(F.col("length") > max_file_bytes).select(F.col("path").alias("file_path"), F.lit(UPLOAD_ERROR).alias("error"))
    return unzip(files.where(F.col("length") <= max_file_bytes), kind).unionByName(oversize, allowMissingColumns=True)


def unzip(files: DataFrame, kind: str = "xlsx") -> DataFrame:
    """Members of the packages in a table of path and content."""
    return map_rows(files.select("path", "content"), _unzip(kind), PARTS_SCHEMA)


def read_members(spark: SparkSession, path: str, kind: str = "xlsx") -> DataFrame:
    """The table of :func:`read_packages`, for files of any size: no task holds a file, only one member at a time.

    A first pass reads each file's list of members (its last bytes) and judges it. The list is written to the shared folder,
    and members are dealt to tasks by a hash of file and place, so that one large file is read by several of them and
    a lost task reads its members again. Errors are those of :func:`read_packages`; a file too large to
    expand is refused by its list. Files are opened by Arrow's file systems (local, s3, gs, abfs, hdfs), which need
    access of their own on the executors; :func:`read_packages` goes through Spark's alone.
    """
    listed = materialize(map_rows(list_files(spark, path, f".{kind}").select("path"), _list_members(kind), MEMBER_SCHEMA), "package-members")
    refused = listed.where("part IS NULL").select("file_path", "error")
    members = listed.where("part IS NOT NULL").drop("error")
    tasks = max(spark.sparkContext.defaultParallelism, members.count() // MEMBERS_PER_TASK)
    dealt = members.repartition(tasks, "file_path", "ordinal").sortWithinPartitions("file_path", "ordinal")
    return dealt.mapInArrow(_read_members(kind), PARTS_SCHEMA).unionByName(refused, allowMissingColumns=True)


def _placed(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and name for a path as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/@:')}")


def _opened(path: str) -> BinaryIO:
    """A file to be read in places."""
    system, name = _placed(path)
    return system.open_input_file(name)


def created(path: str) -> BinaryIO:
    """A new file, with the folders above it."""
    system, name = _placed(path)
    system.create_dir(posixpath.dirname(name), recursive=True)
    return system.open_output_stream(name)


def _list_members(kind: str) -> Callable[[str], Iterator[tuple]]:
    def members(path: str) -> Iterator[tuple]:
        with closing(_opened(path)) as file:
            infos, needed, error = _judged(file, kind)
            if error:
                yield path, None, None, None, None, None, error
            for ordinal, info in enumerate(infos):
                yield path, info.filename, ordinal, info.flag_bits, info.file_size, needed(ordinal), None

    return members


def _read_members(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = arrow_types(PARTS_SCHEMA)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, members in groupby(each_row(batches), lambda row: row[0]):  # in order of files, so that a task opens each once
            with closing(_opened(path)) as file, zipfile.ZipFile(file) as archive:
                infos = archive.infolist()
                for _, part, ordinal, flag_bits, file_size, needed in members:
                    yield path, part, ordinal, flag_bits, file_size, *_content(archive, infos[ordinal], needed, kind)

    return lambda batches: in_batches(contents(batches), types)


def _judged(file: BinaryIO, kind: str) -> tuple[list[zipfile.ZipInfo], Callable[[int], bool], str | None]:
    """The members of a package, which of them some scan needs, by place, and why it is refused; a refused one has no members."""
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, ArrowInvalid):  # the latter where a file is shorter than the end of a list of members
        return [], bool, UNREADABLE[kind]
    infos = archive.infolist()
    if error := _refused(infos, kind):
        return [], bool, error
    last = {info.filename: ordinal for ordinal, info in enumerate(infos)}  # of equal names the last one counts
    needed = _needed(archive, kind)
    return infos, lambda ordinal: last[infos[ordinal].filename] == ordinal and needed(infos[ordinal].filename), None


def _content(archive: zipfile.ZipFile, info: zipfile.ZipInfo, needed: bool, kind: str) -> tuple[bytes | None, str | None]:
    """A member's content, or why there is none. Every member's checksum counts; what is not needed is not kept."""
    try:
        if needed:
            return archive.read(info), None
        with archive.open(info) as stream:
            while stream.read(1 << 20):
                pass
        return None, None
    except (zipfile.BadZipFile, zlib.error):
        return None, CORRUPT[kind]
    except (KeyError, RuntimeError, NotImplementedError):
        return None, UNREADABLE[kind]


def _refused(infos: list[zipfile.ZipInfo], kind: str) -> str | None:
    """Why a package is refused by its list of members, before any is read."""
    too_many, locked, too_large, incomplete = PACKAGE_ERRORS[kind]
    if len(infos) > MAX_MEMBERS:
        return too_many
    if any(info.flag_bits & 1 for info in infos):
        return locked
    if sum(info.file_size for info in infos) > MAX_UNCOMPRESSED_BYTES:
        return too_large
    names = {info.filename for info in infos}
    return None if names.issuperset(REQUIRED_PARTS[kind]) else incomplete


def _needed(archive: zipfile.ZipFile, kind: str) -> Callable[[str], bool]:
    """Whether some scan reads a member; sheets are wherever the workbook's relationships point."""
    if kind == "docx":
        return lambda name: re.search(DOCUMENT_PART.replace(r"\z", r"\Z"), name.replace("\\", "/")) is not None
    try:
        rels = ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = [rel.get("Target") or "" for rel in rels]
    except (ET.ParseError, zipfile.BadZipFile, zlib.error):
        targets = []
    linked = {t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t)) for t in targets}
    fixed = re.compile(r"xl/workbook\.xml|xl/sharedStrings\.xml|(?:.*/)?_rels/[^/]*\.rels|xl/worksheets/.*\.xml|xl/pivotCache/.*\.xml", re.DOTALL)
    skipped = re.compile(r"xl/(?:styles\.xml|theme/.*|calcChain\.xml|vbaProject\.bin)", re.DOTALL)
    return lambda name: fixed.fullmatch(name) is not None or (name in linked and skipped.fullmatch(name) is None)


def _unzip(kind: str) -> Callable[[str, bytes], Iterator[tuple]]:
    def members(path: str, content: bytes) -> Iterator[tuple]:
        file = io.BytesIO(content)
        infos, needed, error = _judged(file, kind)
        if error:
            yield path, None, None, None, None, None, error
            return
        archive = zipfile.ZipFile(file)
        for ordinal, info in enumerate(infos):
            yield path, info.filename, ordinal, info.flag_bits, info.file_size, *_content(archive, info, needed(ordinal), kind)

    return members


def _scan(parts: DataFrame, parse: Callable[[bytes], Iterable[tuple]], schema: str, carry: str = "") -> DataFrame:
    """Rows parsed from each member, with its file_path, part and ``carry`` columns. A member that fails is an error row."""
    carried = [field.split()[0] for field in carry.split(", ")] if carry else []
    width = len(schema.split(", "))

    def rows(path: str, part: str, content: bytes, *more) -> Iterator[tuple]:
        try:
            for row in parse(content):
                yield (path, part, *more, *row, None)
        except ET.ParseError as error:
            yield (path, part, *more, *[None] * width, f"{part}: {error}")

    sound = parts.where("content IS NOT NULL").select("file_path", "part", "content", *carried)
    return map_rows(sound, rows, f"file_path string, part string, {carry + ', ' if carry else ''}{schema}, error string")


def _texts(node: ET.Element, namespace: str) -> list[str]:
    return [t.text or "" for t in node.iter(f"{namespace}t")]


# --- spreadsheets -------------------------------------------------------------


def relationships(parts: DataFrame) -> DataFrame:
    """Relationships of every part: file_path, source_part, ordinal, rel_id, rel_type, target."""

    def parse(content: bytes) -> Iterator[tuple]:
        for ordinal, rel in enumerate(ET.fromstring(content)):
            yield ordinal, rel.get("Id"), rel.get("Type", ""), rel.get("Target")

    rels = _scan(
        parts.where(F.col("part").rlike(r"(?:^|/)_rels/[^/]*\.rels\z")),
        parse,
        "ordinal int, rel_id string, rel_type string, raw_target string",
    )
    source = F.regexp_replace("part", r"(^|/)_rels/([^/]*)\.rels\z", "$1$2")
    return rels.withColumn("source_part", source).withColumn(
        "target", tx.resolve_target(F.col("source_part"), F.col("raw_target"))
    )


def workbook_sheets(parts: DataFrame) -> DataFrame:
    """Sheets in workbook order with the part that holds them; ``error`` where none does."""

    def parse(content: bytes) -> Iterator[tuple]:
        sheets = ET.fromstring(content).find(f"{MAIN}sheets")
        if sheets is None:
            raise ET.ParseError(NO_SHEETS)
        for index, sheet in enumerate(sheets):
            yield index, sheet.get("name", ""), sheet.get(REL_ID)

    listed = _scan(
        parts.where("part = 'xl/workbook.xml'"), parse, "sheet_index int, sheet_name string, rel_id string"
    ).drop("part")
    rels = (
        relationships(parts)
        .where("source_part = 'xl/workbook.xml' AND rel_id IS NOT NULL")
        .groupBy("file_path", "rel_id")
        .agg(F.max_by("target", "ordinal").alias("part"))
    )
    present = parts.where("content IS NOT NULL").select("file_path", "part", F.lit(True).alias("_present"))
    joined = listed.join(rels, ["file_path", "rel_id"], "left").join(present, ["file_path", "part"], "left")
    quoted = F.concat(F.lit("'"), F.col("sheet_name"), F.lit("'"))
    return joined.select(
        "file_path", "sheet_index", "sheet_name", "part",
        F.coalesce(
            "error",
            F.when(F.col("part").isNull(), F.concat(F.lit(MISSING_RELATIONSHIP), quoted)),
            F.when(
                F.col("_present").isNull(),
                F.concat(F.lit(MISSING_SHEET), quoted),
            ),
        ).alias("error"),
    )


def shared_strings(parts: DataFrame) -> DataFrame:
    """Dictionary entries: file_path, ss_index, runs, value."""

    def parse(content: bytes) -> Iterator[tuple]:
        for index, item in enumerate(ET.fromstring(content).findall(f"{MAIN}si")):
            yield index, _texts(item, MAIN)

    entries = _scan(
        parts.where("part = 'xl/sharedStrings.xml'"), parse, "ss_index bigint, runs array<string>"
    )
    return entries.select(
        "file_path", "ss_index", "runs", F.array_join("runs", "").alias("value"), "error"
    )


def _cell_rows(content: bytes) -> Iterator[tuple]:
    """Cells of a sheet in document order, read as a stream."""
    ordinal = 0
    for _, node in ET.iterparse(io.BytesIO(content)):
        if node.tag == f"{MAIN}row":
            node.clear()
        if node.tag != f"{MAIN}c":
            continue
        kind, value, formula = node.get("t"), node.find(f"{MAIN}v"), node.find(f"{MAIN}f")
        if kind == "inlineStr":
            inline = node.find(f"{MAIN}is")
            text = "" if inline is None else "".join(_texts(inline, MAIN))
        else:
            text = "" if value is None else value.text or ""
        yield ordinal, node.get("r", ""), kind, text, None if formula is None else formula.text or ""
        ordinal += 1


def cells(parts: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Raw cells of all sheets; dictionary-typed cells carry ``ss_index`` and no value yet.

    The parts to read are those that sheets refer to, wherever they are. They are joined before
    they are parsed, so a row that moves is a sheet, not a cell.
    """
    sheets = workbook_sheets(parts) if sheets is None else sheets
    listed = sheets.where("error IS NULL").select("file_path", "part", "sheet_index", "sheet_name")
    raw = _scan(
        parts.where("content IS NOT NULL").select("file_path", "part", "content").join(listed, ["file_path", "part"]),
        _cell_rows,
        "ordinal bigint, reference string, cell_type string, raw string, formula string",
        carry="sheet_index int, sheet_name string",
    )
    position = tx.cell_position(F.col("reference"))
    shared = F.coalesce(F.col("cell_type") == "s", F.lit(False))
    index = F.col("raw").try_cast("bigint")
    return raw.withColumn("_p", position).where("_p IS NOT NULL OR error IS NOT NULL").select(
        "file_path", "sheet_index", "sheet_name", F.col("_p.row").alias("row"), F.col("_p.col").alias("col"),
        "ordinal", "cell_type",
        F.when(shared & (F.col("raw") != ""), F.coalesce(index, F.lit(-1))).alias("ss_index"),
        F.when(shared, F.lit("")).otherwise(F.col("raw")).alias("value"),
        "formula", "error",
    )


# --- pivot caches -------------------------------------------------------------


def _flag_names() -> list[str]:
    return [
        "containsString", "containsNumber", "containsInteger", "containsMixedTypes",
        "containsSemiMixedTypes", "minValue", "maxValue",
    ]


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def pivot_fields(parts: DataFrame) -> DataFrame:
    """Cache fields in order, with their shared-item flags and items."""
    flags = _flag_names()

    def parse(content: bytes) -> Iterator[tuple]:
        fields = ET.fromstring(content).find(f"{MAIN}cacheFields")
        for index, field in enumerate(() if fields is None else fields):
            shared = field.find(f"{MAIN}sharedItems")
            items = [] if shared is None else [(_local(i), i.get("v")) for i in shared]
            settings = [None if shared is None else shared.get(name) for name in flags]
            yield index, field.get("name", ""), shared is not None, [
                {"tag": tag, "v": v} for tag, v in items
            ], *settings

    columns = [
        "contains_string", "contains_number", "contains_integer", "contains_mixed_types",
        "contains_semi_mixed_types", "min_value", "max_value",
    ]
    return _scan(
        parts.where(F.col("part").rlike(PIVOT_DEFINITION)),
        parse,
        "field_index int, name string, has_items boolean, items array<struct<tag:string,v:string>>, "
        + ", ".join(f"{c} string" for c in columns),
    ).withColumnRenamed("part", "cache")


def pivot_items(fields: DataFrame) -> DataFrame:
    """Shared items, one row each."""
    exploded = fields.select("file_path", "cache", "field_index", F.posexplode("items").alias("item_index", "i"))
    return exploded.select("file_path", "cache", "field_index", "item_index", "i.tag", "i.v")


def pivot_records(parts: DataFrame) -> DataFrame:
    """Record values of each cache, found through the definition's first records relationship."""

    def parse(content: bytes) -> Iterator[tuple]:
        for row, record in enumerate(ET.fromstring(content)):
            for index, item in enumerate(record):
                yield row, index, _local(item), item.get("v")

    raw = _scan(
        parts.where(F.col("part").rlike(PIVOT_PART) & F.col("part").contains("pivotCacheRecords")),
        parse,
        "row bigint, field_index int, tag string, v string",
    )
    linked = relationships(parts).where(
        F.col("source_part").rlike(PIVOT_DEFINITION)
        & F.col("rel_type").endswith("/pivotCacheRecords")
        & (F.coalesce("raw_target", F.lit("")) != "")
    )
    owner = linked.groupBy("file_path", F.col("source_part").alias("cache")).agg(
        F.min_by("target", "ordinal").alias("part")
    )
    return raw.join(owner, ["file_path", "part"], "left").drop("part")


def pivot_other(parts: DataFrame) -> DataFrame:
    """Values of pivot parts that are neither shared items nor record values: file_path, part, ordinal, tag, v.

    Groups and the like repeat values of the sheet in clear, so rules and restoration take them too.
    """

    def parse(content: bytes) -> Iterator[tuple]:
        root, ordinal = ET.fromstring(content), 0
        known = {id(item) for shared in root.iter(f"{MAIN}sharedItems") for item in shared}
        if root.tag == f"{MAIN}pivotCacheRecords":
            known |= {id(item) for record in root for item in record}
        for element in root.iter():
            if element.get("v") is not None and id(element) not in known:
                yield ordinal, _local(element), element.get("v")
                ordinal += 1

    return _scan(parts.where(F.col("part").rlike(PIVOT_PART)), parse, "ordinal bigint, tag string, v string")


# --- documents ----------------------------------------------------------------


def is_document_part(part: Column) -> Column:
    return F.replace(part, F.lit("\\"), F.lit("/")).rlike(DOCUMENT_PART)


def paragraphs(parts: DataFrame) -> DataFrame:
    """Paragraphs with runs: doc, part, para_index, runs, spans.

    A paragraph inside a paragraph is not a row of its own: its runs are a slice
    of the outer one, listed in ``spans`` after the outer slice.
    """

    def parse(content: bytes) -> Iterator[tuple]:
        root = ET.fromstring(content)
        index = 0

        def collect(node: ET.Element, runs: list[str], slices: list[dict]) -> None:
            mine = None
            if node.tag == f"{WORD}p":
                mine = {"start": len(runs), "length": 0}
                slices.append(mine)
            if node.tag == f"{WORD}t":
                runs.append(node.text or "")
            for child in node:
                collect(child, runs, slices)
            if mine is not None:
                mine["length"] = len(runs) - mine["start"]

        def outermost(node: ET.Element) -> Iterator[ET.Element]:
            if node.tag in (f"{WORD}p", f"{WORD}t"):
                yield node
                return
            for child in node:
                yield from outermost(child)

        for node in outermost(root):
            runs: list[str] = []
            slices: list[dict] = []
            collect(node, runs, slices)
            if runs:
                yield index, runs, slices
                index += 1

    found = _scan(
        parts.where(is_document_part(F.col("part"))),
        parse,
        "para_index bigint, runs array<string>, spans array<struct<start:int,length:int>>",
    )
    return found.withColumnRenamed("file_path", "doc")
