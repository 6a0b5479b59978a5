"""Workbooks as a data source: `spark.read.format("workbook").load(folder)` and `df.write.format("workbook")`.

Read: the first sheet of every .xlsx file below `path`, columns named by its first row. Without a schema all columns of
the first file are strings; with one only its columns are made, by name, others of a file are skipped and missing ones
are null, and so is a cell that does not hold its column's type. Files are packed into partitions of `partitionBytes`
(16 MB unless given), each streamed row by row, so a task holds one file's shared strings and one batch. A sheet is one
compressed stream, so a file is not split. With `pushdown` true equalities and null checks on columns go to the reader,
which needs `spark.sql.python.filterPushdown.enabled`; `read_workbooks` sees to that.

Write: a task writes a file for every `rowsPerFile` rows (200,000 unless given; sheets end at 1,048,576), under names that
readers skip until the job commits. Nulls are no cells. Characters that XML has no place for are kept as _xHHHH_. Texts of
over 32,767 characters are read back whole here, but office programs cut them.

`path` is anything that pyarrow reads: a folder that all machines mount, or a URI of a file system known to it.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "workbook"
BATCH = 4096
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Day 0 of serial dates.
EPOCH = dt.datetime(1899, 12, 30)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the workbooks below a folder, or of a single one, in the order of their names."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.extension.lower() == "xlsx" and f.base_name[0] not in "_.~")


def kept(text: str) -> str:
    """Characters that XML has no place for as _xHHHH_, and what looks like that escaped."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)


def restored(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def cell_rows(file) -> Iterator[dict[str, str]]:
    """The rows of a workbook's first sheet as {column letters: text}, streamed."""
    with zipfile.ZipFile(file) as archive:
        names = archive.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with archive.open("xl/sharedStrings.xml") as f:
                for _, item in ElementTree.iterparse(f):
                    if item.tag == f"{SHEET}si":
                        shared.append(restored("".join(t.text or "" for t in item.iter(f"{SHEET}t"))))
                        item.clear()
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        if not sheets:
            return
        with archive.open(sheets[0]) as f:
            data = None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{SHEET}sheetData" else data
                elif node.tag == f"{SHEET}row":
                    yield dict(filter(None, (_cell(c, i, shared) for i, c in enumerate(node.iter(f"{SHEET}c")))))
                    data.clear()


def letters(i: int) -> str:
    """0 is A, 26 is AA."""
    found = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        found = chr(65 + rest) + found
    return found


def _cell(cell, place: int, shared: list[str]) -> tuple[str, str] | None:
    kind, value, inline = cell.get("t"), cell.find(f"{SHEET}v"), cell.find(f"{SHEET}is")
    if inline is not None:
        text = restored("".join(t.text or "" for t in inline.iter(f"{SHEET}t")))
    elif value is None or kind == "e":
        return None
    else:
        text = value.text or ""
        text = shared[int(text)] if kind == "s" else restored(text) if kind == "str" else text
    return re.sub(r"\d+", "", cell.get("r", "")) or letters(place), text


def _whole(text: str) -> int:
    number = Decimal(text)
    if number != number.to_integral_value():
        raise ValueError(text)
    return int(number)


def _truth(text: str) -> bool:
    return {"1": True, "0": False, "true": True, "false": False}[text.strip().lower()]


def _moment(text: str) -> dt.datetime:
    try:
        return EPOCH + dt.timedelta(microseconds=round(float(text) * 86_400_000_000))
    except ValueError:
        return dt.datetime.fromisoformat(text.strip())


MADE = {
    "string": str, "boolean": _truth, "double": float, "float": float, "date": lambda x: _moment(x).date(), "timestamp": _moment, "timestamp_ntz": _moment, "decimal": Decimal,
    "byte": _whole, "short": _whole, "integer": _whole, "long": _whole,
}


def _value(make, text: str | None):
    try:
        return None if text is None else make(text)
    except (ValueError, ArithmeticError, KeyError):
        return None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        unknown = [f.name for f in schema if f.dataType.typeName() not in MADE]
        if unknown:
            raise ValueError(f"a workbook has no such columns as {', '.join(unknown)}")
        self.path, self.schema, self.size, self.tests = path, schema, size, []

    def partitions(self):
        packed: list[list[str]] = []
        held = 0
        for path, size in files_below(self.path):
            if not packed or held + size > self.size:
                packed.append([])
                held = 0
            packed[-1].append(path)
            held += size
        return [Files(tuple(p)) for p in packed]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        system, schema = file_system(self.path)[0], to_arrow_schema(self.schema)
        fields = [(f.name, MADE[f.dataType.typeName()]) for f in self.schema]
        for path in partition.paths if partition else ():
            with system.open_input_file(path) as file:
                rows = cell_rows(file)
                place = {name: letter for letter, name in reversed(next(rows, {}).items())}
                made: list[dict] = []
                for cells in rows:
                    row = {name: _value(make, cells.get(place.get(name, ""))) for name, make in fields}
                    if all(test(row[name]) for name, test in self.tests):
                        made.append(row)
                    if len(made) == BATCH:
                        yield _batch(made, schema)
                        made = []
                if made:
                    yield _batch(made, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in schema:
        values = [r[f.name] for r in rows]
        try:
            columns.append(pa.array(values, f.type))
        except (pa.ArrowInvalid, OverflowError):  # a number beyond its column's type
            columns.append(pa.array([_fit(v, f.type) for v in values], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _fit(value, kind: pa.DataType):
    try:
        pa.scalar(value, kind)
        return value
    except (pa.ArrowInvalid, OverflowError):
        return None


class PushingReader(Reader):
    """Takes the filters that it can test on a column of its own; Spark tests the others."""

    def pushFilters(self, filters):
        whole = {f.name for f in self.schema if f.dataType.typeName() in ("string", "boolean", "integer", "long", "short", "byte", "double")}
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name not in whole:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, lambda v, x=f.value: v is not None and v == x))
            elif isinstance(f, In):
                self.tests.append((name, lambda v, x=frozenset(f.value): v is not None and v in x))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, lambda v: v is not None))
            elif isinstance(f, IsNull):
                self.tests.append((name, lambda v: v is None))
            else:
                yield f


#: The parts of a workbook besides its sheet.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _written(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r={quoteattr(ref)} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c r={quoteattr(ref)}><v>{(value.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c r={quoteattr(ref)}><v>{(value - EPOCH.date()).days}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f'<c r={quoteattr(ref)}><v>{value}</v></c>'
    return f'<c r={quoteattr(ref)} t="inlineStr"><is><t xml:space="preserve">{escape(kept(str(value)))}</t></is></c>'


def write_workbook(file, names: list[str], rows: Iterator[tuple]) -> None:
    """One workbook of a header and rows, streamed into `file`."""
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in PARTS.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + part)
        with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{SHEET[1:-1]}"><sheetData>'.encode())
            columns = [letters(i) for i in range(len(names))]
            sheet.write(_row(columns, 1, tuple(names)))
            for n, row in enumerate(rows, 2):
                sheet.write(_row(columns, n, row))
            sheet.write(b"</sheetData></worksheet>")


def _row(columns: list[str], n: int, row: tuple) -> bytes:
    return f'<row r="{n}">{"".join(_written(f"{c}{n}", v) for c, v in zip(columns, row, strict=True))}</row>'.encode()


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, rows: int, overwrite: bool):
        self.path, self.names, self.rows, self.overwrite = path, schema.names, rows, overwrite

    def write(self, iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        rows = (tuple(r) for batch in iterator for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        done: list[str] = []
        first = next(rows, None)
        while first is not None:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            taken = iter(_taking(first, rows, self.rows))
            with system.open_output_stream(f"{root}/_{name}") as out:
                write_workbook(_Forward(out), self.names, taken)
            done.append(name)
            first = next(rows, None)
        return Written(tuple(done))

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old = [p for p, _ in files_below(self.path)] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{root}/_{name}", f"{root}/{name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else ():
                if system.get_file_info(f"{root}/_{name}").type == pafs.FileType.File:
                    system.delete_file(f"{root}/_{name}")


def _taking(first: tuple, rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    yield first
    for _ in range(most - 1):
        row = next(rows, None)
        if row is None:
            return
        yield row


class _Forward:
    """A stream without places to go back to, for the archive, which then writes sizes behind its parts."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        path = self.options["path"]
        found = files_below(path)
        if not found:
            raise ValueError(f"no workbook below {path}, so a schema must be given")
        with file_system(path)[0].open_input_file(found[0][0]) as file:
            names = list(dict.fromkeys(next(cell_rows(file), {}).values()))
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema: StructType) -> Reader:
        made = PushingReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return made(self.options["path"], schema, int(self.options.get("partitionBytes", 16 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        unknown = [f.name for f in schema if f.dataType.typeName() not in MADE]
        if unknown:
            raise ValueError(f"a workbook has no such columns as {', '.join(unknown)}")
        return Writer(self.options["path"], schema, int(self.options.get("rowsPerFile", 200_000)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def read_workbooks(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """The rows of the workbooks below a folder; filters reach the reader where the session lets them."""
    register(spark)
    pushing = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    reader = spark.read.format(NAME).option("pushdown", pushing).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
