"""File sources: text, HTML, word-processor, spreadsheet, CSV and JSON-lines files as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.functions.text import json_value
from lawframe.scratch import numbered

TYPES = {"txt": "txt", "pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "csv": "csv", "xlsx": "xlsx", "xls": "xls", "json": "json", "jsonl": "jsonl"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def file_type(path: Column) -> Column:
    """The kind of a file by its extension, whatever its case; 'unsupported' for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("unsupported"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None, joint: str = "\n") -> str:
    """Text nodes (those of script and style too), stripped, blanks dropped, joined."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return joint.join(parser.parts)


def html_column(html: Column, joint: str = "\n") -> Column:
    @F.pandas_udf("string")
    def extract(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: html_text(x, joint))

    return extract(html)


def docx_lines(content: bytes, tables: bool = True) -> list[str]:
    """Paragraphs and tables in document order; a tag or a cell a line in tables, empty cells dropped."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()
    found: list[str] = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            found += [text(node)] if text(node) else []
        elif node.tag == f"{WORD}tbl" and tables:
            found.append("<table>")
            for row in node.iter(f"{WORD}tr"):
                cells = [text(c) for c in row.iter(f"{WORD}tc")]
                found += ["<tr>", *(f"<td>{c}</td>" for c in cells if c), "</tr>"]
            found.append("</table>")
    return found


def embedded_objects(content: bytes) -> list[tuple[str, bytes]]:
    """Every entry under word/embeddings; of those that are archives, the documents inside."""
    found: list[tuple[str, bytes]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            if name.startswith("word/embeddings/") and not name.endswith("/"):
                data = archive.read(name)
                found.append((name, data))
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as inner:
                        found += [(f"{name}!{x}", inner.read(x)) for x in inner.namelist() if re.search(r"\.docx?$", x, re.I)]
    return found


def xlsx_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet, named by its first row."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
    sheet = min(n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    rows: list[dict[str, str]] = []
    for row in ElementTree.fromstring(archive.read(sheet)).iter(f"{SHEET}row"):
        cells: dict[str, str] = {}
        for cell in row.iter(f"{SHEET}c"):
            value, inline = cell.find(f"{SHEET}v"), cell.find(f"{SHEET}is")
            text = "".join(t.text or "" for t in inline.iter(f"{SHEET}t")) if inline is not None else "" if value is None else value.text or ""
            cells[re.sub(r"\d+", "", cell.get("r", ""))] = shared[int(text)] if cell.get("t") == "s" and text else text
        rows.append(cells)
    if not rows:
        return []
    names = rows[0]
    return [{names[c]: r.get(c, "") for c in names} for r in rows[1:]]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_documents(spark: SparkSession, path: str, pdf=None) -> DataFrame:
    """(path, file_type, text) of every file below a folder; unsupported kinds have empty text.

    `pdf` is a function from bytes to a list of page texts; without it PDF files have empty text.
    """
    files = read_binary(spark, path).withColumn("file_type", file_type(F.col("path")))

    def extract(batches):


        for batch in batches:
            made = []
            for kind, content in zip(batch["file_type"], batch["content"], strict=True):
                if kind in ("txt", "json", "jsonl", "csv"):
                    made.append(content.decode("utf-8", "replace"))
                elif kind == "html":
                    made.append(html_text(content.decode("utf-8", "replace")))
                elif kind == "docx":
                    made.append("\n".join(docx_lines(content)))
                else:
                    made.append("\n".join(p for p in pdf(content) if p) if kind == "pdf" and pdf else "")
            yield pd.DataFrame({"path": batch["path"], "file_type": batch["file_type"], "text": made})

    return files.mapInPandas(extract, "path string, file_type string, text string")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells map<string,string>) of workbooks below a folder."""

    def extract(batches):


        for batch in batches:
            rows = [(p, i, r) for p, content in zip(batch["path"], batch["content"], strict=True) for i, r in enumerate(xlsx_rows(content))]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return read_binary(spark, path, "*.xlsx").mapInPandas(extract, "path string, row int, cells map<string,string>")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A document catalog, its five key columns lower-cased and stripped."""
    raw = read_csv(spark, path, "Document_ID string, `Full Name` string, `Issued Date` string, issue_year string, Filename string, document_number string, document_type string, issuer_body string")
    keys = ["document_type", "document_number", "issue_year", "issuer_body", "Full Name"]
    return raw.withColumns({c: F.lower(F.trim(F.col(c))) for c in keys})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that are no records stay as `_corrupt_record`."""
    return spark.read.schema(schema + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): numbers from 1 of lines that are no JSON. One pass over whole files: a line's number needs its file."""
    files = read_text(spark, path)
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.trim("line") != "")
    return lines.filter(json_value(F.col("line")).isNull()).select("path", (F.col("at") + 1).alias("line"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of records or a single one."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def folder_catalog(paths: DataFrame, base: str) -> DataFrame:
    """Rows (path) of files named '1.2 Title.ext' to catalog rows; names without a space are left out."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    category = F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/"), -1)
    parts = F.split(F.substring_index(name, " ", 1), r"\.")
    return paths.filter(name.contains(" ")).select(
        category.alias("category"),
        F.substring_index(name, " ", 1).alias("document_id"),
        F.regexp_replace(name, r"^\S* ", "").alias("document_name"),
        F.size(parts).alias("hierarchy_level"),
        F.col("path").alias("document_path"),
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).alias("parent_document_id"),
    )


def by_numeric_suffix(files: DataFrame, name: str = "name") -> DataFrame:
    """Files with their `position` by the number at the end of their stem, those without one last, then by name."""
    suffix = F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1).try_cast("int")
    return numbered(files, suffix.asc_nulls_last(), F.col(name))


def read_pdfs(spark: SparkSession, path: str, pdf) -> DataFrame:
    """(path, text) of the PDF files below a folder; `pdf` is a function from bytes to page texts."""
    return read_documents(spark, path, pdf).filter("file_type = 'pdf'").select("path", "text")


def joined_paragraphs(content: bytes) -> str:
    """A word-processor file's paragraphs with blank lines between; its tables are left out."""
    return "\n\n".join(docx_lines(content, tables=False))


def selected(paths: DataFrame, holding: str = "with_appendix", extensions: tuple = ("docx", "txt", "json", "png")) -> DataFrame:
    """Files (path) whose names hold a word and end in one of the extensions."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.filter(name.contains(holding) & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions))


def embedded_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the objects inside word-processor files below a folder."""

    def extract(batches):
        for batch in batches:
            rows = [(p, n, d) for p, content in zip(batch["path"], batch["content"], strict=True) for n, d in embedded_objects(content)]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return read_binary(spark, path, "*.docx").mapInPandas(extract, "path string, name string, content binary")


def pages_of(pages: DataFrame, done: DataFrame, read) -> DataFrame:
    """Images (name, content) whose names are not in `done` (name), in numeric order with `position`, each with `text`:
    a header line that names it, and what `read` (bytes to text) finds."""

    def extract(batches):
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "text": [f"--- Page: {n} ---\n{read(c)}\n" for n, c in zip(batch["name"], batch["content"], strict=True)]})

    left = pages.join(done.select("name"), "name", "left_anti")
    return by_numeric_suffix(left.select("name", "content").mapInPandas(extract, "name string, text string"))


def first_match(queries: DataFrame, key: str, value: str) -> DataFrame:
    """The first stored query (by `seq`) whose key, query_id or cache_key, has a value."""
    return queries.filter(F.col(key) == value).orderBy("seq").limit(1)


def by_size(models: DataFrame) -> DataFrame:
    """A list of models (model, size_in_gb, ...), the smallest first."""
    return models.orderBy(F.col("size_in_gb").asc_nulls_last(), "model")


def converted(spark: SparkSession, path: str, convert, glob: str = "*.doc") -> DataFrame:
    """(path, content) of old word-processor files below a folder as `convert` (bytes to bytes) makes them new; the names
    end as the new kind's do."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"].str.replace(r"\.doc$", ".docx", case=False, regex=True), "content": [convert(c) for c in batch["content"]]})

    return read_binary(spark, path, glob).mapInPandas(run, "path string, content binary")
