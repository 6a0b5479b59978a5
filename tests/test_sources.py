"""File sources on files made here."""

import io
import zipfile

from lawframe.sources import files


def docx(body: str) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        z.writestr("word/embeddings/a.bin", b"x")
    return held.getvalue()


CELL = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
BODY = "<w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr>" + CELL.format("c1") + CELL.format("") + "</w:tr></w:tbl>"


def xlsx() -> bytes:
    held, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>n</t></si><si><t>ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    return held.getvalue()


def test_docx():
    assert files.docx_lines(docx(BODY)) == ["one two", "<table>", "<tr>", "<td>c1</td>", "</tr>", "</table>"]
    assert files.embedded_objects(docx(BODY)) == [("word/embeddings/a.bin", b"x")]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("plain")
    (tmp_path / "sub" / "b.htm").write_text("<p>x</p><script>s</script>")
    (tmp_path / "c.docx").write_bytes(docx(BODY))
    (tmp_path / "d.bin").write_bytes(b"\0")
    got = {r["path"].rsplit("/", 1)[1]: (r["file_type"], r["text"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("txt", "plain"), "b.htm": ("html", "x\ns"), "c.docx": ("docx", "one two\n<table>\n<tr>\n<td>c1</td>\n</tr>\n</table>"), "d.bin": ("unsupported", "")}


def test_xlsx(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(xlsx())
    assert [r["cells"] for r in files.read_xlsx(spark, str(tmp_path)).collect()] == [{"name": "ann", "n": "5"}]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"record_id": "1"}\n{bad\n{"record_id": "2"}\n')
    rows = files.read_jsonl(spark, str(path), "record_id string").cache()
    assert rows.filter("_corrupt_record is null").count() == 2 and rows.filter("_corrupt_record is not null").count() == 1
    assert [r["line"] for r in files.malformed_lines(spark, str(path)).collect()] == [2]


def test_folder_catalog(spark):
    paths = spark.createDataFrame([("b/laws/1.2 Some name.txt",), ("b/laws/nospace.txt",)], "path string")
    got = files.folder_catalog(paths, "b").collect()
    assert [(r["category"], r["document_id"], r["document_name"], r["hierarchy_level"], r["parent_document_id"]) for r in got] == [("laws", "1.2", "Some name", 2, "1")]


def test_numeric_suffix(spark):
    names = spark.createDataFrame([("p10.png",), ("x.png",), ("p2.png",)], "name string")
    assert [r["name"] for r in files.by_numeric_suffix(names).collect()] == ["p2.png", "p10.png", "x.png"]
