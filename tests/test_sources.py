"""Files, JSON lines, semantic answers, SQL functions and the stream."""

import io
import json
import os
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import sql
from quillmesh.sources import cases, files, semantic, sinks
from quillmesh.streaming import lifecycle

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {WORD}><w:body>{body}</w:body></w:document>")
        for name, data in more.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello \n", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text(" \n ")
    (tmp_path / "d.exe").write_text("x")
    (tmp_path / "e.docx").write_bytes(docx(P.format("first") + "<w:tbl><w:tr><w:tc>" + P.format("x") + "</w:tc><w:tc>" + P.format("y") + "</w:tc></w:tr></w:tbl>"))
    (tmp_path / "f.docx").write_bytes(docx(P.format("a") + "<w:r><w:vanish/></w:r>"))
    (tmp_path / "g.docx").write_bytes(b"no archive")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    (tmp_path / "i.docx").write_bytes(docx('<!DOCTYPE x>'))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "hello" and rows["a.txt"].manifest.text_characters == 5
    assert rows["b.md"].reason == "undecodable" and rows["c.txt"].reason == "no_text" and rows["d.exe"].reason == "unsupported_type"
    assert rows["e.docx"].text == "first\nx\ty" and rows["e.docx"].manifest.tables == 1
    assert rows["f.docx"].reason == "docx_unsupported: hidden_text" and rows["g.docx"].reason == "docx_rejected"
    assert rows["h.pdf"].reason == "pdf_parser_unavailable" and rows["i.docx"].reason == "docx_document_type"
    with_pdf = {r.path.rsplit("/", 1)[-1]: r for r in files.read(spark, str(tmp_path), pdf=lambda data: ("page text", 1)).collect()}
    assert with_pdf["h.pdf"].text == "page text" and with_pdf["h.pdf"].manifest.pages == 1


def test_cases(spark, tmp_path):
    rows = [{"id": "1", "text": "Ann", "entities": [{"value": "Ann", "type": "PERSON"}]}, {"id": "2", "text": "x", "entities": [{"value": "y", "type": "NOPE"}]}, {"id": "2", "text": "x", "entities": []}]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    read = cases.read_cases(spark, str(path))
    assert read.where("case_id = '1'").first().category == "standard"
    assert {tuple(r) for r in cases.case_violations(read).collect()} == {("2", "duplicate_id"), ("2", "unknown_type")}
    sinks.write_bundle(read.where("case_id = '1'"), "salt", str(tmp_path / "bundle"), "v1", "0" * 64)
    assert spark.read.json(str(tmp_path / "bundle/blind-items")).columns == ["item_id", "language", "text"]


def test_semantic_answers(spark):
    def ask(text, model):
        if model == "down":
            raise semantic.Failed("unavailable")
        return {"content": "", "reasoning_content": '{"entities":[]}'}

    df = spark.createDataFrame([(1, "a"), (2, "b")], "key int, text string")
    rows = semantic.answers(df, ask, ["up", "down"]).collect()
    assert {(r.model, r.code) for r in rows} == {("up", None), ("down", "unavailable")} and len(rows) == 4
    for bad in ("https://127.0.0.1/v1", "http://example.com/v1", "http://127.0.0.1/v2", "http://u@127.0.0.1/v1"):
        try:
            semantic.endpoint(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT pii_is_card('4111 1111 1111 1111'), pii_ratio(1, 32)").first()[:] == (True, 0.0312)
    assert [r.value for r in spark.sql("SELECT * FROM detect_entities('to x@y.example')").collect()] == ["x@y.example"]


def test_stream(spark, tmp_path):
    schema = "op_id string, at double, seq long, action string, revision int, acknowledge boolean, blocked boolean, warned boolean"
    rows = [("a", 0.0, 1, "create", None, False, False, False), ("a", 1.0, 2, "authorize", 0, False, False, False), ("a", 2.0, 3, "complete", None, False, False, False), ("b", 0.0, 4, "complete", None, False, False, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = lifecycle.outcomes(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.sql("SELECT * FROM life").count() < 4:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {(r.op_id, r.action): r.outcome for r in spark.sql("SELECT * FROM life").collect()}
    assert got == {("a", "create"): "operation_created", ("a", "authorize"): "operation_authorized", ("a", "complete"): "completed", ("b", "complete"): "operation_not_found"}


def archive(flags: int = 0, **members: bytes | int) -> zipfile.ZipFile:
    """An archive in memory; numbers stand for members said to have that size."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("[Content_Types].xml", "word/document.xml"):
            z.writestr(name, "<x/>")
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("-", "."), b"" if isinstance(data, int) else data)
    read = zipfile.ZipFile(out)
    for m in read.infolist():
        size = members.get(m.filename.replace("/", "__"))
        if isinstance(size, int):
            m.file_size = size
            m.compress_size = max(1, size // 100)
        m.flag_bits |= flags
    return read


@pytest.mark.parametrize(
    ("reason", "made"),
    [
        ("docx_too_many_members", lambda: archive(**{f"m{i}": b"" for i in range(511)})),
        ("docx_too_large", lambda: archive(a=9 << 20, b=9 << 20, c=9 << 20)),
        ("docx_member_too_large", lambda: archive(a=(10 << 20) + 1)),
        ("docx_encrypted", lambda: archive(flags=1)),
        ("docx_document_type", lambda: archive(**{"a.rels": b" <!ENTITY x>"})),
        ("docx_unsupported: comments, embedded_object, footnotes_or_endnotes, macro, text_box", lambda: archive(**{
            "word__embeddings__a": b"", "word__Comments.xml": b"", "word__endnotes.xml": b"<w:txbxContent/>", "x__vbaProject.bin": b""})),
    ],
)
def test_archive_rules(reason, made):
    with pytest.raises(files.Refused, match=f"^{reason}$"):
        files.check_archive(made())


def test_archive_ratio_and_missing_parts():
    dense = archive(a=(1 << 20) + 1)
    next(m for m in dense.infolist() if m.filename == "a").compress_size = 5000
    with pytest.raises(files.Refused, match="docx_compression_ratio"):
        files.check_archive(dense)
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    with pytest.raises(files.Refused, match="docx_missing_parts"):
        files.check_archive(zipfile.ZipFile(out))
    files.check_archive(archive(a=1 << 20, notes=b"<w:vanish"))


def pdf(*objects: str, trailer: str = "/Root 1 0 R") -> bytes:
    return ("%PDF-1.7\n" + "\n".join(f"{i} 0 obj\n{o}\nendobj" for i, o in enumerate(objects, 1)) + f"\ntrailer <<{trailer}>>\n%%EOF").encode("latin-1")


def packed(text: str, n: int = 1) -> str:
    body = zlib.compress(text.encode("latin-1"))
    return f"<</Type /ObjStm /N {n} /Filter /FlateDecode /Length {len(body)}>>\nstream\n{body.decode('latin-1')}\nendstream"


@pytest.mark.parametrize(
    ("reason", "data"),
    [
        ("pdf_encrypted", pdf("<<>>", trailer="/Encrypt 2 0 R")),
        ("pdf_too_many_pages", pdf(*["<</Type /Page>>"] * 101)),
        ("pdf_too_many_objects", pdf(*["0"] * 10_001)),
        ("pdf_too_many_objects", pdf(packed("0", 10_001))),
        ("pdf_unsupported: automatic_action, embedded_files, javascript", pdf("<</Names <</EmbeddedFiles 2 0 R /JavaScript 3 0 R>> /OpenAction 4 0 R>>")),
        ("pdf_unsupported: annotations, interactive_form, xfa_form", pdf(packed("<</AcroForm <</XFA 1 0 R>>>> <</Type /Page /Annots []>>"))),
        ("pdf_unsupported: automatic_action, optional_content_layers", pdf("<</A#41 2 0 R /OCProp#65rties 3 0 R>>")),
        ("pdf_too_large", pdf(packed(" " * (26 << 20)))),
        ("damaged", pdf(packed("x").replace("stream\nx", "stream\nq", 1))),
        ("pdf_unseen_objects", pdf(packed("x").replace("FlateDecode", "LZWDecode"))),
    ],
)
def test_pdf_rules(reason, data):
    with pytest.raises(files.Refused, match=f"^{reason}$"):
        files.check_pdf(data)


def test_plain_pdf_passes():
    files.check_pdf(pdf("<</Type /Catalog /Pages 2 0 R>>", "<</Type /Pages /Kids [3 0 R]>>", "<</Type /Page /Contents 4 0 R>>", "<</Length 9>>\nstream\n(/AA /XFA)\nendstream", packed("<</AAPL 1>>")))


def test_parsers_that_hang_or_die(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf("<<>>"))
    (tmp_path / "b b.pdf").write_bytes(b"")
    read = lambda parser, seconds=8.0: {r.path.rsplit("/", 1)[-1]: r.reason for r in files.read(spark, str(tmp_path), parser, seconds).collect()}
    assert read(lambda data: time.sleep(60), 0.3) == {"a.PDF": "parser_timeout", "b b.pdf": "empty_file"}
    assert read(lambda data: os._exit(3))["a.PDF"] == "parser_died"
    assert read(lambda data: 1 / 0)["a.PDF"] == "parser_failed"
    assert read(lambda data: ("fine", 1))["a.PDF"] is None


def test_contents_of_refused_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = files.read(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 4 and sum("content" in line.split("Batched")[0] for line in scans) == 2
    assert all("LessThanOrEqual(length" in line for line in scans if "content" in line.split("Batched")[0])
