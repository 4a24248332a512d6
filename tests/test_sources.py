"""Binary sources and model surfaces."""

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, notes: str = "", image: bytes | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
        if image:
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/image" Target="media/a.png"/></Relationships>')
            z.writestr("word/media/a.png", image)
    return out.getvalue()


def p(text, bold=False, brk=False, note=""):
    return f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{'<w:lastRenderedPageBreak/>' if brk else ''}<w:t>{text}</w:t>{note}</w:r></w:p>"


def test_docx(spark, tmp_path):
    note = '<w:footnoteReference w:id="2"/>'
    two = docx(p("Title", bold=True) + p("one", note=note) + p("two", brk=True), '<w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote>', b"png")
    long = docx("".join(p("x" * 1000) for _ in range(5)))
    assert files.docx_pages(two) == ["## Title\none\n---\na note", "two"]
    assert [len(x) for x in files.docx_pages(long)] == [3000, 2004]
    for name, data in (("a.docx", two), ("b.docx", long), ("c.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    found = files.with_hash(files.files(spark, str(tmp_path), "*.docx"))
    rows = files.docx_table(found).collect()
    assert sorted((r["path"][-6:], r["page_number"] or 0) for r in rows) == [("a.docx", 1), ("a.docx", 2), ("b.docx", 1), ("b.docx", 2), ("c.docx", 0)]
    assert next(r for r in rows if r["path"].endswith("c.docx"))["error"]
    covers = files.docx_covers(found.where("file_name = 'a.docx'")).first()
    assert bytes(covers["cover"]) == b"png"
    assert found.select("content_hash").distinct().count() == 3


def test_pdf_pages(spark):
    data = [(b"%PDF /Type /Pages /Kids [1] /Count 12 >> /Count 3 /Type /Pages",), (b"none",)]
    assert [r[0] for r in spark.createDataFrame(data, "c binary").select(files.pdf_page_count(F.col("c"))).collect()] == [12, None]


def test_recognition_tries_again(spark):
    def fails(content: bytes) -> str:
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode()

    images = spark.createDataFrame([(1, b"ok"), (2, b"bad")], "id long, content binary")
    got = {r["id"]: (r["text"], r["error"]) for r in files.recognised(images, fails).collect()}
    assert got == {1: ("ok", None), 2: (None, "ValueError: unreadable")}


def test_embeddings(spark):
    chunks = spark.createDataFrame([(1, "a b", None), (2, "a b", None), (3, None, None), (4, "kept", [1.0])], "id long, text string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in models.embed_missing(chunks).collect()}
    assert got[1] == got[2] and len(got[1]) == 64 and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert got[4] == [1.0] and not any(got[3])


def test_summaries_and_rewrites(spark):
    samples = spark.createDataFrame([("b", "long text")], "book_id string, text string")
    row = models.summarised(samples, lambda t: t[:4]).first()
    assert row["summary"] == "long" and len(row["embedding"]) == 64
    assert models.rewritten("q", lambda q: " ") == "q" and models.rewritten("q", lambda q: "r") == "r" and models.rewritten("q", lambda q: 1 / 0) == "q"


def test_page_numbers_by_stretches(spark):
    import random

    from quillspark.sources.library import page_numbers

    rng = random.Random(5)
    rows = [(i, rng.choice(["src0", "src0", "src1", None])) for i in rng.sample(range(-50, 400), 300)]
    got = {r["doc_id"]: r["page_number"] for r in page_numbers(spark.createDataFrame(rows, "doc_id long, source string"), 7).collect()}
    for source in ("src0", "src1", None):
        own = sorted(i for i, s in rows if s == source)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


def test_no_text_is_numbered(spark, data):
    from quillspark.sources.library import Library

    plan = Library(spark, data).pages_v.select("id", "page_number", "text")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and not any("text" in line for line in windows)
    assert "Window" not in Library(spark, data).texts_v.select("id", "text")._jdf.queryExecution().optimizedPlan().toString()
