import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.api import Engine
from foliospark.config import Config
from foliospark.functions.register import register
from foliospark.operators.embedding import HashingEmbedder
from foliospark.plans.ingest import ingest
from foliospark.plans.search import SearchError, search
from foliospark.sources.index import Index
from foliospark.sources.pages import PdfDataSource, explode_pages, extract, extract_pages, read_files
from foliospark.sources.pdf_reader import PdfError, read_pdf
from foliospark.streaming.ingest import ingest_stream, job_status, jobs


def pdf(pages: list[str], title: str = "A title", image: bool = False, compress: bool = True, packed: bool = False) -> bytes:
    """A small file: one font, text line by line, an image object if asked for; packed puts plain objects into an object stream."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    streams: dict[int, bytes] = {}
    kids = []
    if image:
        streams[5] = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\n0\nendstream"
    for i, text in enumerate(pages):
        body = b"BT /F1 12 Tf 14 TL 50 700 Td " + b" ".join(b"(" + line.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252") + b") Tj T*" for line in text.split("\n")) + b" ET"
        data = zlib.compress(body) if compress else body
        streams[10 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data)
        objects[11 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> %s >> >>" % (10 + 2 * i, b"/XObject << /I 5 0 R >>" if image else b"")
        kids.append(b"%d 0 R" % (11 + 2 * i))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(kids))
    objects[4] = b"<< /Title (%s) /Author <FEFF00410042> /CreationDate (D:20240203040506+01'00') >>" % title.encode("cp1252")
    if packed:
        head, body = b"", b""
        for n, o in objects.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        data = zlib.compress(head + body)
        streams[99] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(objects), len(head), len(data), data)
        objects = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in {**objects, **streams}.items())
    return out + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_read_pdf(compress, packed):
    doc = read_pdf(pdf(["Hello (world)\nsecond line é", "p2"], compress=compress, packed=packed))
    assert [p.text for p in doc.pages] == ["Hello (world)\nsecond line é", "p2"]
    assert doc.title == "A title" and doc.author == "AB" and doc.creation_date.isoformat() == "2024-02-03T03:05:06+00:00"
    assert doc.pages[0].has_fonts and not doc.pages[0].has_image


def test_bad_files():
    with pytest.raises(PdfError):
        read_pdf(b"nothing")
    assert extract(b"")["error"] and extract(b"%PDF-1.4 broken")["pages"] is None
    assert extract(pdf([]))["error"] == "no pages"


def test_scanned_route():
    assert extract(pdf(["x" * 49], image=True))["pages"][0]["source_type"] == "ocr"
    assert extract(pdf(["x" * 50], image=True))["pages"][0]["source_type"] == "digital"
    assert extract(pdf([""]))["pages"][0] == {"page_number": 1, "text": "", "source_type": "digital"}
    assert extract(pdf(["x"], image=True), lambda data, page: (f"read {page}", "urdu_ocr"))["pages"][0]["text"] == "read 1"

    def fails(data, page):
        raise RuntimeError

    assert extract(pdf(["x"], image=True), fails)["pages"][0] == {"page_number": 1, "text": "", "source_type": "unknown"}


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


SENTENCES = "The committee approved the flood barrier near the harbour after a long debate. " * 20


def test_sources(spark, tmp_path):
    write(tmp_path / "in", "a.pdf", pdf(["one", "two"]))
    write(tmp_path / "in", "bad.pdf", b"junk")
    found = extract_pages(read_files(spark, str(tmp_path / "in")))
    assert {r["filename"]: r["error"] for r in found.collect()} == {"a.pdf": None, "bad.pdf": "no PDF header"}
    assert explode_pages(found).count() == 2
    spark.dataSource.register(PdfDataSource)
    rows = spark.read.format("pdf_pages").load(str(tmp_path / "in")).orderBy("filename", "page_number").collect()
    assert [(r["filename"], r["page_number"], r["text"], r["error"]) for r in rows] == [("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("bad.pdf", None, None, "no PDF header")]


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="positive"):
        Index.create(spark, path, 0)
    with pytest.raises(FileNotFoundError):
        Index.open(spark, path)
    index = Index.create(spark, path, 16)
    assert index.chunks().count() == 0 and not index.has_file("x")
    write(tmp_path / "in", "a.pdf", pdf([SENTENCES]))
    write(tmp_path / "in", "b.pdf", pdf([SENTENCES + "Another quiet sentence about turbines. " * 20]))
    write(tmp_path / "in", "empty.pdf", pdf([" "]))
    config = Config(dimension=16)
    result, outcome = ingest(spark, index, str(tmp_path / "in"), config=config)
    assert result.success and result.rows == index.chunks().count() > 1
    assert {r["filename"]: (r["status"], r["error"]) for r in outcome.collect()} == {"a.pdf": ("success", None), "b.pdf": ("success", None), "empty.pdf": ("failed", "no text could be extracted")}
    # the same files again, then other bytes under a known name
    again, outcome = ingest(spark, index, str(tmp_path / "in"), config=config)
    assert not again.success and index.manifest()["seq"] == 1
    write(tmp_path / "in", "a.pdf", pdf([SENTENCES + "Changed. "]))
    again, outcome = ingest(spark, index, str(tmp_path / "in"), config=config)
    assert {r["filename"]: r["error"] for r in outcome.collect()}["a.pdf"] == "duplicate file or filename"
    # search
    found = search(index, "turbines", embedder=HashingEmbedder(16), config=config).collect()
    assert found[0]["document_name"] == "b.pdf" and found[0]["first_rank"] == 1
    assert [r["document_name"] for r in search(index, "flood barrier", filters={"filename": "a.pdf"}, embedder=HashingEmbedder(16), config=config).collect()] == ["a.pdf"]
    # delete, append again, replace, compact
    assert index.delete_by_filename("a.pdf").success and not index.has_filename("a.pdf") and not index.delete_by_filename("a.pdf").success
    assert index.postings().select("id").distinct().count() == index.chunks().count()
    again, _ = ingest(spark, index, str(tmp_path / "in"), config=config)
    assert again.success and index.has_filename("a.pdf")
    write(tmp_path / "two", "a.pdf", pdf([SENTENCES * 2]))
    before = {r["document_id"] for r in index.chunks().select("document_id").collect()}
    replaced, _ = ingest(spark, index, str(tmp_path / "two"), config=config, on_conflict="replace")
    assert replaced.success and index.files().filter(F.col("filename") == "a.pdf").count() == 1
    assert {r["document_id"] for r in index.chunks().select("document_id").collect()} != before
    rows = index.chunks().count()
    assert index.compact().rows == rows and len(index.manifest()["segments"]) == 1
    with pytest.raises(ValueError, match="dimension"):
        Index.create(spark, path, 17)


def test_stream(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "index"), 16)
    landing, log, check = (str(tmp_path / x) for x in ("in", "jobs", "check"))
    write(tmp_path / "in", "a.pdf", pdf([SENTENCES]))
    for name, data in (("first", None), ("second", pdf([SENTENCES + "More of it here. " * 30])), ("bad", b"junk")):
        if data:
            write(tmp_path / "in", f"{name}.pdf", data)
        query = ingest_stream(spark, index, landing, log, check, HashingEmbedder(16), Config(dimension=16))
        query.awaitTermination(120)
        assert query.exception() is None
    last = {r["filename"]: (r["job_id"], r["status"]) for r in jobs(spark, log).filter("status IN ('success', 'failed')").collect()}
    assert {k: v[1] for k, v in last.items()} == {"a.pdf": "success", "second.pdf": "success", "bad.pdf": "failed"}
    assert job_status(spark, log, last["bad.pdf"][0])["error"] == "no PDF header"
    assert index.files().count() == 2


def test_sql_functions(spark):
    assert len(register(spark)) > 15
    assert spark.sql(r"SELECT folio_fix_hyphenation('a-\nb') AS r").first()["r"] == "ab"
    assert spark.sql("SELECT folio_normalize_linebreaks('a\nb\n\n\n\nc') AS r").first()["r"] == "a b\n\nc"
    assert spark.sql("SELECT folio_clean_page('a0b\nxx', 'ocr') AS r").first()["r"] == "aOb xx"
    rows = spark.sql("SELECT * FROM folio_chunks(array('a b c', 'd e'), 3, 1, 1)").collect()
    assert [r["content"] for r in rows] == ["a b c", "c d e"]


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"), HashingEmbedder(16), Config(dimension=16))
    assert engine.job_status("x") == {"error": "job not found"}
    write(tmp_path / "in", "a.pdf", pdf([SENTENCES]))
    write(tmp_path / "in", "bad.pdf", b"junk")
    job, bad = engine.submit(str(tmp_path / "in" / "a.pdf")), engine.submit(str(tmp_path / "in" / "bad.pdf"))
    assert engine.job_status(job) == {"status": "queued", "filename": "a.pdf"}
    engine.run()
    assert engine.job_status(job) == {"status": "success", "filename": "a.pdf"}
    assert engine.job_status(bad) == {"status": "failed", "filename": "bad.pdf", "error": "no PDF header"}
    assert not list((tmp_path / "root" / "landing").glob("*"))  # what has ended is removed
    engine.run()
    response = engine.search("flood barrier", 2)
    assert response["Succeeded"] and [d["document_name"] for d in response["response"].values()] == ["a.pdf"]
    with pytest.raises(FileNotFoundError):
        engine.submit(str(tmp_path / "absent.pdf"))
    with pytest.raises(ValueError):
        engine.search(" ")
    for f in (tmp_path / "root").glob("*/segment-*/postings/*.parquet"):
        f.write_bytes(b"gone")
    spark.catalog.clearCache()
    with pytest.raises(SearchError):  # it fails on an executor, not when it is planned
        engine.search("flood barrier", 2)


def test_files_are_packed_into_partitions(tmp_path):
    from foliospark.sources.pages import _Reader

    (tmp_path / "in").mkdir()
    for i in range(10):
        write(tmp_path / "in" / str(i), f"{i}.PDF" if i % 2 else f"{i}.pdf", b"x" * 100)
    write(tmp_path / "in", "note.txt", b"x")
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        packed = _Reader({"path": path, "partition_bytes": "300"}).partitions()
        assert [len(p.paths) for p in packed] == [3, 3, 3, 1]
    assert [len(p.paths) for p in _Reader({"path": str(tmp_path / "in" / "0" / "0.pdf")}).partitions()] == [1]
    (tmp_path / "none").mkdir()
    assert _Reader({"path": str(tmp_path / "none")}).partitions() == []
