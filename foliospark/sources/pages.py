"""PDF files as a source of pages.

``read_files`` scans binary files; ``extract_pages`` turns them into one row per page through a page provider, with errors as a column
instead of an exception. ``PdfDataSource`` is the same as a Spark data source, files packed into partitions by size. Scanned pages go through an OCR
provider where one is installed; without one they are empty pages of type ocr.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.schema import EXTRACTED
from foliospark.sources.pdf_reader import PdfError, read_pdf

#: From (bytes, page number) to (text, source type).
Ocr = Callable[[bytes, int], tuple[str, str]]
SCAN_CHARS, DPI = 50, 300


def no_ocr(data: bytes, page: int) -> tuple[str, str]:
    return "", "ocr"


_READERS: dict = {}


def cached_reader(name: str, build: Callable[[], object]) -> object:
    """A reader that is costly to build, such as an OCR model: built once by each Python worker under its name, and used by all its tasks."""
    if name not in _READERS:
        _READERS[name] = build()
    return _READERS[name]


def easyocr_urdu(languages: tuple[str, ...] = ("ur",), gpu: bool = False) -> Callable[[object], list[str]]:
    """Urdu paragraphs of an image by the easyocr library, where it and its models are installed."""

    def run(image: object) -> list[str]:
        def build() -> object:
            import easyocr

            return easyocr.Reader(list(languages), gpu=gpu)

        return cached_reader(f"easyocr-{'-'.join(languages)}-{gpu}", build).readtext(image, detail=0, paragraph=True)  # type: ignore[attr-defined]

    return run


def tesseract_ocr(dictionary: frozenset[str] = frozenset(), urdu: Callable[[object], list[str]] | None = None) -> Ocr:
    """OCR by pdf2image, OpenCV and pytesseract, where they are installed: English first, Urdu if that is no valid English.

    urdu takes the prepared image and gives paragraphs; without it the English text is kept.
    """

    def run(data: bytes, page: int) -> tuple[str, str]:
        import re

        import cv2
        import numpy as np
        import pytesseract
        from pdf2image import convert_from_bytes

        images = convert_from_bytes(data, dpi=DPI, first_page=page, last_page=page)
        if not images:
            return "", "ocr"
        gray = cv2.cvtColor(np.array(images[0]), cv2.COLOR_RGB2GRAY)
        sharp = cv2.threshold(cv2.medianBlur(gray, 3), 0, 255, cv2.THRESH_BINARY + cv2.THRESH_OTSU)[1]
        text = pytesseract.image_to_string(sharp, lang="eng", config="--psm 6 --oem 3")
        words = re.findall(r"[a-z]{3,}", text.lower())
        if urdu is None or (len(words) >= 10 and len(set(words) - dictionary) / len(words) <= 0.5):
            return text, "ocr"
        big = cv2.convertScaleAbs(cv2.resize(gray, None, fx=2, fy=2, interpolation=cv2.INTER_CUBIC), alpha=1.4)
        return "".join(f"{p}\n" for p in urdu(big)), "urdu_ocr"

    return run


def extract(data: bytes, ocr: Ocr = no_ocr) -> dict:
    """Title, author, creation date, pages and error of one file. A page that fails is empty and unknown; a file that fails has no pages."""
    try:
        doc = read_pdf(data)
    except PdfError as e:
        return {"title": None, "author": None, "creation_date": None, "pages": None, "error": str(e)}
    pages = []
    for p in doc.pages:
        text, kind = p.text, "digital"
        if p.error:
            text, kind = "", "unknown"
        elif len(p.text) < SCAN_CHARS and p.has_image:
            try:
                text, kind = ocr(data, p.number)
            except Exception:
                text, kind = "", "unknown"
        pages.append({"page_number": p.number, "text": text, "source_type": kind})
    return {"title": doc.title, "author": doc.author, "creation_date": doc.creation_date, "pages": pages, "error": None if pages else "no pages"}


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", max_bytes: int | None = None) -> DataFrame:
    """path, filename, file_hash (sha-256), content of the files under a folder; files over max_bytes are an error of the scan."""
    if max_bytes is not None:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", max_bytes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return with_hash(files)


def with_hash(files: DataFrame) -> DataFrame:
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("file_hash"), "content")


def extract_pages(files: DataFrame, ocr: Ocr = no_ocr) -> DataFrame:
    """filename, file_hash, title, author, creation_date, pages, error: one row per file."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = pd.DataFrame([extract(bytes(x), ocr) for x in s], columns=EXTRACTED.fieldNames())
            out["creation_date"] = pd.to_datetime(out["creation_date"], utc=True).dt.tz_localize(None)
            yield out

    extracted = F.pandas_udf(run, EXTRACTED)  # type: ignore[call-overload]
    return files.withColumn("_x", extracted(F.col("content"))).select("filename", "file_hash", "_x.*")


def explode_pages(extracted: DataFrame) -> DataFrame:
    """One row per page: file_hash, filename, page_number, text, source_type."""
    return extracted.select("file_hash", "filename", F.explode("pages").alias("p")).select("file_hash", "filename", "p.page_number", "p.text", "p.source_type")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Files by any path that Arrow's file systems know: local ones, hdfs://, s3://, gs://."""

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partition_bytes", 64 << 20))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri(f"file://{os.path.abspath(self.path.removeprefix('file:'))}")

    def partitions(self) -> list[_Files]:
        """Files in order of their paths, packed until a partition has partition_bytes."""
        store, root = self._open()
        there = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if there.type == fs.FileType.Directory else [there]
        out: list[_Files] = []
        size = self.bytes
        for f in sorted((f for f in found if f.type == fs.FileType.File and (f is there or f.path.lower().endswith(".pdf"))), key=lambda f: f.path):
            if size + f.size > self.bytes:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = self._open()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                data = f.read()
            found, name, digest = extract(data), os.path.basename(path), hashlib.sha256(data).hexdigest()
            if found["error"]:
                yield digest, name, None, None, None, found["error"]
            for p in found["pages"] or []:
                yield digest, name, p["page_number"], p["text"], p["source_type"], None


class PdfDataSource(DataSource):
    """``spark.dataSource.register(PdfDataSource)``, then ``spark.read.format("pdf_pages").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "file_hash string, filename string, page_number int, text string, source_type string, error string"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)
