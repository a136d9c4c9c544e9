"""Text, Markdown, DOCX and PDF files as blocks (path, block, section, page, text, block_type, error)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one file.
MAX_BYTES, MAX_PAGES = 50_000_000, 300
SCHEMA = "path string, block int, section string, page int, text string, block_type string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Suffixes with the bytes that their files begin with; text files have none.
SIGNATURES = {".pdf": b"%PDF-", ".docx": b"PK\x03\x04", ".md": b"", ".markdown": b"", ".txt": b""}


def normalized(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", normalized(text)) if p.strip()]


def markdown(text: str, section: str) -> list[tuple[str, int | None, str, str]]:
    out, lines = [], []

    def flush() -> None:
        out.extend((section, None, p, "paragraph") for p in paragraphs("\n".join(lines)))
        lines.clear()

    for line in normalized(text).split("\n"):
        if m := re.match(r"^#{1,6}\s+(.*?)\s*#*\s*$", line):
            flush()
            section = m.group(1)
        else:
            lines.append(line)
    flush()
    return out


def docx(content: bytes, section: str) -> list[tuple[str, int | None, str, str]]:
    """Paragraphs in order, headings by their style, then tables as rows of cells between bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > MAX_BYTES:
            raise ValueError("the document is too large when unpacked")
        body = ElementTree.fromstring(z.read(info)).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            text = said(e)
            if style is not None and (style.get(f"{_W}val") or "").lower().startswith("heading"):
                section = text or section
            elif text:
                out.append((section, None, text, "paragraph"))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(said(c) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            tables.append((section, None, "\n".join(rows), "table"))
    return [*out, *tables]


def pdf(content: bytes, section: str) -> list[tuple[str, int | None, str, str]]:
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError:
        raise ValueError("no PDF library is installed") from None
    reader = PdfReader(io.BytesIO(content))
    if len(reader.pages) > MAX_PAGES:
        raise ValueError(f"more than {MAX_PAGES} pages")
    return [(section, i, t, "page") for i, p in enumerate(reader.pages, 1) if (t := normalized(p.extract_text() or ""))]


def extract(path: str, content: bytes) -> list[tuple[str, int | None, str, str]]:
    """Blocks of one file by its suffix; a file that gives none is an error."""
    name = path.rsplit("/", 1)[-1]
    stem, _, suffix = name.rpartition(".")
    suffix = f".{suffix.lower()}"
    if suffix not in SIGNATURES:
        raise ValueError(f"suffix {suffix} is not supported")
    if len(content) > MAX_BYTES or not content.startswith(SIGNATURES[suffix]):
        raise ValueError("too large, or not what its suffix says")
    if suffix == ".docx":
        blocks = docx(content, stem)
    elif suffix == ".pdf":
        blocks = pdf(content, stem)
    else:
        text = content.decode("utf-8-sig")
        blocks = [(stem, None, p, "paragraph") for p in paragraphs(text)] if suffix == ".txt" else markdown(text, stem)
    if not blocks:
        raise ValueError("no text")
    return blocks


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files below ``path``. A file that cannot be read or has no text gives one row with its
    error, and does not stop the others; the listing passes over files of no bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    out += [(p, i, s, page, t, kind, None) for i, (s, page, t, kind) in enumerate(extract(p, bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  (any failure of a parser is that file's error)
                    out.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "block", "section", "page", "text", "block_type", "error"])
            yield frame.astype({"block": "Int32", "page": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
