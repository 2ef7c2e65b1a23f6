"""Files of several formats as one table of texts, with a status instead of an exception for what cannot be read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that can be read and the media types each may come with; most bytes of a file.
ALLOWED = {
    "txt": ("text/plain",),
    "md": ("text/markdown", "text/plain", "text/x-markdown"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",),
    "pdf": ("application/pdf",),
}
MOST_BYTES = 20 * 1024 * 1024

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def allowed(path: Column, media_type: Column, size: Column) -> Column:
    """Whether an upload has a known extension, a media type that fits it, and a size within bounds."""
    known = F.lit(False)
    for ext, types in ALLOWED.items():
        known = known | ((extension(path) == ext) & F.lower(media_type).isin(*types))
    return known & (size <= MOST_BYTES)


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, headings as Markdown; formulas follow in a list of their own."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        words = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = next((s.get(f"{_W}val", "") for s in p.iter(f"{_W}pStyle")), "")
        level = re.search(r"[Hh]eading ?(\d)", style)
        if words:
            out.append("#" * int(level[1]) + " " + words if level else words)
    formulas = ["".join(t.text or "" for t in m.iter(f"{_M}t")) for m in root.iter(f"{_M}oMath")]
    if formulas := [f for f in formulas if f.strip()]:
        out.append("\n".join(f"- {f}" for f in formulas))
    return "\n\n".join(out)


def pptx_text(data: bytes) -> str:
    """Slides in the order of their numbers, each under a header, divided by rules."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        for number, name in sorted(names):
            words = " ".join(t.text.strip() for t in ElementTree.fromstring(z.read(name)).iter(f"{_A}t") if t.text and t.text.strip())
            if words:
                pages.append(f"## page {number}\n\n{words}")
    return "\n\n---\n\n".join(pages)


def parse(ext: str, data: bytes, pdf_reader=None) -> tuple[str | None, str]:
    """Text and status of one file."""
    try:
        if ext in ("txt", "md"):
            return data.decode("utf-8"), "ok"
        if ext == "docx":
            return docx_text(data), "ok"
        if ext == "pptx":
            return pptx_text(data), "ok"
        if ext == "pdf" and pdf_reader:
            return pdf_reader(data), "ok"
    except Exception as e:  # a broken file is a row with a status
        return None, f"error: {type(e).__name__}"
    return None, "unsupported"


def read_documents(spark: SparkSession, folder: str, pdf_reader=None) -> DataFrame:
    """(path, title, ext, bytes, text, status) of all files under ``folder``; ``pdf_reader`` turns PDF bytes to text, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [parse(e, bytes(c), pdf_reader) if n <= MOST_BYTES else (None, "too large") for e, c, n in zip(batch["ext"], batch["content"], batch["length"])]
            yield pd.DataFrame({"path": batch["path"], "title": batch["path"].str.extract(r"([^/]+)\.[^./]+$")[0], "ext": batch["ext"], "bytes": batch["length"], "text": [d[0] for d in done], "status": [d[1] for d in done]})

    return files.select("path", extension(F.col("path")).alias("ext"), "length", "content").mapInPandas(run, "path string, title string, ext string, bytes long, text string, status string")


def with_category(docs: DataFrame, rules: list[tuple[str, str]], otherwise: str = "general") -> DataFrame:
    """Documents with a category guessed from the path: the first rule (name, pattern) that is found in it."""
    from weftline.functions.rules import first_match

    return docs.withColumn("category", first_match(F.lower("path"), rules, otherwise))


def needs_ocr(text: Column, least: int = 30) -> Column:
    """Whether a text layer is too short to be used."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def pages_replaced(text: Column, replaced: Column) -> Column:
    """A text with pages divided by form feeds, where the map ``replaced`` (place, text) gives some anew; blank ones do not count."""
    pages = F.split(text, "\f")
    new = lambda i: F.try_element_at(replaced, i)
    return F.array_join(F.transform(pages, lambda p, i: F.when(F.coalesce(F.trim(new(i)), F.lit("")) != "", new(i)).otherwise(p)), "\f")


def page_choice(pages: Column, count: Column) -> Column:
    """Asked-for page numbers: distinct, within range, ascending."""
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= count))))


def data_uri(text: Column) -> Column:
    """struct(ext, data) of a base64 image address; null for anything else."""
    kind = F.lower(F.regexp_extract(text, r"^data:image/([a-zA-Z0-9+.-]+);base64,", 1))
    ext = F.when(kind == "jpeg", "jpg").when(kind == "svg+xml", "svg").otherwise(kind)
    return F.when(kind != "", F.struct(ext.alias("ext"), F.unbase64(F.regexp_extract(text, r"(?s)base64,(.*)$", 1)).alias("data")))
