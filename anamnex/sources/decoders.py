"""Text of source documents: plain text, HTML, DOCX, XLSX, clinical XML. Pure functions of bytes, run in pandas UDFs.

Every decoder has a bound on what it reads; beyond it, and on damaged input, the text is null and the error says why.

PDF files need a reader, which is named as `module:attribute` and loaded in the worker: an object with
pages(data), the text layer of each page, and image(data, page, dpi), a page as an image. Without one the error says so.
"""

from __future__ import annotations

import importlib
import io
import json
import re
import xml.parsers.expat
import zipfile
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 32 << 20
SNIFF = 8 << 10

#: Kinds of files and elements.
PLAIN = (".txt", ".md", ".csv", ".tsv", ".json", ".log")
HTML = (".html", ".htm")
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp")
POINTERS = (".gdoc", ".gsheet", ".gslides", ".gdraw", ".gform", ".gsite", ".gtable", ".gjam", ".glink", ".gmap", ".gscript")
POINTER_HOSTS = ("docs.google.com", "drive.google.com")
SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {
    "p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody",
    "section", "article", "header", "footer", "blockquote", "hr", "pre", "dt", "dd", "ul", "ol", "title",
}
CELLS = {"td", "th"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CDA = "{urn:hl7-org:v3}"


#: What the parser raises on damaged documents and on encodings that it doesn't know.
BAD_XML = (ElementTree.ParseError, ValueError, LookupError)


class DecodeError(ValueError):
    """The bytes are too many, damaged or not allowed."""


def single_spaced(text: str) -> str:
    return " ".join(text.split())


def plain_text(data: bytes) -> str:
    if len(data) > MOST_BYTES:
        raise DecodeError(f"{len(data)} bytes, more than {MOST_BYTES}")
    return data.decode("utf-8-sig", errors="replace")


class _Events(HTMLParser):
    """A page as a flat list of (kind, text): words, and marks for where lines, cells and rows begin or end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str]] = []
        self.hidden = 0

    def mark(self, tag: str, side: str) -> None:
        kind = "row" if tag == "tr" else "cell" if tag in CELLS else "line" if tag in BLOCKS else None
        if kind and not self.hidden:
            self.events.append((f"{kind} {side}", ""))

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in SKIPPED
        self.mark(tag, "begins")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        else:
            self.mark(tag, "ends")

    def handle_data(self, data):
        if not self.hidden:
            self.events.append(("words", data))


def lines_of_page(events: list[tuple[str, str]]) -> list[str]:
    """Lines end at blocks; a table row is one line with its cells between tabs, whatever blocks stand inside."""
    lines: list[list[str]] = []  # a line is its cells
    cells: list[str] = []
    text, in_row = "", False
    for kind, words in [*events, ("page ends", "")]:
        ends_row = kind == "row ends" or kind == "page ends" and in_row
        if kind == "words":
            text += words
        elif kind == "cell begins" or kind.startswith("line") and in_row:
            text += " "
        elif kind == "cell ends" and in_row:
            cells.append(single_spaced(text))
            text = ""
        else:  # whatever else ends what has been said so far
            said = single_spaced(text)
            text = ""
            if ends_row:
                lines.append([*cells, said] if said else cells)
            elif said and in_row and kind == "row begins":
                text = said + " "
            elif said:
                lines.append([said])
            if ends_row or kind == "row begins":
                cells, in_row = [], kind == "row begins"
    return ["\t".join(line) for line in lines if any(line)]


def html_text(markup: str) -> str:
    parser = _Events()
    try:
        parser.feed(markup)
        parser.close()
    except AssertionError as error:
        raise DecodeError(f"malformed markup: {error}") from error
    return "\n".join(lines_of_page(parser.events))


def declares_doctype(data: bytes) -> bool:
    """Whether a DOCTYPE comes before the root element; damaged prologs count as having none."""
    found: list[str] = []

    class Stop(Exception):
        pass

    def stop(kind):
        def handler(*_):
            found.append(kind)
            raise Stop

        return handler

    parser = xml.parsers.expat.ParserCreate()
    parser.StartDoctypeDeclHandler, parser.StartElementHandler = stop("doctype"), stop("root")
    try:
        parser.Parse(data, True)
    except (Stop, xml.parsers.expat.ExpatError, ValueError, LookupError):
        pass
    return found[:1] == ["doctype"]


class Members:
    """Members of an archive, with one budget of decompressed bytes for all of them."""

    def __init__(self, data: bytes, budget: int = MOST_BYTES):
        try:
            self.archive, self.left = zipfile.ZipFile(io.BytesIO(data)), budget
        except zipfile.BadZipFile as error:
            raise DecodeError(str(error)) from error

    def names(self) -> list[str]:
        return self.archive.namelist()

    def read(self, name: str) -> bytes:
        try:
            with self.archive.open(name) as f:
                data = f.read(self.left + 1)
        except (KeyError, zipfile.BadZipFile, OSError, EOFError) as error:
            raise DecodeError(f"{name}: {error}") from error
        if len(data) > self.left:
            raise DecodeError(f"{name}: more than {MOST_BYTES} bytes when decompressed")
        self.left -= len(data)
        return data

    def tree(self, name: str) -> ElementTree.Element:
        data = self.read(name)
        if declares_doctype(data):
            raise DecodeError(f"{name}: a DOCTYPE is not allowed")
        try:
            return ElementTree.fromstring(data)
        except BAD_XML as error:
            raise DecodeError(f"{name}: {error}") from error


def texts_in(node: ElementTree.Element, tag: str) -> str:
    return "".join([t.text or "" for t in node.iter(tag)])


def docx_text(data: bytes) -> str:
    """A line per paragraph."""
    return "\n".join(texts_in(p, f"{WORD}t") for p in Members(data).tree("word/document.xml").iter(f"{WORD}p"))


def xlsx_text(data: bytes) -> str:
    """A line per row, cells between tabs, sheets by number."""
    book = Members(data)
    shared = [texts_in(s, f"{SHEET}t") for s in book.tree("xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in book.names() else []
    value_tag, text_tag, count = f"{SHEET}v", f"{SHEET}t", len(shared)

    def cell(node: ElementTree.Element) -> str:
        kind = node.get("t")
        if kind == "inlineStr":
            return texts_in(node, text_tag)
        raw = ""
        for child in node:
            if child.tag == value_tag:
                raw = child.text or ""
                break
        if kind != "s":
            return raw
        raw = raw.strip()
        return shared[int(raw)] if raw.isascii() and raw.isdecimal() and len(raw) < 10 and int(raw) < count else ""

    sheets = [n for n in book.names() if re.fullmatch(r"xl/worksheets/sheet.*\.xml", n)]
    sheets.sort(key=lambda n: [int(d) for d in re.findall(r"\d+", n)] or [0])
    return "\n".join("\t".join([cell(c) for c in row.iter(f"{SHEET}c")]) for n in sheets for row in book.tree(n).iter(f"{SHEET}row"))


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def flat(node: ElementTree.Element) -> str:
    return single_spaced("".join(node.itertext()))


def narrative_lines(node: ElementTree.Element) -> list[str]:
    """Lines of a section's text: rows of tables between tabs, paragraphs, items and captions whole, loose text in place."""
    out: list[str] = []

    def say(text: str | None) -> None:
        if text and text.strip():
            out.append(single_spaced(text))

    todo: list = [("in", node, False)]
    while todo:
        step, item, with_tail = todo.pop()
        if step == "say":
            say(item)
            continue
        kind = local(item.tag)
        if with_tail:
            todo.append(("say", item.tail, False))
        if with_tail and kind == "table":
            for tr in item.iter():
                if local(tr.tag) == "tr":
                    cells = [flat(c) for c in tr if local(c.tag) in CELLS]
                    if any(cells):
                        out.append("\t".join(cells))
        elif with_tail and kind in ("paragraph", "item", "caption"):
            say(flat(item))
        elif not with_tail or kind != "renderMultiMedia":
            say(item.text)
            todo += [("in", child, True) for child in reversed(item)]
    return out


def timestamp_text(value: str | None) -> str | None:
    digits = re.match(r"\d*", (value or "").strip())[0]
    for n, form in ((8, "{}-{}-{}"), (6, "{}-{}"), (4, "{}")):
        if len(digits) >= n:
            return form.format(digits[:4], digits[4:6], digits[6:8])
    return None


def clinical_text(data: bytes) -> str | None:
    """Who a clinical document is about, and its sections; null if the bytes are no such document."""
    if len(data) > MOST_BYTES:
        raise DecodeError(f"{len(data)} bytes, more than {MOST_BYTES}")
    head = data[:SNIFF]
    if b"urn:hl7-org:v3" not in head or b"ClinicalDocument" not in head or declares_doctype(data):
        return None
    try:
        root = ElementTree.fromstring(data)
    except BAD_XML:
        return None
    if root.tag != f"{CDA}ClinicalDocument":
        return None
    lines: list[str] = []
    patient = root.find(f"{CDA}recordTarget/{CDA}patientRole/{CDA}patient")
    if patient is not None:
        for name in patient.findall(f"{CDA}name"):
            if words := single_spaced(" ".join(name.itertext())):
                lines.append(f"Patient: {words}")
        birth = patient.find(f"{CDA}birthTime")
        if birth is not None and (day := timestamp_text(birth.get("value"))):
            lines.append(f"DOB: {day}")
    for section in root.iterfind(f"{CDA}component/{CDA}structuredBody//{CDA}section"):
        title, body = section.find(f"{CDA}title"), section.find(f"{CDA}text")
        block = [flat(title)] if title is not None and flat(title) else []
        block += narrative_lines(body) if body is not None else []
        if block:
            lines += ["", *block] if lines else block
    return "\n".join(lines)


def is_pointer(suffix: str, data: bytes) -> bool:
    """Whether a file is a link to an online document and not the document."""
    if suffix.lower() not in POINTERS or len(data) > 16 << 10:
        return False
    try:
        found = json.loads(data.decode("utf-8-sig"))
        host = (urlsplit(found.get("url")).hostname or "").lower() if isinstance(found, dict) and isinstance(found.get("url"), str) else ""
    except ValueError:
        return False
    return isinstance(found, dict) and (host in POINTER_HOSTS or isinstance(found.get("doc_id"), str) and isinstance(found.get("email"), str))


def route_of(suffix: str, data: bytes) -> str:
    s = suffix.lower()
    if s in PLAIN or s in HTML:
        return "native"
    if s in (".docx", ".xlsx"):
        return "native-prose" if s == ".docx" else "native"
    if s == ".xml":
        return "native"
    return "ocr" if s == ".pdf" or s in IMAGES else "none"


#: Pages of a PDF that are read unless more are asked for, characters of a text layer that make it worth having, resolution of images.
PDF_PAGES, PDF_CHARS, PDF_DPI = 20, 20, 300


@lru_cache(maxsize=8)
def loaded(name: str):
    """What `module:attribute` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def pdf_text(data: bytes, reader: str | None, most: int | None = PDF_PAGES) -> str | None:
    """Pages between form feeds: the text layer of a page, or what is recognised on its image where the layer is too short. most: pages that are read; None for all."""
    if reader is None:
        raise DecodeError("no reader for PDF files is set")
    own, out = loaded(reader), []
    for k, text in enumerate(own.pages(data)[:most]):
        text = (text or "").strip()
        out.append(text if len(text) >= PDF_CHARS else (recognised(".png", own.image(data, k, PDF_DPI)) or "").strip() or text)
    return "\f".join(out) if any(out) else None


def pdf_page_count(data: bytes, reader: str | None) -> int | None:
    """Null if there is no reader or it can't read the file."""
    try:
        return None if reader is None else len(loaded(reader).pages(data))
    except Exception:  # as in decode
        return None


def decode(suffix: str, data: bytes, reader: str | None = None, pages: int | None = PDF_PAGES) -> tuple[str | None, str, str | None]:
    """(text, route, error). Whatever a decoder raises is the error of this document alone."""
    s, route = suffix.lower(), route_of(suffix, data)
    try:
        if is_pointer(s, data):
            return None, "pointer", "a link to an online document; export the document itself"
        if s in PLAIN:
            return plain_text(data), route, None
        if s in HTML:
            return html_text(plain_text(data)), route, None
        if s == ".docx":
            return docx_text(data), route, None
        if s == ".xlsx":
            return xlsx_text(data), route, None
        if s == ".xml":
            text = clinical_text(data)
            return (text if text is not None else plain_text(data)), route, None
        if s == ".pdf":
            return pdf_text(data, reader, pages), route, None
        if route == "ocr":
            return recognised(s, data), route, None
    except DecodeError as error:
        return None, route, str(error)
    except Exception as error:  # a damaged document never ends a job
        return None, route, f"{type(error).__name__}: {error}"
    return None, route, None


@lru_cache(maxsize=8)
def program(name: str) -> str | None:
    """Where a program is installed, looked for once a worker and not for every page."""
    import shutil

    return shutil.which(name)


def recognised(suffix: str, data: bytes) -> str | None:
    """Text by the tesseract program, if it is installed; null otherwise."""
    import subprocess

    if not program("tesseract"):
        return None
    try:
        done = subprocess.run(["tesseract", "stdin", "stdout"], input=data, capture_output=True, timeout=300, check=True)
    except (subprocess.SubprocessError, OSError):
        return None
    return done.stdout.decode("utf-8", errors="replace")


DECODED = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "route", "error")])


def decoder(reader: str | None = None, pages: int | None = PDF_PAGES):
    """A pandas UDF of (suffix, content): struct of text, route and error. pages: of a PDF file that are read; None for all."""

    @F.pandas_udf(DECODED)
    def decoded(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [decode(s or "", bytes(c), reader, pages) if c is not None else (None, "none", None) for s, c in zip(suffix, content)]
        return pd.DataFrame(rows, columns=["text", "route", "error"])

    return decoded


def page_text(markup: str | None) -> tuple[str | None, str | None]:
    """(text, error) of a page."""
    if markup is None:
        return None, None
    try:
        return html_text(markup), None
    except Exception as error:  # as in decode
        return None, str(error) if isinstance(error, DecodeError) else f"{type(error).__name__}: {error}"


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "error")]))
def page_decoded(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_text(m) for m in markup], columns=["text", "error"])


def html_to_text(markup) -> Column:
    """The text of a page; null if it is malformed (page_decoded says why)."""
    return page_decoded(markup)["text"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, length, sha256, content of all files below a path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.select("path", suffix.alias("suffix"), "length", F.sha2("content", 256).alias("sha256"), "content")


def blob_path(sha: str = "sha256", suffix: str = "suffix"):
    return F.concat_ws("/", F.substring(sha, 1, 2), F.concat(sha, suffix))


def with_text(df: DataFrame, reader: str | None = None, pages: int | None = PDF_PAGES) -> DataFrame:
    """Append text, route, error; files over the bound are not sent to Python at all. reader: of PDF files; pages: of each that are read, None for all."""
    small = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    out = df.withColumn("d", decoder(reader, pages)(F.col("suffix"), small)).select("*", "d.*").drop("d")
    too_long = F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {MOST_BYTES}"))
    return out.withColumn("error", F.when(F.col("length") > MOST_BYTES, too_long).otherwise(F.col("error")))
