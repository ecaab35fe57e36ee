"""Text of office files by the standard library: word processing and spreadsheets are zipped XML.

Formats without a parser here (PDF, the old binary formats) go through ``parsers``,
which a caller extends by functions from bytes to (text, pages).
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
Parsed = tuple[str, int]


def docx(data: bytes) -> Parsed:
    """Paragraphs, headings marked by their level, table rows with ' | '; the pages are the paragraphs."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    lines, n = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            n += 1
            text = "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
            style = e.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"Heading(\d)", style.get(f"{W}val", "")) if style is not None else None
            if text:
                lines.append(f"{'#' * int(level[1])} {text}" if level else text)
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                cells = ["".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in row.iter(f"{W}tc")]
                if any(cells):
                    lines.append(" | ".join(cells))
    return "\n".join(lines), n


def xlsx(data: bytes) -> Parsed:
    """Each sheet under its name, its non-empty rows with ' | '; the pages are the sheets."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in i.iter(f"{S}t")) for i in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"))
    lines: list[str] = []
    for sheet in sheets:
        lines.append(f"=== Sheet: {sheet.get('name')} ===")
        target = links.get(sheet.get(f"{R}id"), "").lstrip("/").removeprefix("xl/")
        for row in ET.fromstring(z.read(f"xl/{target}")).iter(f"{S}row"):
            cells = []
            for c in row.iter(f"{S}c"):
                v = c.find(f"{S}v")
                raw = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else v.text if v is not None and v.text else ""
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            if any(x.strip() for x in cells):
                lines.append(" | ".join(cells))
    return "\n".join(lines), len(sheets)


def delimited(data: bytes) -> Parsed:
    import csv

    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    rows = list(csv.reader(io.StringIO(text)))
    return "\n".join(" | ".join(r) for r in rows if any(c.strip() for c in r)), len(rows)


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"docx": docx, "xlsx": xlsx, "csv": delimited}


def parsed_documents(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """(path, file_type, extracted_text, page_count, extraction_ok, content_hash, file_size_kb) of raw files (path, bytes, file_size_kb).

    A file of another type, or one that its parser fails on, has an empty text and isn't ok.
    """
    known = {**PARSERS, **(parsers or {})}

    def parse(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for d, k in zip(data, kind):
            try:
                text, n = known[k](bytes(d))
                out.append((text, n, bool(text.strip())))
            except Exception:
                out.append(("", 0, False))
        return pd.DataFrame(out, columns=["extracted_text", "page_count", "extraction_ok"])

    rows = files.withColumn("file_type", ur.file_type(F.col("path")))
    rows = rows.withColumn("x", F.pandas_udf(parse, "struct<extracted_text:string,page_count:int,extraction_ok:boolean>")("bytes", "file_type"))
    return rows.select("path", "file_type", "x.*", tx.content_hash(F.col("x.extracted_text")).alias("content_hash"), "file_size_kb")
