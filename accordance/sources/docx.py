"""Text of Word files: paragraphs and tables in the order of the body, then text boxes; or, fast, all text in one line.

Only what stands in the body itself is read in order: a paragraph's own runs and links, a table's own rows and cells. Nested
tables and content controls are left out of the precise reading; the fast one has all text.

Unpacking is the only part in Python; it yields lines, which column expressions normalise and join.
Old binary files need a converter, which is no part of this library; they come out as errors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.functions.text import normalize_report
from accordance.operators.cleaning import dedup_text
from accordance.sources.files import wrapped

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P, _R, _TBL, _TR, _TC, _LINK = (f"{_W}{name}" for name in ("p", "r", "tbl", "tr", "tc", "hyperlink"))
#: Elements that hold a text box, in three dialects, and the mark before their text.
_BOXES = (
    "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}txbx",
    "{http://schemas.microsoft.com/office/word/2010/wordprocessingCanvas}txbx",
    "{urn:schemas-microsoft-com:vml}textbox",
)
BOX_MARK = "[TEKSTBOKSE]"
#: What else than w:t is text in a run.
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
EMPTY_CELL = "—"


def _run(run) -> str:
    return "".join((e.text or "") if e.tag == f"{_W}t" else _MARKS.get(e.tag, "") for e in run)


def _text(paragraph) -> str:
    """Of the paragraph's own runs and of those in its links."""
    runs = (r for e in paragraph for r in (e.findall(_R) if e.tag == _LINK else [e] if e.tag == _R else []))
    return "".join(map(_run, runs))


def _continues(cell) -> bool:
    """If a cell goes on with another: a merge with a value other than restart, or a vertical one without a value."""
    for kind, missing in (("hMerge", "restart"), ("vMerge", "continue")):
        merge = cell.find(f"{_W}tcPr/{_W}{kind}")
        if merge is not None and merge.get(f"{_W}val", missing) != "restart":
            return True
    return False


def _row(cells: list[str]) -> str | None:
    """Cells with bars between them, without the empty ones at both ends."""
    filled = [k for k, c in enumerate(cells) if c]
    return " | ".join(c or EMPTY_CELL for c in cells[filled[0] : filled[-1] + 1]) if filled else None


def lines(content: bytes) -> list[str]:
    """The lines of a file: raises what a broken one makes zipfile or the parser raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
    out = []
    for part in body:
        if part.tag == _P:
            out.append(_text(part))
        elif part.tag == _TBL:
            for row in part.findall(_TR):
                cells = [" ".join("\n".join(map(_text, cell.findall(_P))).split()) for cell in row.findall(_TC) if not _continues(cell)]
                out += filter(None, [_row(cells)])
    boxes = []
    for tag in _BOXES:
        for box in body.iter(tag):
            boxes += ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in box.iter(_P)]
    boxes = [t for t in boxes if t.strip()]
    return [*out, BOX_MARK, *boxes] if boxes else out


def all_text(content: bytes) -> str:
    """All text of headers, body and footers, as the fast reading has it: tabs, line ends, and two of these before each paragraph."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        names = file.namelist()
        parts = [n for n in names if re.fullmatch(r"word/header[0-9]*\.xml", n)], ["word/document.xml"], [n for n in names if re.fullmatch(r"word/footer[0-9]*\.xml", n)]
        for name in (n for part in parts for n in part):
            for e in ElementTree.fromstring(file.read(name)).iter():
                out.append((e.text or "") if e.tag == f"{_W}t" else "\n\n" if e.tag == _P else _MARKS.get(e.tag, "") if e.tag != f"{_W}noBreakHyphen" else "")
    return "".join(out)


def _reader(fast: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for content in rows["content"]:
                try:
                    found.append((all_text(content) if fast else "\n".join(lines(content)), None))
                except Exception as e:  # a broken file is a row with its error
                    found.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame({"file_name": rows["file_name"], "body": [f[0] for f in found], "error": [f[1] for f in found]})

    return read


def read_docx(files: DataFrame, fast: bool = False) -> DataFrame:
    """file_name, text (wrapped as a report, equal lines once) and error of each file (file_name, content).

    ``fast``: all text as one line; the line ends are removed, so words at their sides fuse.
    """
    raw = files.select("file_name", "content").mapInPandas(_reader(fast), "file_name string, body string, error string")
    return reports(raw, fast)


def reports(raw: DataFrame, fast: bool = False) -> DataFrame:
    """file_name, text and error from file_name, body (as read) and error."""
    body = dedup_text(raw.withColumn("body", normalize_report(F.col("body"), keep_newlines=not fast)), "body")
    return body.select("file_name", F.when(F.col("error").isNull(), wrapped(F.col("file_name"), F.col("body"))).alias("text"), "error")
