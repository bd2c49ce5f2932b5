"""DOCX, PPTX and XLSX: zips of XML parts, read with the standard library.

A page has its texts first, then its tables as Markdown. A DOCX is one page, as its pages are made
when it is laid out; a PPTX has a page for each slide, an XLSX one for each sheet.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from quarry.sources.grid import Grid

# Fixed values of the formats: name spaces, and what inline elements of a text stand for.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
INLINE = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-", A + "br": "\n", A + "tab": "\t"}
CELL = re.compile(r"([A-Z]+)(\d+)")

Page = tuple[list[str], list[Grid]]


class Package:
    """The parts of a package and the relations between them."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))

    def xml(self, part: str) -> ET.Element:
        return ET.fromstring(self.zip.read(part))

    def related(self, part: str) -> dict[str, str]:
        """Relation id -> part."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.zip.namelist():
            return {}
        inside = (r for r in self.xml(rels) if r.get("TargetMode") != "External")
        return {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/") for r in inside}


def _text(node: ET.Element, letters: str, skip: tuple[str, ...] = ()) -> str:
    """Texts and inline marks below node in order."""
    if node.tag == letters:
        return node.text or ""
    if node.tag in INLINE:
        return INLINE[node.tag]
    return "".join(_text(child, letters, skip) for child in node if child.tag not in skip)


def _table(rows: list[list[tuple[int, str]]]) -> Grid:
    """A grid from rows of (columns that a cell spans, text)."""
    out = Grid()
    for r, row in enumerate(rows):
        c = 0
        for span, text in row:
            out.put(r, c, text)
            c += span
            out.cols = max(out.cols, c)
    return out


def docx(data: bytes) -> list[Page]:
    """One page; tables in tables become text of their cell."""
    body = Package(data).xml("word/document.xml").find(W + "body")
    texts: list[str] = []
    tables: list[Grid] = []

    def flow(node: ET.Element) -> Iterator[ET.Element]:
        for child in node:
            if child.tag in (W + "p", W + "tbl"):
                yield child
            elif child.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "customXml"):
                yield from flow(child)

    def spanned(cell: ET.Element) -> int:
        span = cell.find(f"{W}tcPr/{W}gridSpan")
        return int(span.get(W + "val", 1)) if span is not None else 1

    for block in flow(body if body is not None else ET.Element("body")):
        if block.tag == W + "p":
            texts.append(_text(block, W + "t", (W + "del", W + "pPr")))
        else:
            paragraphs = lambda cell: " ".join(_text(p, W + "t", (W + "del", W + "pPr")) for p in cell.iter(W + "p"))
            tables.append(_table([[(spanned(c), paragraphs(c)) for c in row.findall(W + "tc")] for row in block.findall(W + "tr")]))
    return [(texts, tables)]


def pptx(data: bytes) -> list[Page]:
    """A page for each slide, in the order of the presentation."""
    package = Package(data)
    parts = package.related("ppt/presentation.xml")
    listed = package.xml("ppt/presentation.xml").find(P + "sldIdLst")
    pages = []
    for slide in listed if listed is not None else ():
        root = package.xml(parts[slide.get(R + "id")])
        grids = list(root.iter(A + "tbl"))
        inside = {p for g in grids for p in g.iter(A + "p")}
        texts = [_text(p, A + "t") for p in root.iter(A + "p") if p not in inside]
        tables = [
            _table([[(1, " ".join(_text(p, A + "t") for p in cell.iter(A + "p"))) for cell in row.findall(A + "tc")] for row in g.findall(A + "tr")])
            for g in grids
        ]
        pages.append((texts, tables))
    return pages


def _column(letters: str) -> int:
    n = 0
    for letter in letters:
        n = n * 26 + ord(letter) - 64
    return n - 1


def xlsx(data: bytes) -> list[Page]:
    """A page for each sheet: its used cells as one table. Shown are stored values, formulas' results."""
    package = Package(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in package.zip.namelist():
        shared = [_text(item, S + "t", (S + "rPh",)) for item in package.xml("xl/sharedStrings.xml").findall(S + "si")]
    parts = package.related("xl/workbook.xml")
    sheets = package.xml("xl/workbook.xml").find(S + "sheets")
    pages = []
    for sheet in sheets if sheets is not None else ():
        values: dict[tuple[int, int], str] = {}
        for r, row in enumerate(package.xml(parts[sheet.get(R + "id")]).iter(S + "row")):
            for c, cell in enumerate(row.findall(S + "c")):
                named = CELL.fullmatch(cell.get("r", ""))
                place = (int(named[2]) - 1, _column(named[1])) if named else (r, c)
                value, kind = cell.findtext(S + "v") or "", cell.get("t", "n")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = _text(cell, S + "t")
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if value.strip():
                    values[place] = value
        grid = Grid()
        # Rows and columns without a value are left out, so a far cell makes no large table.
        rows = {r: i for i, r in enumerate(sorted({r for r, _ in values}))}
        cols = {c: i for i, c in enumerate(sorted({c for _, c in values}))}
        for (r, c), value in values.items():
            grid.put(rows[r], cols[c], value)
        pages.append(([], [grid]))
    return pages
