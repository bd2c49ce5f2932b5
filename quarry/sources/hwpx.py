"""HWPX: a zip of XML sections, read as a stream of XML events.

A section's children are paragraphs, a paragraph's are runs, and a run holds text, tables, controls
and other objects. What an element means follows from its depth, so no tree is built.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree.ElementTree import ParseError, XMLParser

from quarry.sources.grid import Grid

# Fixed values of the format: where sections are, inline marks of a text, and run children without text.
SECTION = re.compile(r"Contents/section\D*(\d*)[^/]*\.xml")
MARKS = {"tab": "\t", "lineBreak": "\n"}
NO_TEXT = ("secPr", "ctrl")
#: Depth of a paragraph, a run and what a run holds; rows and cells are below a table's depth.
PARAGRAPH, RUN, HELD = 2, 3, 4
#: Characters that XML has no form for; some writers put them into texts as they are.
NO_XML = [*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF]


class Section:
    """Receives a section's events and gathers its blocks: pieces of paragraphs, and tables."""

    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.line: list[str] = []  # the text of the paragraph at hand
        self.aside: list[str] = []  # texts inside an object of a run that is no table
        self.grid: Grid | None = None
        self.cell: list[str] = []
        self.address: tuple[int, int] | None = None
        self.ordinal = 0
        self.open: list[str] = []  # names of open elements
        self.text_at = 0  # depth of the open text element
        self.text: list[str] = []

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition("}")[2]
        self.open.append(name)
        depth = len(self.open)
        if self.text_at:
            if depth == self.text_at + 1:
                self.text.append(MARKS.get(name, ""))
        elif name == "t" and not self._in(NO_TEXT):
            self.text_at, self.text = depth, []
        elif depth == HELD and name == "tbl" and self._in_run():
            self._close_line()
            self.grid, self.ordinal = Grid(int(attributes.get("rowCnt") or 0), int(attributes.get("colCnt") or 0)), 0
        elif self.grid is not None and name == "tc" and depth == HELD + 2:
            self.cell, self.address = [], None
        elif self.grid is not None and name == "cellAddr" and depth == HELD + 3:
            self.address = int(attributes.get("rowAddr", 0)), int(attributes.get("colAddr", 0))

    def data(self, text: str) -> None:
        # Only what stands in a text element itself; what marks in it contain is no text.
        if self.text_at and len(self.open) == self.text_at:
            self.text.append(text)

    def end(self, tag: str) -> None:
        depth = len(self.open)
        name = self.open.pop()
        if self.text_at == depth:
            self.text_at = 0
            self._add("".join(self.text), depth)
        elif self.text_at:
            return
        elif self.grid is not None and name == "tc" and depth == HELD + 2:
            row, col = self.address or (0, self.ordinal)
            self.grid.put(row, col, " ".join(filter(str.strip, self.cell)))
            self.ordinal += 1
        elif self.grid is not None and depth == HELD:
            self.blocks.append(self.grid.markdown())
            self.grid = None
        elif depth == HELD and self.aside:
            self.line.append(f" {' '.join(self.aside)} ")
            self.aside = []
        elif depth == PARAGRAPH:
            self._close_line()

    def close(self) -> list[str]:
        return self.blocks

    def _add(self, text: str, depth: int) -> None:
        if not self._in_run():
            return
        if self.grid is not None:
            self.cell.append(text)
        elif depth == HELD:
            self.line.append(text)
        elif text.strip():
            self.aside.append(text)

    def _in(self, names: tuple[str, ...]) -> bool:
        return len(self.open) >= HELD and self.open[HELD - 1] in names

    def _in_run(self) -> bool:
        return self.open[PARAGRAPH - 1 : RUN] == ["p", "run"]

    def _close_line(self) -> None:
        self.blocks.append("".join(self.line))
        self.line = []


def _blocks(section: bytes) -> list[str]:
    parser = XMLParser(target=Section())
    parser.feed(section)
    return parser.close()


def _blocks_with_all(section: bytes) -> list[str]:
    """_blocks of a UTF-8 section with characters that XML has no form for: others, which it doesn't have,
    stand for them while it is read."""
    text = section.decode("utf-8")
    free = next(b for b in range(0xF0000, 0x10FF00, len(NO_XML)) if not re.search(f"[{chr(b)}-{chr(b + len(NO_XML) - 1)}]", text))
    held = {c: free + i for i, c in enumerate(NO_XML)}
    back = {v: k for k, v in held.items()}
    return [b.translate(back) for b in _blocks(text.translate(held).encode("utf-8"))]


def sections(data: bytes) -> list[list[str]]:
    """The blocks of each body section, sections by their numbers; ValueError where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [(m, n) for n in z.namelist() if (m := SECTION.fullmatch(n))]
        if not found:
            raise ValueError("no body section in the HWPX file")
        out = []
        for _, name in sorted(found, key=lambda x: (int(x[0][1] or 0), x[1])):
            section = z.read(name)
            try:
                out.append(_blocks(section))
            except ParseError as e:
                try:
                    out.append(_blocks_with_all(section))
                except ValueError:  # no UTF-8
                    raise e from None
        return out
