"""HWP 5: record streams in a compound file, read as trees of records.

A record's level says how deep it is; the tree that levels make is then read from the top: paragraphs
give their text, table controls their cells, and everything else what is below it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from quarry.sources.compound import CompoundFile
from quarry.sources.grid import Grid

# Fixed values of the published format: record tags, the table control, header bits, control codes
# that take eight units, and what single ones stand for.
PARA_TEXT, CTRL_HEADER, LIST_HEADER, TABLE = 67, 71, 72, 77
TABLE_CONTROL = int.from_bytes(b"tbl ", "big")
COMPRESSED, PASSWORD, DISTRIBUTION = 1, 2, 4
WIDE = "\x01-\x09\x0b\x0c\x0e-\x17"
SINGLE = {"\n": "\n", "\x18": "-", "\x1e": " ", "\x1f": " "}

_CONTROL = re.compile(f"([{WIDE}])[\\s\\S]{{0,7}}|[\x00-\x1f]")


@dataclass
class Record:
    tag: int
    payload: bytes
    below: list[Record] = field(default_factory=list)


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of a stream: heads of 10, 10 and 12 bits; a size of all ones is followed
    by the real one. What is cut short ends it."""
    view = memoryview(data)
    while len(view) >= 4:
        (head,) = struct.unpack_from("<I", view)
        size, begin = head >> 20, 4
        if size == 0xFFF:
            if len(view) < 8:
                return
            (size,), begin = struct.unpack_from("<I", view, 4), 8
        yield head & 0x3FF, head >> 10 & 0x3FF, bytes(view[begin : begin + size])
        view = view[begin + size :]


def tree(data: bytes) -> Record:
    """The records of a stream below a root, each under the last one of a smaller level."""
    root = Record(-1, b"")
    path = [(-1, root)]
    for tag, level, payload in records(data):
        while path[-1][0] >= level:
            path.pop()
        node = Record(tag, payload)
        path[-1][1].below.append(node)
        path.append((level, node))
    return root


def plain(payload: bytes) -> str:
    """The readable characters of UTF-16 units with control codes among them."""
    units = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    # One character for each unit, so that a wide control is eight characters.
    text = _CONTROL.sub(lambda m: "\t" if m[1] == "\t" else SINGLE.get(m[0], ""), "".join(map(chr, units)))
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def is_table(node: Record) -> bool:
    return node.tag == CTRL_HEADER and node.payload[:4] == TABLE_CONTROL.to_bytes(4, "little")


def texts(nodes: list[Record]) -> Iterator[str]:
    """Paragraphs below nodes in order; a table among them is one text, its cells apart by slashes."""
    for node in nodes:
        if node.tag == PARA_TEXT:
            yield plain(node.payload)
            yield from texts(node.below)
        elif is_table(node):
            yield " / ".join(filter(str.strip, (" ".join(texts(cell)) for _, cell in cells(node))))
        else:
            yield from texts(node.below)


def cells(table: Record) -> list[tuple[bytes, list[Record]]]:
    """(list header, records of the cell) for each cell. What a cell holds stands below its header or
    follows it; what comes before the first is a cell without a header."""
    out: list[tuple[bytes, list[Record]]] = []
    for node in table.below:
        if node.tag == LIST_HEADER:
            out.append((node.payload, list(node.below)))
        elif node.tag != TABLE:
            if not out:
                out.append((b"", []))
            out[-1][1].append(node)
    return out


def addresses(heads: list[bytes], rows: int, cols: int) -> list[tuple[int, int]]:
    """(row, column) of each cell. A list header has eight bytes, or six in some files, before the
    address; a file keeps to one, so the size that puts more of a table's cells inside it is taken.
    Cells that have no address there follow each other in rows."""

    def at(size: int) -> list[tuple[int, int] | None]:
        read = [struct.unpack_from("<HH", h, size)[::-1] if len(h) >= size + 4 else None for h in heads]
        return [a if a and (not rows or a[0] < rows) and (not cols or a[1] < cols) else None for a in read]

    best = max((at(8), at(6)), key=lambda found: len({a for a in found if a}))
    return [a or divmod(i, max(cols, 1)) for i, a in enumerate(best)]


def grid(table: Record) -> Grid:
    size = next((n.payload for n in table.below if n.tag == TABLE and len(n.payload) >= 8), b"\0" * 8)
    out = Grid(*struct.unpack_from("<HH", size, 4))
    held = cells(table)
    for place, (_, nodes) in zip(addresses([h for h, _ in held], out.rows, out.cols), held):
        out.put(*place, " ".join(filter(str.strip, texts(nodes))))
    return out


def blocks(nodes: list[Record]) -> Iterator[str]:
    """Paragraphs and tables of a section in order."""
    for node in nodes:
        if node.tag == PARA_TEXT:
            yield plain(node.payload)
            yield from blocks(node.below)
        elif is_table(node):
            yield grid(node).markdown()
        else:
            yield from blocks(node.below)


def inflate(data: bytes) -> bytes:
    """Deflated bytes, with a zlib head or, as the format has it, without."""
    try:
        return zlib.decompress(data, -zlib.MAX_WBITS)
    except zlib.error:
        return zlib.decompress(data)


def sections(data: bytes) -> list[list[str]]:
    """The blocks of each body section; ValueError says why a file can't be read."""
    ole = CompoundFile(data)
    header = ole.read("FileHeader") if ("FileHeader",) in ole.streams else b""
    if not header:
        raise ValueError("no HWP header")
    if len(header) < 40 or not header.startswith(b"HWP Document File"):
        raise ValueError("wrong HWP signature")
    (bits,) = struct.unpack_from("<I", header, 36)
    for bit, why in ((PASSWORD, "the HWP file has a password"), (DISTRIBUTION, "the HWP file is encrypted for distribution")):
        if bits & bit:
            raise ValueError(why)
    numbered = {int(m[1] or 0): path for path in ole.streams if path[0] == "BodyText" and len(path) == 2 and (m := re.fullmatch(r"Section(\d*)", path[1]))}
    if not numbered:
        raise ValueError("no body section in the HWP file")
    raw = [ole.read(*numbered[n]) for n in sorted(numbered)]
    return [list(blocks(tree(inflate(r) if bits & COMPRESSED else r).below)) for r in raw]
