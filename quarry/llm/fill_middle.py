"""Fill-in-the-middle transformation: texts cut at two unit boundaries and put in another order.

A unit is a run of A-Z and a-z or any other single code point. The bytes of a batch of texts get one
packed bit vector of unit starts and one of code point starts, each with a directory of the ones
before every block. The number of units of a text is the difference of two ranks, the byte where a
unit begins is a select, and lengths in code points are ranks again: no text is split into units.

Nulls and odd rows: a null text is an empty one and stays plain; a null doc_id counts as an empty
string where the text's numbers are drawn; repeated rows are each transformed, with the same result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, string_buffers

#: What marks the start of a prefix, a suffix and a middle. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of a hundred texts, those that stay plain, and of a hundred others those with the suffix in front.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20

FORM_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_WORDS = 8  # 64-bit words of a block
_BLOCK = 64 * _WORDS


class Bits:
    """A packed bit vector with the number of ones before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.zeros((len(flags) // _BLOCK + 1) * _BLOCK // 8, np.uint8)
        bits = np.packbits(flags, bitorder="little")
        packed[: len(bits)] = bits
        self.blocks = packed.view("<u8").reshape(-1, _WORDS)
        self.before = np.zeros(len(self.blocks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, rest = places // _BLOCK, places % _BLOCK
        left = np.clip(rest[:, None] - 64 * np.arange(_WORDS), 0, 64).astype(np.uint64)
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one that has so many before it; there must be one."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        rest = ranks - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.blocks[block]), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(ranks))
        rest -= np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.blocks[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1, dtype=np.int16) <= rest[:, None]).sum(axis=1)
        return block * _BLOCK + word * 64 + inside


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> tuple[Bits, Bits]:
    """Starts of units and starts of code points in the bytes of texts."""
    lead = (raw & 0xC0) != 0x80
    letter = ((raw | 0x20) - np.uint8(97)) < 26
    inside = np.zeros(len(raw), bool)
    np.logical_and(letter[1:], letter[:-1], out=inside[1:])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    inside[first] = False
    unit = lead & ~inside
    unit[first] = True
    return Bits(unit), Bits(lead)


def cuts(raw: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, byte where the middle begins, where it ends, code points of the prefix, of the middle) of
    each text; h1 and h2 modulo units + 1 are the numbers of units before the two cuts."""
    units, points = boundaries(raw, offsets)
    base = units.rank(offsets)
    n = base[1:] - base[:-1]
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        at = offsets[1:].copy()
        within = np.flatnonzero(k < n)
        at[within] = units.select(base[within] + k[within])
        return at

    begin, end = place(np.minimum(a, b)), place(np.maximum(a, b))
    seen = points.rank(begin)
    return n, begin, end, seen - points.rank(offsets[:-1]), points.rank(end) - seen


def _rows(plain_share: int, suffix_first_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = string_buffers(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4"))
            n, begin, end, prefix, middle = cuts(raw, offsets, h1, h2)
            data = raw.tobytes()
            keep = h3 % 100 >= 100 - plain_share
            suffix_first = h4 % 100 < suffix_first_share
            forms, out = [], []
            for i in range(batch.num_rows):
                a, z = int(offsets[i]), int(offsets[i + 1])
                whole = data[a:z]
                if a == z or keep[i] or any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    out.append(whole)
                    continue
                b, e = int(begin[i]), int(end[i])
                parts = (PREFIX, data[a:b], SUFFIX, data[e:z]) if not suffix_first[i] else (SUFFIX, data[e:z], PREFIX, data[a:b])
                forms.append("spm" if suffix_first[i] else "psm")
                out.append(b"".join((*parts, MIDDLE, data[b:e])))
            plain = np.array([f == "plain" for f in forms], bool)
            columns = [
                batch.column("doc_id"),
                pa.array(n),
                pa.array(forms, pa.string()),
                pa.array(prefix, mask=plain),
                pa.array(middle, mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_share: int = PLAIN_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """FORM_SCHEMA, a row for each of docs (doc_id, text): units, form (plain, psm, spm), code points of
    prefix and middle (null where plain) and the transformed text.

    The four numbers of a text are the first four groups of eight hexadecimal digits of the SHA-256 of
    seed:doc_id, so a row's result depends on that row alone. Nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest")).select("doc_id", "text", *numbers)
    return drawn.mapInArrow(_rows(plain_share, suffix_first_share), FORM_SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text that a form and an output came from, exactly: no marker stands in a text that was cut,
    and none can arise where a text meets a marker, as markers begin and end with different characters."""
    parts = F.split(output, "|".join(m.decode() for m in (PREFIX, SUFFIX, MIDDLE)))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every text."""
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
