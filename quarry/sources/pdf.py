"""What can be told of a PDF without a library for it: how many pages it has."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Fixed values of the format: a page's type, objects packed in streams, and where streams begin and end.
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_PACKED = re.compile(rb"/Type\s*/ObjStm\b")
_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n")


def _objects(data: bytes) -> Iterator[bytes]:
    """The file without its streams, and the packed objects in them."""
    at = 0
    for found in _STREAM.finditer(data):
        if found.start() < at:
            continue
        yield data[at : found.end()]
        at = data.find(b"endstream", found.end())
        at = len(data) if at < 0 else at
        if _PACKED.search(found[1]):
            try:
                yield zlib.decompressobj().decompress(data[found.end() : at])
            except zlib.error:
                continue
    yield data[at:]


def page_count(data: bytes) -> int | None:
    """The pages of a PDF, also those in packed object streams; None for what is no PDF. Encrypted
    object streams can't be read: their pages are not counted."""
    if b"%PDF-" not in data[:1024]:
        return None
    return sum(len(_PAGE.findall(part)) for part in _objects(data))


def page_counts(files: DataFrame) -> DataFrame:
    """path, page_count of files (path, content)."""

    def run(batches):
        for batch in batches:
            yield batch.assign(page_count=[page_count(bytes(c)) for c in batch["content"]])[["path", "page_count"]]

    return files.select("path", "content").mapInPandas(run, "path string, page_count int")
