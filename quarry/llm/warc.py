"""WARC records: reading and writing, and derivatives of responses.

Each response gives a metadata record (its own and its HTTP headers, title, links and digests as
JSON) and a conversion record (its plain text). Both refer to the response by its record id and
repeat its target, date and payload digest. Records are bytes as they stand in a file, one gzip
member each, so a file is the concatenation of rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: How hard gzip tries: records are read back at once more often than they are kept.
LEVEL = 1
#: Namespace of record ids derived from other ids, so that a rerun names records alike.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Date of records that have none.
NO_DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps(parts))}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the length is added."""
    lines = [VERSION] + [f"{k}: {clean(v)}".encode("utf-8", "surrogatepass") for k, v in headers] + [f"Content-Length: {len(block)}".encode()]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


#: Compressed bytes given to a decompressor at a time.
STEP = 1 << 16


def _members(data: bytes, damage: list[str]) -> Iterator[bytes]:
    """What gzip members hold, one after the other; after a damaged one reading goes on at the next start."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, plain, end = zlib.decompressobj(31), [], at
        try:
            while end < len(data) and not member.eof:
                plain.append(member.decompress(view[end : end + STEP]))
                end = min(end + STEP, len(data))
        except zlib.error:
            pass
        if member.eof:
            at = end - len(member.unused_data)
        else:
            damage.append("gzip")
            at = data.find(b"\x1f\x8b\x08", at + 3)
            at = len(data) if at < 0 else at
        yield b"".join(plain)


def _records(data: bytes, damage: list[str]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of plain bytes; one cut short counts as damage."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            damage.append("head")
            return
        headers = parse_headers(data[at:end].split(b"\r\n")[1:])
        declared = get(headers, "Content-Length") or ""
        size = int(declared) if declared.isdecimal() else -1
        block = data[end + 4 : end + 4 + max(size, 0)]
        if size < 0 or len(block) < size:
            damage.append("length")
            at = end + 4
            continue
        yield headers, block
        at = end + 4 + size


def parse(data: bytes, damage: list[str] | None = None) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record in plain or gzip bytes, with one member in memory at a time.

    A record that is cut short or a member that can't be read is left out and named in damage; reading
    goes on after it. Bytes between records are passed over.
    """
    damage = [] if damage is None else damage
    for part in _members(data, damage) if data[:2] == b"\x1f\x8b" else (data,):
        yield from _records(part, damage)


def parse_headers(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names and values in order; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + text.strip())
        elif ":" in text:
            k, _, v = text.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of a response block; without a head all is payload."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return "", [], block
    lines = block[:end].split(b"\r\n")
    return lines[0].decode("latin-1"), parse_headers(lines[1:]), block[end + 4 :]


def _dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; what can't be read on ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else body
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decoded(http: list[tuple[str, str]], body: bytes) -> tuple[bytes, str | None]:
    """(content, what kept it from being decoded): the body without its transfer and content codings.

    Codings are undone from the last one named to the first; one that is not known, or whose bytes are
    damaged, leaves the content as it is there.
    """
    if "chunked" in (get(http, "Transfer-Encoding") or "").lower():
        body = _dechunked(body)
    names = [x.strip().lower() for x in (get(http, "Content-Encoding") or "").split(",") if x.strip()]
    for name in reversed(names):
        if name == "identity":
            continue
        try:
            if name in ("gzip", "x-gzip"):
                body = b"".join(_whole(body))
            elif name == "deflate":
                body = zlib.decompress(body) if body[:1] and body[0] & 15 == 8 else zlib.decompress(body, -15)
            else:
                return body, name
        except zlib.error:
            return body, name
    return body, None


def _whole(body: bytes) -> Iterator[bytes]:
    while body:
        member = zlib.decompressobj(31)
        yield member.decompress(body)
        if not member.eof:
            raise zlib.error("cut short")
        body = member.unused_data


def media_type(http: list[tuple[str, str]], content: bytes) -> str:
    """The declared type without parameters; where none is, HTML unless it has zero bytes."""
    declared = (get(http, "Content-Type") or "").split(";")[0].strip().lower()
    return declared or ("application/octet-stream" if b"\0" in content[:1024] else "text/html")


def is_markup(kind: str) -> bool:
    return kind in ("text/html", "application/xhtml+xml", "text/xml", "application/xml") or kind.endswith("+xml")


# Elements whose content is no text, those that end a line, and those that link.
_DROPPED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template")}
_BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()
)
_LINKED = frozenset(("a", "area", "link"))
_MARKUP = re.compile(r"<(?:!--.*?-->|(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>|[!?][^>]*>)", re.S)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CHARSET = re.compile(rb"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


def decode_payload(payload: bytes, content_type: str | None) -> str:
    named = _CHARSET.search((content_type or "").encode()) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _line(text: str) -> str:
    return " ".join(text.split())


def page_text(source: str) -> tuple[str, str, list[str]]:
    """(title, plain text by lines, links) of HTML, in one pass over its tags."""
    out: list[str] = []
    links: list[str] = []
    title, at = None, 0
    while found := _MARKUP.search(source, at):
        out.append(source[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        opening = not found[1]
        if not name:
            out.append(" ")
        elif name in _DROPPED and opening:
            end = _DROPPED[name].search(source, at)
            at = end.end() if end else len(source)
            out.append(" ")
        elif name == "title" and opening and title is None and (end := _TITLE_END.search(source, at)):
            title = _line(html.unescape(_MARKUP.sub("", source[at : end.start()])))
            at = end.end()
        elif name in _BREAKS:
            out.append("\n")
        if name in _LINKED and opening and (href := _HREF.search(found[0])):
            links.append(html.unescape(href[1].strip("\"'")))
    out.append(source[at:])
    lines = map(_line, html.unescape("".join(out)).split("\n"))
    return title or "", "\n".join(filter(None, lines)), links


def response_record(page_id: object, url: str | None, source: str | None) -> bytes:
    """A page as the response record that a crawl would have written."""
    payload = (source or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    return build(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))),
            ("WARC-Date", NO_DATE),
            ("WARC-Target-URI", url or ""),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def derive(headers: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes | None]:
    """(metadata record, conversion record) of a response record.

    Codings of the body are undone first. HTML and XML become the text of a page, other text types
    stay as they are; what is no text, or can't be decoded, has no conversion record.
    """
    status, http, body = split_http(block)
    source_id = get(headers, "WARC-Record-ID") or record_id("unnamed", digest(block))
    payload_digest = get(headers, "WARC-Payload-Digest") or digest(body)
    content, undecoded = decoded(http, body)
    kind = media_type(http, content)
    title, text, links = "", None, []
    if undecoded is None and is_markup(kind):
        title, text, links = page_text(decode_payload(content, get(http, "Content-Type")))
    elif undecoded is None and (kind.startswith("text/") or kind == "application/json"):
        text = decode_payload(content, get(http, "Content-Type"))
    shared = [
        ("WARC-Date", get(headers, "WARC-Date") or NO_DATE),
        ("WARC-Refers-To", source_id),
        ("WARC-Refers-To-Target-URI", get(headers, "WARC-Target-URI") or ""),
        ("WARC-Refers-To-Date", get(headers, "WARC-Date") or NO_DATE),
        ("WARC-Target-URI", get(headers, "WARC-Target-URI") or ""),
        ("WARC-Source-Payload-Digest", payload_digest),
    ]
    facts = {
        "warc_headers": headers,
        "http_status": status,
        "http_headers": http,
        "media_type": kind,
        "undecoded": undecoded,
        "payload_bytes": len(body),
        "content_bytes": len(content),
        "payload_digest": digest(body),
        "declared_digest": get(headers, "WARC-Payload-Digest"),
        "title": title,
        "links": links,
    }

    def record(kind: str, content: bytes, mime: str) -> bytes:
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source_id)), *shared, ("WARC-Block-Digest", digest(content)), ("Content-Type", mime)]
        return build(own, content)

    meta = record("metadata", json.dumps(facts, ensure_ascii=False).encode("utf-8", "surrogatepass"), "application/json")
    return meta, None if text is None else record("conversion", text.encode("utf-8", "surrogatepass"), "text/plain; charset=utf-8")


def response_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            ids, urls, pages = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([response_record(*x) for x in zip(ids, urls, pages)], pa.binary())], names=["page_id", "record"]
            )


def derivative_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, record -> page_id, response_id, metadata, conversion, damaged: a row for each response
    in record, and where something in it was damaged a last one with the number of damaged places."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            rows = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist()):
                damage: list[str] = []
                for headers, block in parse(data or b"", damage):
                    if (get(headers, "WARC-Type") or "").lower() == "response":
                        rows.append((page, get(headers, "WARC-Record-ID"), *derive(headers, block), 0))
                if damage:
                    rows.append((page, None, None, None, len(damage)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [batch.schema.field("page_id").type, pa.string(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "response_id", "metadata", "conversion", "damaged"])


def report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read derivative records back and say what they hold."""
    names = ["page_id", "response_id", "metadata_id", "conversion_id", "refers_to", "target_uri", "payload_digest", "title", "n_links", "n_chars", "text_sha256"]
    for batch in batches:
        rows = []
        for page, source, meta, conv in zip(*(batch.column(c).to_pylist() for c in ("page_id", "response_id", "metadata", "conversion"))):
            mh, mb = next(parse(meta))
            ch, cb = next(parse(conv)) if conv is not None else ([], None)
            facts = json.loads(mb)
            agree = conv is None or (get(mh, "WARC-Refers-To") == get(ch, "WARC-Refers-To") and digest(cb) == get(ch, "WARC-Block-Digest"))
            if not agree or digest(mb) != get(mh, "WARC-Block-Digest"):
                raise ValueError(f"records of {source} don't agree")
            rows.append(
                (page, source, get(mh, "WARC-Record-ID"), get(ch, "WARC-Record-ID"), get(mh, "WARC-Refers-To"), get(mh, "WARC-Target-URI"))
                + (get(mh, "WARC-Source-Payload-Digest"), facts["title"], len(facts["links"]))
                + ((len(cb.decode("utf-8", "surrogatepass")), hashlib.sha256(cb).hexdigest()) if cb is not None else (None, None))
            )
        kinds = [batch.schema.field("page_id").type] + [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: each row of pages (page_id, url, html) as a response record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(response_rows, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, response_id, metadata, conversion, damaged for each response in records (page_id, record).

    record may hold one record or a whole file, plain or gzip; other kinds of records and bytes
    between records are passed over. What is damaged is left out and counted in a row of its own,
    which has no response; what is no text has no conversion.
    """
    rows = records.select("page_id", "record")
    return rows.mapInArrow(derivative_rows, "page_id long, response_id string, metadata binary, conversion binary, damaged long")


def report(pages: DataFrame) -> DataFrame:
    """Ids, links, digests and text figures of the derivatives of each row of pages.

    A null url is an empty target, null html an empty payload with an empty text; null ids stay
    null; rows that repeat each get their records, with the same names; other columns are not
    read; an empty table gives an empty result. Pages of any length are converted whole. Pages are
    written as responses here, so none is damaged or without text.
    """
    return derivatives(responses(pages)).where("damaged = 0").drop("damaged").mapInArrow(
        report_rows,
        "page_id long, response_id string, metadata_id string, conversion_id string, refers_to string, target_uri string, "
        "payload_digest string, title string, n_links long, n_chars long, text_sha256 string",
    )


def read_files(spark, path: str) -> DataFrame:
    """page_id (null), record: whole WARC files under path, for derivatives."""
    return spark.read.format("binaryFile").load(path).select(F.lit(None).cast("long").alias("page_id"), F.col("content").alias("record"))
