"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each response yields a `metadata` record (JSON: the source's headers, title, links, counts) and a `conversion` record
(text/plain), made from the payload without its transfer and content codings (chunked, gzip, deflate; others are named in
the metadata). Headers are ordered pairs; in JSON the values of a repeated one are a list. Both records have
WARC-Refers-To naming the response's record id, WARC-Target-URI and WARC-Date, and keep every other header of the response,
digests among them, as WARC-Source-<name>. Pages are read by one forward scanner, in time linear in their length. Record ids are UUIDs made from the content, so a task that runs again gives the same records. Records can be
read from WARC files (plain or gzip, member by member) and serialised to WARC/1.1 bytes.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from io import BufferedReader, BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes, to_python

DATE = "2024-01-01T00:00:00Z"
HIDDEN, TO_THE_END = ("script", "style", "noscript", "template", "svg"), ("script", "style")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
LINKS = {"a": "href", "link": "href", "img": "src"}
#: A comment's start, an element's tag, or another tag; looked for up to a page's last >, so each tag has its end.
_TAG = re.compile(r"<(?:(!--)|(/?)([a-z][^\s/>]*)[^>]*>|[/!?][^>]*>)", re.I | re.A)
_TITLE = re.compile("</title", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in HIDDEN}
_ATTRIBUTE = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: All blanks but single spaces, which stay; then a line break has one space before it at most.
_BLANK, _LINES = re.compile(r"[^\S\n]{2,}|[^\S\n ]"), re.compile(r" ?\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def scanned(page: str) -> tuple[str, str, list[dict]]:
    """(visible text, title, links) of a page, in one walk; searches for ends only move forward too.

    Comments and what script, style, noscript, template and svg hold are hidden, to the page's end where a script or style
    isn't closed; a tag goes from < and a letter, /, ! or ? to the next >; tags of block elements end lines; other < are
    text. Links are the href or src of visible a, link and img tags.
    """
    last, at, begin, out, title, links = page.rfind(">") + 1, 0, 0, [], None, []
    comment, ends = 0, {}
    while begin >= 0:
        tags, begin = _TAG.finditer(page, begin, last), -1
        for m in tags:
            out.append(page[at : m.start()])
            at, name = m.end(), m[3]
            if name is None:
                if m[1]:  # the search goes on after the comment, or after its first > if it has no end
                    if 0 <= comment < at:
                        comment = page.find("-->", at)
                    begin = at = comment + 3 if comment >= 0 else page.find(">", at) + 1
                    out.append(" " if comment >= 0 else "")
                    break
                continue
            name = name.lower()
            if name in BLOCKS:
                out.append("\n")
            if m[2]:
                continue
            if name in _ENDS:
                closers = ends.setdefault(name, [_ENDS[name].finditer(page), (0, 0)])
                while closers[1] and closers[1][0] < at:
                    closers[1] = next((c.span() for c in closers[0]), None)
                if closers[1] or name in TO_THE_END:
                    out.append(" ")
                    begin = at = closers[1][1] if closers[1] else len(page)
                    break
            elif name in LINKS:
                if found := _ATTRIBUTE.search(page, m.start(), at):
                    links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": unescaped(found[1] or found[2] or found[3] or "")})
            elif name == "title" and title is None:
                end = _TITLE.search(page, at)
                title = page[at : end.start()] if end else ""
    out.append(page[at:])
    text = _LINES.sub("\n", _BLANK.sub(" ", unescaped("".join(out)))).strip()
    return text, unescaped(title or "").strip(), links


_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{10,})|[xX]([0-9A-Fa-f]{10,}));?")


def unescaped(text: str) -> str:
    """Character references resolved; a number of any length that is no character becomes U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return f"&#{'x' * (m[1] is None)}{digits};" if len(digits) <= 7 else "\ufffd"

    return html.unescape(_LONG_REFERENCE.sub(short, text))


def plain_text(page: str) -> str:
    return scanned(page)[0]


def links_of(page: str) -> list[dict]:
    return scanned(page)[2]


def response(uri: str, payload: bytes, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> dict:
    """A response record for a stored page: an HTTP head and the payload."""
    known = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + content_type.encode() + b"\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", uri, date, known), "WARC-Date": date, "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": known, "Content-Length": str(len(block)),
    }
    return {"headers": headers, "block": block}


def header_pairs(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines in order; a folded line belongs to the value before it."""
    out = []
    for line in lines:
        if line[:1] in (" ", "\t"):
            if out and line.strip():
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
            continue
        name, _, value = line.partition(":")
        if name.strip():
            out.append((name.strip(), value.strip()))
    return out


def pairs(headers) -> list[tuple[str, str]]:
    """Headers, given as pairs or as a dict, as pairs."""
    return list(headers.items() if isinstance(headers, dict) else headers)


def first(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    """The first value of a header, whose name may be in any case."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def listed(headers: list[tuple[str, str]]) -> dict:
    """Headers by name in the order of their first fields; the values of a repeated one are a list."""
    out = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header pairs, payload) of an HTTP response; without a head the whole block is payload."""
    head = re.match(rb"HTTP/.*?\r?\n\r?\n", block, re.S)
    if not head:
        return "", [], block
    status, *lines = head[0].decode("latin-1").rstrip("\r\n").replace("\r\n", "\n").split("\n")
    return status, header_pairs(lines), block[head.end() :]


_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\n]*)?\r\n")


def unchunked(data: bytes) -> bytes:
    """The data of chunks, of a cut capture as far as it goes; what isn't in chunks (any more) stays as it is."""
    out, at = [], 0
    while at < len(data):
        size = _CHUNK.match(data, at)
        if not size:
            return data
        at, n = size.end(), int(size[1], 16)
        if not n:
            break
        out.append(data[at : at + n])
        at += n
        if data[at : at + 2] not in (b"\r\n", b"\r", b""):
            return data
        at += 2
    return b"".join(out)


def inflated(data: bytes, formats: tuple[int, ...]) -> bytes:
    """data inflated in the first of the formats (zlib's wbits) that fits, of cut or damaged data as far as it goes; what
    isn't compressed (any more) stays as it is."""
    best = b""
    for bits in formats:
        out, rest, fits = [], data, True
        while rest and (bits == 31 or not out):
            member = zlib.decompressobj(bits)
            try:
                out.append(member.decompress(rest) + member.flush())
                rest = member.unused_data
            except zlib.error:
                fits, rest = bool(out), _before_damage(rest, bits)
                out.append(rest)
                break
        if fits and out:
            return b"".join(out)
        best = max(best, b"".join(out), key=len)
    return best or data


def _before_damage(data: bytes, bits: int) -> bytes:
    """What damaged data inflate to before the damage: in pieces, and the piece with the damage byte by byte."""
    member, out = zlib.decompressobj(bits), []
    for k in range(0, len(data), PIECE):
        before = member.copy()
        try:
            out.append(member.decompress(data[k : k + PIECE]))
        except zlib.error:
            for at in range(k, min(k + PIECE, len(data))):
                try:
                    out.append(before.decompress(data[at : at + 1]))
                except zlib.error:
                    break
            break
    return b"".join(out)


def decoded(payload: bytes, http: list[tuple[str, str]]) -> tuple[bytes, list[str]]:
    """(payload without its transfer and content codings, the codings that aren't known and stay)."""
    codings = lambda name: [c.strip().lower() for k, v in http if k.lower() == name for c in v.split(",") if c.strip()]
    steps = [*codings("content-encoding"), *codings("transfer-encoding")]  # in the order in which they were applied
    while steps:
        coding = steps[-1]
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = inflated(payload, (31,))
        elif coding == "deflate":
            payload = inflated(payload, (15, -15))
        elif coding != "identity":
            break
        steps.pop()
    return payload, steps


def derivatives(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response; other records have none."""
    source = pairs(record["headers"])
    if first(source, "WARC-Type") != "response":
        return []
    status, http, payload = split_http(record["block"])
    body, unknown = decoded(payload, http)
    charset = re.search(r"charset=[\"']?([\w-]+)", first(http, "Content-Type"), re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "strict" if unknown else "replace")
    except UnicodeDecodeError:  # still in a coding that can't be undone here, which the metadata names
        page = "" if unknown else body.decode("utf-8", "replace")
    except (LookupError, UnicodeError):  # no charset, or one that can't decode at all
        page = "" if unknown else body.decode("utf-8", "replace")
    text, title, links = scanned(page)
    refers, uri, date = first(source, "WARC-Record-ID"), first(source, "WARC-Target-URI"), first(source, "WARC-Date")
    envelope = {
        "Source-Headers": listed(source), "HTTP-Status": status, "HTTP-Headers": listed(http), "Title": title,
        "Links": links, "Link-Count": len(links), "Payload-Length": len(payload), "Payload-Digest": digest(payload), "Text-Length": len(text), "Actual-Block-Digest": digest(record["block"]),
    }
    if body is not payload:
        envelope["Decoded-Length"] = len(body)
    if unknown:
        envelope["Unknown-Codings"] = unknown
    same = ("warc-record-id", "warc-target-uri", "warc-date")  # both records have these values
    kept = [(f"WARC-Source-{re.sub('^WARC-', '', k, flags=re.I)}", v) for k, v in source if k.lower() not in same]
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        own = digest(block)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, refers, own)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers),
            ("Content-Type", content_type), ("WARC-Block-Digest", own), ("Content-Length", str(len(block))), *kept,
        ]
        out.append({"headers": headers, "block": block})
    return out


def serialised(record: dict, compress: bool = False) -> bytes:
    """A record as WARC/1.1 bytes; compress: as one gzip member. Line breaks in header values are percent-encoded."""
    line = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    data = b"WARC/1.1\r\n" + b"".join(f"{k}: {line(v)}\r\n".encode("utf-8", "replace") for k, v in pairs(record["headers"])) + b"\r\n" + record["block"] + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def _read(stream, size: int) -> bytes:
    """Up to size bytes, whatever size a record claims to have."""
    out = []
    while size > 0 and (piece := stream.read(min(size, LINE))):
        out.append(piece)
        size -= len(piece)
    return b"".join(out)


def parsed(data: bytes):
    """The records of WARC bytes, plain or in gzip members, which are inflated as they are read; bytes that aren't a record
    are skipped up to the next one, and damaged gzip data end the file."""
    stream = BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = BufferedReader(gzip.GzipFile(fileobj=stream))
    with contextlib.suppress(EOFError, zlib.error, gzip.BadGzipFile):
        while line := stream.readline(LINE):
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := stream.readline(LINE).rstrip(b"\r\n")):
                lines.append(line.decode("utf-8", "replace"))
            headers = header_pairs(lines)
            size = first(headers, "Content-Length", "0")
            yield {"headers": headers, "block": _read(stream, int(size) if re.fullmatch("[0-9]{1,18}", size) else 0)}


#: Bytes after which a line without end is taken as one, and of the pieces in which damaged data are inflated.
LINE, PIECE = 1 << 20, 4096
RECORD = "record_type string, record_id string, refers_to string, target_uri string, headers array<struct<name:string,value:string>>, block_digest string, content_length bigint, block binary"


def _columns(records: list[dict]) -> list[pa.Array]:
    h = [pairs(r["headers"]) for r in records]
    get = lambda k: pa.array([first(x, k, None) for x in h], pa.string())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array([v[k] for x in h for v in x], pa.string()) for k in (0, 1)], ["name", "value"])
    return [
        get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), pa.ListArray.from_arrays(pa.array(offsets), fields),
        get("WARC-Block-Digest"), pa.array([len(r["block"]) for r in records], pa.int64()), pa.array([r["block"] for r in records], pa.binary()),
    ]


NAMES = [c.split()[0] for c in RECORD.split(", ")]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, one row each; a file is read by one task, as the format can't be split.

    The task holds the file's bytes (2 GB at most) and one record at a time of what they inflate to.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                records = []
                for record in parsed(data or b""):
                    records.append(record)
                    if len(records) == 500:
                        yield pa.RecordBatch.from_arrays(_columns(records), NAMES)
                        records = []
                yield pa.RecordBatch.from_arrays(_columns(records), NAMES)

    return to_python(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of a table of records (columns headers, block); null blocks count as empty.

    Headers are pairs, in an array of structs or in a map.
    """

    def run(batches):
        for batch in batches:
            out = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += derivatives({"headers": [tuple(h.values()) if isinstance(h, dict) else h for h in headers or []], "block": block or b""})
            yield pa.RecordBatch.from_arrays(_columns(out), NAMES)

    return to_python(records.select("headers", "block")).mapInArrow(run, RECORD)


def derive_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page its metadata and its conversion record, with the page's id; the response is made from url and html.

    Null urls count as empty, null html as an empty payload; each row is a response of its own, and equal rows give equal
    records. Other columns aren't read.
    """
    kind = pages.schema[id_col]

    def run(batches):
        for batch in batches:
            ids, uris, pages_now = batch.column(0), batch.column(1).to_pylist(), text_bytes(batch.column(2))
            for first in range(0, batch.num_rows, 256):
                owners, out = [], []
                for k in range(first, min(first + 256, batch.num_rows)):
                    made = derivatives(response(uris[k] or "", pages_now[k]))
                    out += made
                    owners += [k] * len(made)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owners, pa.int64())), *_columns(out)], [id_col, *NAMES])

    return to_python(pages.select(id_col, url, page)).mapInArrow(run, T.StructType([kind, *T.StructType.fromDDL(RECORD).fields]))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return made.withColumn("headers", F.to_json(F.map_from_entries("headers"))).withColumn("text", F.decode("block", "utf-8")).drop("block")
