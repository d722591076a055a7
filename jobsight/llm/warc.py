"""WARC derivatives: metadata and plain-text conversion records for response records.

``responses`` has a row for each response record: its WARC header fields (map), and its block (an HTTP message, as
text). For each of them ``derive`` makes

* a metadata record (application/warc-fields): title, declared language, link count and the response's HTTP fields;
* a conversion record (text/plain): the visible text.

Both carry WARC-Refers-To (the response's WARC-Record-ID), WARC-Refers-To-Target-URI and -Date, the response's
WARC-Target-URI and WARC-Date, their own WARC-Block-Digest, and as WARC-Source-* every other header field of the
response, digests included. Record ids are name-based (version 5 UUIDs of the response id and the record type), so a
task that runs again makes the same records. Records are made row by row: nothing is shuffled or gathered.

``write_warc`` stores records as gzip WARC files, a file per partition; ``read_warc`` reads such files back.

Edge cases: a null block is an empty one; a block without an empty line is all payload; a missing record id is
derived from the target URI and the block's digest; a response without a Content-Type is taken as HTML; rows that
repeat give equal records; other columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.session import limit_arrow_batches

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: fields that describe a record itself and are not passed on as WARC-Source-*
OWN_FIELDS = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length", "content-type"}
SCHEMA = "record_id string, record_type string, refers_to string, headers map<string,string>, block string"

#: elements whose content is no text, and what ends each of them
_HIDDEN = re.compile(r"<!--|<(script|style|template|noscript|head|title)\b", re.I)
_HIDDEN_END = {"": re.compile("-->")} | {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript")}
_HIDDEN_END |= dict.fromkeys(("head", "title"), re.compile(r"</(?:head|title)\s*>", re.I))
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|nav|footer|header|aside|main|form"
                    r"|blockquote|pre|hr|dl|dt|dd|figure|figcaption|body|html)\b", re.I)
_MARK = re.compile("[\"'<>]")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"<a\b.*?\bhref\s*=", re.S | re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def split_http(block: str) -> tuple[str, list[tuple[str, str]], str]:
    """(status line, fields, payload) of an HTTP message."""
    head, gap, payload = block.partition(CRLF + CRLF)
    if not gap or not head.startswith("HTTP/"):
        return "", [], block
    status, *fields = head.split(CRLF)
    pairs = [f.partition(":")[::2] for f in fields]
    return status, [(k.strip(), v.strip()) for k, v in pairs if k.strip()], payload


def visible(payload: str) -> str:
    """The payload without comments and elements that hold no text. One that is never closed stays.

    Linear: what ends an element is not searched again once it was not found.
    """
    out, at, pos, missing = [], 0, 0, set()
    while m := _HIDDEN.search(payload, pos):
        end = _HIDDEN_END[(m[1] or "").lower()]
        close = None if end in missing else end.search(payload, m.end())
        if close is None:
            missing.add(end)
            pos = m.end()
            continue
        out.append(payload[at:m.start()])
        at = pos = close.end()
    return "".join(out) + payload[at:]


def tags(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the tags: from < before a letter, /, ! or ? to the > that stands in no quotes, with no other < between.

    A quote that never closes is an ordinary character. Linear, as what was passed is not looked at again but for the
    stretch up to the next tag.
    """
    single = set()
    start = text.find("<")
    while 0 <= start < len(text) - 1:
        at = start + 1
        if not (text[at] in "/!?" or "a" <= text[at].lower() <= "z"):
            start = text.find("<", at)
            continue
        while True:
            m = _MARK.search(text, at)
            if m is None:
                return
            if m[0] in "<>":
                break
            close = -1 if m[0] in single else text.find(m[0], m.end())
            if close < 0:
                single.add(m[0])
            at = m.end() if close < 0 else close + 1
        if m[0] == ">":
            yield start, m.end()
            start = text.find("<", m.end())
        else:
            start = m.start()


def plain_text(payload: str) -> str:
    """The visible text: one line per block, character references decoded."""
    source = visible(payload)
    out, at = [], 0
    for a, b in tags(source):
        out.append(source[at:a])
        if _BLOCK.match(source, a, b):
            out.append("\n")
        at = b
    out.append(source[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def head_fields(payload: str) -> tuple[str, str, int]:
    """(title, declared language, number of links) of a page."""
    title = lang = ""
    m = re.search(r"<title\b", payload, re.I)
    begin = payload.find(">", m.end()) + 1 if m else 0
    end = re.compile("</title", re.I).search(payload, begin) if begin else None
    if end:
        title = _one_line(html.unescape(payload[begin:end.start()]))
    links = 0
    for a, b in tags(payload):
        if not lang and payload[a + 1:a + 5].lower() == "html" and (found := _LANG.search(payload, a + 5, b)):
            lang = found[1]
        links += bool(_HREF.match(payload, a, b))
    return title, lang, links


def _one_line(text: str) -> str:
    return " ".join(text.split())


def derivatives(headers: dict[str, str], block: str) -> list[tuple[str, str, str, dict[str, str], str]]:
    """The metadata and the conversion record of one response, in the order of SCHEMA."""
    fields = {k.lower(): v for k, v in headers.items() if v is not None}
    uri, date = fields.get("warc-target-uri", ""), fields.get("warc-date", "")
    source = fields.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri + ' ' + digest(raw(block)))}>"
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html").lower()
    markup = "html" in kind or "xml" in kind
    title, lang, links = head_fields(payload) if markup else ("", "", 0)
    lines = [("title", title), ("language", lang), ("links", str(links)), ("http-status", status)]
    lines += [("http-" + k.lower(), v) for k, v in http]
    metadata = "".join(f"{k}: {v}{CRLF}" for k, v in lines if v)
    text = plain_text(payload) if markup else payload
    out = []
    for record, content, body in (("metadata", "application/warc-fields", metadata),
                                  ("conversion", "text/plain; charset=utf-8", text)):
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source + ' ' + record)}>"
        own = {"WARC-Type": record, "WARC-Record-ID": record_id, "WARC-Refers-To": source, "WARC-Target-URI": uri,
               "WARC-Date": date, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date,
               "WARC-Block-Digest": digest(raw(body)), "Content-Type": content, "Content-Length": str(len(raw(body)))}
        own |= {"WARC-Source-" + k.removeprefix("WARC-"): v for k, v in headers.items()
                if v is not None and k.lower() not in OWN_FIELDS}
        out.append((record_id, record, source, {k: _one_line(v) for k, v in own.items() if v}, body))
    return out


def is_response(headers) -> bool:
    return all((v or "response").strip().lower() == "response" for k, v in headers if k.lower() == "warc-type")


def derive(responses: DataFrame, headers_col: str = "headers", block_col: str = "block") -> DataFrame:
    """Two records (record_id, record_type, refers_to, headers, block) for each response.

    Records whose WARC-Type is given and not ``response`` (requests, metadata, warcinfo, ...) have no derivatives.
    """
    limit_arrow_batches(responses.sparkSession)

    def run(batches):
        kinds = [pa.string()] * 3 + [pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            rows = [r for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if is_response(h or ()) for r in derivatives(dict(h or ()), b or "")]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(x.items()) for x in c] if i == 3 else list(c), k)
                 for i, (c, k) in enumerate(zip(columns, kinds))],
                names=["record_id", "record_type", "refers_to", "headers", "block"])

    return responses.select(F.col(headers_col).alias("h"), F.col(block_col).alias("b")).mapInArrow(run, SCHEMA)


def page_responses(pages: DataFrame, date: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (headers, block) for crawled pages: the HTTP message, its ids and digests."""
    limit_arrow_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            heads, blocks = [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = raw(page or "")
                block = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                         f"Content-Length: {len(payload)}{CRLF}{CRLF}") + (page or "")
                name = uuid.uuid5(uuid.NAMESPACE_URL, (url or "") + " " + digest(payload))
                heads.append([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"),
                              ("WARC-Target-URI", url or ""), ("WARC-Date", date),
                              ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(raw(block))),
                              ("Content-Type", "application/http; msgtype=response"),
                              ("Content-Length", str(len(raw(block))))])
                blocks.append(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.string())],
                names=["headers", "block"])

    return pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("p")).mapInArrow(
        run, "headers map<string,string>, block string")


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip WARC files, one for each partition of ``records`` (headers, block)."""
    head = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), CRLF)
    (records.select(F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF + CRLF), F.col("block")))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path))


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, one member after the other, in pieces of about ``step`` bytes."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(16 + zlib.MAX_WBITS)
        while not member.eof and at < len(data):
            packed = data[at:at + step]
            at += len(packed)
            while packed and not member.eof:
                yield member.decompress(packed, step)
                packed = member.unconsumed_tail
        at -= len(member.unused_data)


def records(pieces: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], str]]:
    """(header fields, block) of each record; Content-Length says where a block ends. One record is held at a time.

    What stands between records and is no record is passed over; a file that ends within a block gives what is there.
    """
    held, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    mark = VERSION.encode()
    while True:
        while (begin := held.find(mark)) < 0:
            del held[:max(0, len(held) - len(mark))]
            if not more():
                return
        del held[:begin]
        seen = 0
        while (gap := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                return
        lines = bytes(held[:gap]).decode("utf-8", "replace").split(CRLF)[1:]
        fields = [(k.strip(), v.strip()) for k, v in (x.partition(":")[::2] for x in lines)]
        size = int(next((v for k, v in fields if k.lower() == "content-length"), "0"))
        while len(held) < gap + 4 + size and more():
            pass
        yield fields, bytes(held[gap + 4:gap + 4 + size]).decode("utf-8", "replace")
        del held[:gap + 4 + size]


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], str]]:
    """The records of an uncompressed WARC file."""
    return list(records([data]))


def read_warc(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """(headers, block) of the records in gzip WARC files.

    A task holds one compressed file (2 GB at most, the limit of the reader) and unpacks it member by member, ``rows``
    records at a time. A field that repeats within a record's header keeps its first value.
    """
    def batch_of(held):
        heads = [list({k: v for k, v in reversed(r[0])}.items()) for r in held]
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())),
                                           pa.array([r[1] for r in held], pa.string())], names=["headers", "block"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in records(inflated(content.as_py())):
                    held.append(record)
                    size += len(record[1])
                    if len(held) >= rows or size >= 1 << 24:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    limit_arrow_batches(spark)
    return files.mapInArrow(run, "headers map<string,string>, block string")
