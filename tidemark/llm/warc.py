"""WARC derivative builder: linked metadata and plain-text conversion records from response records.

Records are rows of ``RECORD``: the WARC headers as columns and the block as bytes.  ``responses`` makes response records of
a table of pages, ``derivatives`` two records of each response:

* ``metadata``: ``application/warc-fields`` with title, language, links out and the source's HTTP status line and headers,
  tied to the response by ``WARC-Refers-To`` and ``WARC-Concurrent-To``;
* ``conversion``: the plain text, with ``WARC-Refers-To``, the response's target and date, and ``WARC-Source-Content-Type`` and
  ``WARC-Source-Payload-Digest``, the source's headers that a text alone would lose.

Digests are of the derived block; ``refers_to`` and the source's digests keep the way back.  Record ids are name-based (version 5)
UUIDs, so that a job that is run again makes the same records.  ``serialised`` turns records into WARC/1.1 bytes, ``parsed`` turns
those back into records.  Every step works row by row, without shuffle.

A page is read once, whatever tags in it are open: a tag ends at the next ">", one without is text.

Edge cases: a null html is a response of no bytes and gives an empty text; a null url gives records without target; rows that
are repeated give repeated records; columns of the pages but the three named are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, headers map<string,string>, payload_digest string, block_digest string, content_length long, block binary"
#: The capture date of pages that have none.
DATE = "2024-01-01T00:00:00Z"
_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
_STRING, _MAP = pa.string(), pa.map_(pa.string(), pa.string())
_ARROW = pa.schema(list(zip(_NAMES, [pa.int64(), *[_STRING] * 6, _MAP, _STRING, _STRING, pa.int64(), pa.binary()])))
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of version 5 UUIDs

_UNSEEN = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript")}
_HEAD = re.compile(r"<head\b[^>]*>|</head\s*>", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^>]*>|<![^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_A, _HREF = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[^\S\n]+")


def _closed(page: str) -> tuple[str, str]:
    """A page up to its last ">", and the rest, in which no tag ends.  So every search for a tag's end finds one, and a page with
    any number of open tags is read once."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def _without_unseen(page: str) -> str:
    """The page without comments, scripts, styles and templates; one that does not end takes the rest of the page along."""
    out, at = [], 0
    while found := _UNSEEN.search(page, at):
        out.append(page[at : found.start()])
        if found[1] is None:
            end = page.find("-->", found.end())
            at = end + 3 if end >= 0 else len(page)
        elif (opened := page.find(">", found.end())) < 0:
            return "".join([*out, page[found.start() :]])
        else:
            end = _ENDS[found[1].lower()].search(page, opened + 1)
            at = end.end() if end else len(page)
        out.append(" ")
    return "".join([*out, page[at:]])


def _without_head(page: str) -> str:
    out, at, opened = [], 0, None
    closed, _ = _closed(page)
    for tag in _HEAD.finditer(closed):
        if tag[0][1] != "/":
            opened = tag.start() if opened is None else opened
        elif opened is not None:
            out += [page[at:opened], " "]
            at, opened = tag.end(), None
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The text of a page: without comments, head, scripts and tags, a line for each block, entities decoded."""
    closed, rest = _closed(_without_head(_without_unseen(page)))
    text = _TAG.sub("", _BREAK.sub("\n", closed)) + rest
    lines = (_BLANKS.sub(" ", x).strip() for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str | None:
    begin = _TITLE.search(_closed(page)[0])
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return page[begin.end() : end.start()] if end else None


def language_of(page: str) -> str | None:
    tags = (_LANG.search(x[0]) for x in _HTML.finditer(_closed(page)[0]))
    return next((x[1].lower() for x in tags if x), None)


def links_of(page: str) -> list[str]:
    tags = (_HREF.search(x[0]) for x in _A.finditer(_closed(page)[0]))
    return [next(filter(None, x.groups()), "") for x in tags if x]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def _one_line(x: str) -> str:
    return " ".join(x.split())


def _response(page_id: int | None, url: str | None, page: str | None, date: str) -> tuple:
    payload = (page or "").encode("utf-8", "replace")
    http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http.items()) + "\r\n").encode() + payload
    d = digest(payload)
    return page_id, "response", record_id("response", url, date, d, page_id), None, url, date, "application/http; msgtype=response", {}, d, digest(block), len(block), block


def _derived(record: dict) -> Iterator[tuple]:
    head, _, payload = (record["block"] or b"").partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [tuple(map(str.strip, x.partition(":")[::2])) for x in lines if ":" in x]
    page = payload.decode("utf-8", "replace")
    source, uri, date = record["record_id"], record["target_uri"], record["warc_date"]
    title, lang = title_of(page), language_of(page)
    fields = [("http-status", status)] + [(f"http-header-{k.lower()}", v) for k, v in http]
    fields += [("title", _one_line(entities.unescape(title)))] if title is not None else []
    fields += [("language", lang)] if lang else []
    fields += [("outlink", _one_line(entities.unescape(x))) for x in links_of(page)]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    yield record["page_id"], "metadata", record_id("metadata", source), source, uri, date, "application/warc-fields", {"WARC-Concurrent-To": source or ""}, None, digest(block), len(block), block
    text = plain_text(page).encode("utf-8", "replace")
    kept = {"WARC-Source-Content-Type": dict((k.lower(), v) for k, v in http).get("content-type", ""), "WARC-Source-Payload-Digest": record["payload_digest"] or ""}
    d = digest(text)
    yield record["page_id"], "conversion", record_id("conversion", source), source, uri, date, "text/plain; charset=utf-8", kept, d, d, len(text), text


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    columns[7] = [list(x.items()) for x in columns[7]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ARROW.types)], schema=_ARROW)


def responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """A response record of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield _batch([_response(a, b, c, date) for a, b, c in zip(*(part.column(k).to_pylist() for k in range(3)))])

    return pages.select(F.col(page_id).cast("long").alias("a"), F.col(url).cast("string").alias("b"), F.col(html).cast("string").alias("c")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion record of each response record; records of other types give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                yield _batch([y for x in batch.slice(i, 500).to_pylist() for y in _derived(x)])

    return records.select(*_NAMES).where("warc_type = 'response'").mapInArrow(run, RECORD)


def to_warc(record: dict) -> bytes:
    """A record as WARC/1.1 bytes."""
    named = {
        "WARC-Type": record["warc_type"],
        "WARC-Record-ID": record["record_id"],
        "WARC-Refers-To": record["refers_to"],
        "WARC-Target-URI": record["target_uri"],
        "WARC-Date": record["warc_date"],
        "WARC-Payload-Digest": record["payload_digest"],
        "WARC-Block-Digest": record["block_digest"],
        "Content-Type": record["content_type"],
        "Content-Length": str(len(record["block"] or b"")),
    } | dict(record["headers"] or {})
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in named.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + (record["block"] or b"") + b"\r\n\r\n"


def from_warc(raw: bytes) -> Iterator[dict]:
    """The records of some WARC bytes; ends at the first that is not whole or has no sound length."""
    known = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type"}
    at = 0
    while raw.startswith(b"WARC/", at) and (end := raw.find(b"\r\n\r\n", at)) >= 0:
        record: dict = {x: None for x in _NAMES} | {"headers": {}}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name in known:
                record[known[name]] = value.strip()
            elif name != "Content-Length":
                record["headers"][name] = value.strip()
            else:
                record["content_length"] = int(value) if re.fullmatch(r"\s*[0-9]{1,18}\s*", value, re.A) else -1
        n = record["content_length"] or 0
        if n < 0 or len(raw) < end + 4 + n:
            return
        record["block"], record["content_length"] = raw[end + 4 : end + 4 + n], n
        yield record
        at = end + 4 + n + 4


def serialised(records: DataFrame) -> DataFrame:
    """``record_id`` and ``warc`` (the record's bytes) of each record; joined in any order these are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x["record_id"] for x in rows], _STRING), pa.array([to_warc(x) for x in rows], pa.binary())], names=["record_id", "warc"])

    return records.select(*_NAMES).mapInArrow(run, "record_id string, warc binary")


def parsed(raw: DataFrame, column: str = "warc") -> DataFrame:
    """The records of WARC bytes, of one record or of many (as ``spark.read.format("binaryFile")`` gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                rows = [tuple(r[n] for n in _NAMES) for r in from_warc(x or b"")]
                for i in range(0, len(rows), 500):
                    yield _batch(rows[i : i + 500])

    return raw.select(column).mapInArrow(run, RECORD)
