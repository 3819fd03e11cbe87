"""WARC derivatives: response records to linked metadata and plain-text conversion records.

A response record holds an HTTP message. From each one come a ``metadata`` record
(``application/warc-fields``: title, language, outlinks, sizes) and a ``conversion``
record (the text of its HTML), both of which name the response in ``WARC-Refers-To``,
keep its target URI, date and the headers it came with, and carry a block digest of
their own and the digest of the response's payload as computed here. Source headers keep
their names, but those that a record has of its own or that describe the source's block
get the prefix ``Source-``, its stated digests among them. HTTP headers are fields of
the metadata record.

Records are rows: named header fields in order, and the block. ``serialise`` writes a
row in the file format and ``parse`` reads such bytes back, so a file is a row's bytes
one after another, gzipped one by one or not.

Record ids are name-based UUIDs of the source id and the record type: a task that runs
again makes the same records.

Cases: a response that isn't HTML by its content type, or whose block is null, empty or
no HTTP message, gives a metadata record only; an empty page gives an empty conversion
record; a null id, URI or date is the empty string; bytes that aren't text in the named
charset become U+FFFD; repeated rows give equal records; an empty table gives none;
extra columns aren't read. Malformed and very long pages are read whole, in time in
proportion to their length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import arrow

HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("block_digest", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("headers", HEADERS), T.StructField("block", T.BinaryType()),
])

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:earshot:warc")
#: Blocks of pages, between which text breaks into lines; and elements that hold no text.
_BREAKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text; of a title it is the title.
_RAW = frozenset("script style template noscript title".split())
_SHUT = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>\"'<]*+)")
#: Tags without another "<" in them, which are nearly all.
_TAG = re.compile(_NAME.pattern + r"((?:\"[^\"<]*+\"|'[^'<]*+'|[^>\"'<]++)*+)>")
_MARK = re.compile(r"[>\"']")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(r"(?<![\w:-])lang\s*=\s*[\"']?([\w-]+)", re.I)
_ORIGIN = re.compile(r"https?://[^/?#]+", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind} {source}')}>"


#: Headers that on a derived record would speak of that record.
_OF_SOURCE = frozenset(
    "warc-type warc-record-id warc-date warc-target-uri warc-refers-to warc-refers-to-target-uri "
    "warc-refers-to-date content-type content-length warc-block-digest warc-payload-digest warc-truncated "
    "warc-identified-payload-type warc-profile warc-filename warc-segment-number warc-segment-origin-id "
    "warc-segment-total-length".split()
)


def carried(source: dict) -> list[tuple[str, str]]:
    """The source's headers as derived records have them, without what they say anyway."""
    said = {"warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri"}
    return [
        (f"Source-{name}" if low in _OF_SOURCE else name, value)
        for name, value in ((h["name"], h["value"] or "") for h in source["headers"])
        if (low := name.lower()) not in said or value != source[said[low]]
    ]


class Page(NamedTuple):
    title: str
    lang: str
    links: list[str]
    text: str


class Tag(NamedTuple):
    start: int
    stop: int
    name: str
    closes: bool
    #: Its attributes, or what is inside an element of ``_RAW``.
    rest: str


class _Ends:
    """Ends of tags. What a search has read in vain no other search reads again."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.read = (0, -1)
        self.dead: set[int] = set()

    def _mark(self, at: int) -> int:
        found = _MARK.search(self.html, at)
        return found.start() if found else -1

    def find(self, at: int) -> int:
        """The first ``>`` from a place on that isn't in quotes, or -1."""
        if at > self.last:
            return -1
        if not self.read[0] <= at <= self.read[1]:
            self.read = (at, self._mark(at))
        mark, opened = self.read[1], []
        while mark >= 0 and self.html[mark] != ">":
            opened.append(mark)
            shut = -1 if mark in self.dead else self.html.find(self.html[mark], mark + 1)
            mark = self._mark(shut + 1) if shut >= 0 else -1
        if mark < 0:
            self.dead.update(opened)
        return mark


def tags(html: str) -> Iterator[Tag]:
    """Tags, whole elements of ``_RAW``, and comments and declarations (without a name).

    A ``<`` that begins none of them, or a tag without an end, is text. A comment or an
    element of ``_RAW`` without an end goes on to the end of the page. The time is in
    proportion to the page, whatever is in it.
    """
    ends = _Ends(html)
    at = html.find("<")
    while at >= 0:
        tag = _tag_at(html, at, ends)
        if tag:
            yield tag
        at = html.find("<", tag.stop if tag else at + 1)


def _tag_at(html: str, at: int, ends: _Ends) -> Tag | None:
    whole = _TAG.match(html, at)
    named = whole or _NAME.match(html, at)
    if named:
        name, closes = named[2].lower(), named[1] == "/"
        if name in _RAW and not closes:
            inside = html.find(">", named.end(2)) + 1 if named.end(2) <= ends.last else 0
            shut = _SHUT[name].search(html, inside) if inside else None
            rest = html[inside:shut.start() if shut else len(html)]
            return Tag(at, shut.end() if shut else len(html), name, closes, rest) if inside else None
        if whole:
            return Tag(at, whole.end(), name, closes, whole[3])
        end = ends.find(named.end())
        return Tag(at, end + 1, name, closes, html[named.end():end]) if end >= 0 else None
    if html.startswith("<!--", at):
        end = html.find("-->", at + 4)
        return Tag(at, end + 3 if end >= 0 else len(html), "", False, "")
    if html.startswith(("<!", "<?"), at) and at < ends.last:
        return Tag(at, html.find(">", at) + 1, "", False, "")
    return None


def read_page(html: str, base: str) -> Page:
    """Title, language, links and visible text of a page, in one pass over its tags."""
    html = html.replace("\0", "")
    origin = _ORIGIN.match(base)
    title, lang, links, parts = "", "", [], []
    done = 0
    for tag in tags(html):
        if done < tag.start:
            parts.append(_plain(html[done:tag.start]))
        done = tag.stop
        if tag.name == "title" and not tag.closes:
            title = title or _plain(tag.rest)
        elif tag.name == "a" and not tag.closes:
            link = _HREF.search(tag.rest)
            if link:
                links.append(_resolve(origin, base, _plain(link[1] or link[2] or link[3] or "").strip()))
        elif tag.name == "html" and not tag.closes:
            found = _LANG.search(tag.rest)
            lang = found[1] if found else ""
        if tag.name in _BREAKS:
            parts.append("\0")
    parts.append(_plain(html[done:]))
    lines = (" ".join(line.split()) for line in "".join(parts).split("\0"))
    return Page(" ".join(title.split()), lang, links, "\n".join(line for line in lines if line))


def _resolve(origin: re.Match | None, base: str, link: str) -> str:
    if origin and link[:1] == "/" and link[:2] != "//" and "/." not in link:
        return origin[0] + link
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def _plain(text: str) -> str:
    return unescape(text).replace("\0", "") if "&" in text else text


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    fields: list[tuple[str, list[str]]] = []
    for line in rest:
        if line[:1] in " \t" and fields:
            fields[-1][1].append(line.strip())
        else:
            name, _, value = line.partition(":")
            fields.append((name.strip(), [value.strip()]))
    return first, [(name, " ".join(parts)) for name, parts in fields], body


def _record(kind: str, source: dict, media: str, block: bytes, payload: str | None, copied: list[tuple[str, str]]) -> dict:
    own = record_id(source["record_id"], kind)
    # The same number of fields for each, in this order; then those of the source.
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source["date"]),
        ("WARC-Refers-To", source["record_id"]), ("WARC-Target-URI", source["target_uri"]),
        ("Content-Type", media), ("WARC-Block-Digest", digest(block)),
        *([("WARC-Payload-Digest", payload)] if payload else []), *copied,
        ("Content-Length", str(len(block))),
    ]
    return {
        "record_id": own, "warc_type": kind, "refers_to": source["record_id"],
        "target_uri": source["target_uri"], "date": source["date"], "content_type": media,
        "block_digest": digest(block), "payload_digest": payload,
        "headers": [{"name": n, "value": v} for n, v in fields], "block": block,
    }


def derive(source: dict) -> list[dict]:
    """The records made from one response (record_id, target_uri, date, headers, block)."""
    status, http, body = split_http(source["block"])
    types = [v for n, v in http if n.lower() == "content-type"]
    media = types[0] if types else ""
    charset = _CHARSET.search(media)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    is_html = media.split(";")[0].strip().lower() in ("text/html", "application/xhtml+xml")
    page = read_page(text, source["target_uri"]) if is_html else Page("", "", [], "")
    facts = [
        ("http-status", status), ("http-content-type", media), ("payload-length", str(len(body))),
        *[("http-header", f"{n}: {v}") for n, v in http],
        ("title", page.title), ("language", page.lang),
        *[("outlink", f"{' '.join(x.split())} L a/@href") for x in page.links],
    ]
    block = "".join(f"{n}: {v}\r\n" for n, v in facts if v).encode("utf-8", "replace")
    kept = carried(source)
    payload = digest(body)
    out = [_record("metadata", source, "application/warc-fields", block, payload, kept)]
    if is_html:
        out.append(_record("conversion", source, "text/plain; charset=utf-8", page.text.encode("utf-8", "replace"), payload, kept))
    return out


def serialise(headers: list[tuple[str, str]], block: bytes, compress: bool = False) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers) + "\r\n"
    whole = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, mtime=0) if compress else whole


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record in the bytes of a file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])]
        length = int(next(v for n, v in fields if n.lower() == "content-length"))
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of pages, as a crawl would hold them.

    The date is the epoch, since the table has none.
    """
    body = F.coalesce(pages[html].cast("binary"), F.lit(b""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    name = F.sha1(F.concat(F.lit("response "), F.coalesce(pages[key].cast("string"), F.lit(""))).cast("binary"))
    part = lambda a, n: F.substring(name, a, n)
    named = F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3),
        F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"),
    )
    warc_info = F.struct(F.lit("WARC-Warcinfo-ID").alias("name"), F.lit(record_id("pages", "warcinfo")).alias("value"))
    return pages.select(
        pages[key].alias(key), named.alias("record_id"), F.coalesce(pages[url], F.lit("")).alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.array(warc_info).alias("headers"),
        F.concat(http, body).alias("block"),
    )


def derivatives(records: DataFrame, key: str) -> DataFrame:
    """Metadata and conversion records of response records, with the source's ``key``."""
    fields = [f for f in records.schema.fields if f.name == key]
    schema = T.StructType(fields + RECORD.fields)
    columns = records.select(key, "record_id", "target_uri", "date", "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                rows = batch.to_pylist()
                made = [
                    {key: row[key], **record}
                    for row in rows
                    for record in derive({
                        "record_id": row["record_id"] or "", "target_uri": row["target_uri"] or "",
                        "date": row["date"] or "", "headers": row["headers"] or [], "block": row["block"] or b"",
                    })
                ]
                if made:
                    yield pa.RecordBatch.from_pylist(made, arrow_schema(batch.schema.field(key)))

    return columns.mapInArrow(run, schema)


def arrow_schema(key: pa.Field) -> pa.Schema:
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"headers": pair, "block": pa.binary()}
    return pa.schema([key] + [(f.name, kinds.get(f.name, pa.string())) for f in RECORD.fields])
