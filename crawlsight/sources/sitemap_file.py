"""Sitemap files: gzip, XML urlsets and indexes, plain lists of URLs.

Parsing XML with its errors and exact blanks is beyond Spark's own readers; a body is parsed once, by expat, in Arrow
batches of a few rows, and everything after that is columns.
"""

from __future__ import annotations

import re
import zlib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.functions.text import BLANKS
from crawlsight.sources.workers import map_arrow

# Limits of the protocol. Fixed values.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_ENTRIES = 50_000
MAX_BYTES = 52_428_800
MAX_LOC = 2_048
MAX_IMAGES = 1_000
MAX_NEWS = 1_000

SNIFFED = 2_048
LONGEST_LINE = 1 << 20
BATCH = 16

ENTRY = (
    "raw_loc string, loc string, has_loc boolean, lastmod string, changefreq string, priority string, line int, "
    "images array<struct<loc: string>>, videos array<map<string, string>>, "
    "news array<struct<name: string, language: string, publication_date: string, title: string>>, "
    "alternates array<struct<rel: string, hreflang: string, href: string>>"
)
INDEX_ENTRY = "raw_loc string, loc string, has_loc boolean, lastmod string, line int"
_NESTED = lambda schema: re.sub(r"(\w+) (?=[a-z])", r"\1: ", schema)
DOCUMENT = (
    "kind string, root string, namespace string, gzip boolean, gzip_error string, uncompressed bigint, truncated boolean, "
    "encoding string, invalid_utf8 boolean, xml_error string, looks_like_html boolean, news_count int, "
    f"entries array<struct<{_NESTED(ENTRY)}>>, sitemaps array<struct<{_NESTED(INDEX_ENTRY)}>>"
)

_S, _B, _I = pa.string(), pa.bool_(), pa.int32()
_strings = lambda *names: pa.struct([(n, _S) for n in names])
_ENTRY = pa.struct([
    ("raw_loc", _S), ("loc", _S), ("has_loc", _B), ("lastmod", _S), ("changefreq", _S), ("priority", _S), ("line", _I),
    ("images", pa.list_(_strings("loc"))), ("videos", pa.list_(pa.map_(_S, _S))),
    ("news", pa.list_(_strings("name", "language", "publication_date", "title"))),
    ("alternates", pa.list_(_strings("rel", "hreflang", "href"))),
])
_INDEX = pa.struct([("raw_loc", _S), ("loc", _S), ("has_loc", _B), ("lastmod", _S), ("line", _I)])
_DOCUMENT = pa.struct([
    ("kind", _S), ("root", _S), ("namespace", _S), ("gzip", _B), ("gzip_error", _S), ("uncompressed", pa.int64()), ("truncated", _B),
    ("encoding", _S), ("invalid_utf8", _B), ("xml_error", _S), ("looks_like_html", _B), ("news_count", _I),
    ("entries", pa.list_(_ENTRY)), ("sitemaps", pa.list_(_INDEX)),
])


def gunzip(raw: bytes, limit: int) -> tuple[bytes, bool, str]:
    """At most limit bytes of all members, whether there are more, and what is wrong with the stream."""
    out, left, error = bytearray(), raw, ""
    try:
        while left and len(out) <= limit:
            stream = zlib.decompressobj(31)
            out += stream.decompress(left, limit + 1 - len(out))
            if not stream.eof:
                if len(out) <= limit:
                    error = "unexpected EOF"
                break
            left = stream.unused_data
    except zlib.error as e:
        error = f"gzip: {str(e).rpartition(': ')[2]}"
    return bytes(out[:limit]), len(out) > limit, error


def new_entry(line: int) -> dict:
    return {"raw_loc": "", "loc": "", "has_loc": False, "lastmod": "", "changefreq": "", "priority": "", "line": line, "images": [], "videos": [], "news": [], "alternates": []}


class Reader:
    """Fills a document from expat's events. Names count by their local part, at fixed depths."""

    def __init__(self, doc: dict):
        self.doc, self.path, self.spaces = doc, [], [{}]
        self.text, self.entry, self.index, self.video, self.news = [], None, None, None, None

    def start(self, name: str, attributes: dict) -> None:
        self.text.clear()
        own = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        self.spaces.append(self.spaces[-1] | own if own else self.spaces[-1])
        prefix, _, local = name.rpartition(":")
        depth = len(self.path)
        self.path.append(local)
        if depth == 0:
            space = self.spaces[-1].get(prefix, prefix)
            self.doc |= {"root": local, "namespace": space, "kind": {"urlset": "urlset", "sitemapindex": "index"}.get(local, "not-sitemap")}
        elif depth == 1 and local == "url" and self.doc["kind"] == "urlset":
            self.entry = new_entry(self.line())
        elif depth == 1 and local == "sitemap" and self.doc["kind"] == "index":
            self.index = {"raw_loc": "", "loc": "", "has_loc": False, "lastmod": "", "line": self.line()}
        elif depth == 2 and self.entry is not None:
            self.child(local, attributes)

    def child(self, local: str, attributes: dict) -> None:
        if local == "image":
            self.entry["images"].append({"loc": ""})
        elif local == "video":
            self.video = {}
        elif local == "news":
            self.news = {"name": "", "language": "", "publication_date": "", "title": ""}
        elif local == "link":
            given = {k.rpartition(":")[2]: v for k, v in attributes.items()}
            self.entry["alternates"].append({k: given.get(k, "") for k in ("rel", "hreflang", "href")})

    def end(self, name: str) -> None:
        self.spaces.pop()
        local, depth = self.path.pop(), len(self.path)
        raw = "".join(self.text)
        self.text.clear()
        value = raw.strip(BLANKS)
        if depth == 1:
            for kind, open_, to in (("url", "entry", "entries"), ("sitemap", "index", "sitemaps")):
                if local == kind and getattr(self, open_) is not None:
                    self.doc[to].append(getattr(self, open_))
                    setattr(self, open_, None)
        elif depth == 2 and (at := self.entry if self.entry is not None else self.index) is not None:
            self.end_child(at, local, raw, value)
        elif depth >= 3 and self.entry is not None:
            self.end_extension(self.path[-1], local, value)

    def end_child(self, at: dict, local: str, raw: str, value: str) -> None:
        if local == "loc":
            at |= {"raw_loc": raw, "loc": value, "has_loc": True}
        elif local in ("lastmod", "changefreq", "priority") and local in at:
            at[local] = value
        elif local == "video" and self.video is not None and at is self.entry:
            at["videos"].append(self.video)
            self.video = None
        elif local == "news" and self.news is not None and at is self.entry:
            at["news"].append(self.news)
            self.doc["news_count"] += 1
            self.news = None

    def end_extension(self, parent: str, local: str, value: str) -> None:
        if parent == "image" and local == "loc" and self.entry["images"]:
            self.entry["images"][-1]["loc"] = value
        elif parent == "video" and self.video is not None:
            self.video[local] = value
        elif self.news is not None and (parent, local) in {("publication", "name"), ("publication", "language"), ("news", "publication_date"), ("news", "title")}:
            self.news[local] = value


_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*(?:"([^"]*)"|'([^']*)')""")
#: A reference that isn't one: an & that no name and ; follow.
_HINT = " (an unescaped & must be written as &amp;)"


def read_xml(doc: dict, data: bytes) -> None:
    """Entries before an error are kept; bytes are taken for UTF-8, whatever is declared."""
    if m := _DECLARED.match(data[:512]):
        doc["encoding"] = (m[1] or m[2] or b"").decode("utf-8", "replace")
    reader, again = Reader(doc), True
    while again:  # a further root element after the first is read too, and replaces it
        again = False
        parser = expat.ParserCreate("UTF-8")
        parser.buffer_text, parser.ordered_attributes = True, False
        reader.line = lambda p=parser: p.CurrentLineNumber
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text.append
        try:
            parser.Parse(data, True)
        except expat.ExpatError as e:
            junk = e.code == expat.errors.codes[expat.errors.XML_ERROR_JUNK_AFTER_DOC_ELEMENT]
            rest = data[parser.ErrorByteIndex :].lstrip()
            if junk and rest.startswith(b"<") and rest[1:2].isalpha():
                data, again = rest, True
            elif doc["root"] or e.code != expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS]:
                text = "unexpected EOF" if e.code == expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS] else expat.ErrorString(e.code)
                before = data[: parser.ErrorByteIndex + 1]
                loose = re.search(rb"&[^;\s<]*[^;]?$", before[-64:]) is not None
                doc["xml_error"] = f"line {e.lineno}: {text}" + _HINT * (loose or "entity" in text)
    doc["kind"] = doc["kind"] or "not-sitemap"


def read_list(data: bytes) -> list[dict] | None:
    """Entries of a plain list: every line that isn't blank must start with http:// or https://."""
    out = []
    for n, raw in enumerate(data.split(b"\n"), 1):
        if len(raw) > LONGEST_LINE:
            return None
        line = raw.removesuffix(b"\r").decode("utf-8", "replace")
        value = line.strip(BLANKS)
        if value and not value.lower().startswith(("http://", "https://")):
            return None
        if value:
            out.append(new_entry(n) | {"raw_loc": line, "loc": value, "has_loc": True})
    return out or None


def looks_like_html(head: bytes) -> bool:
    return any(mark in head.lower() for mark in (b"<!doctype html", b"<html", b"<head", b"<body"))


def parse(raw: bytes | None, limit: int = 64 << 20) -> dict:
    """A document of a file's bytes; at most limit bytes are taken from a gzip stream. A null body is empty."""
    data = bytes(raw or b"")
    doc = {
        "kind": "", "root": "", "namespace": "", "gzip": data[:2] == b"\x1f\x8b", "gzip_error": "", "uncompressed": 0, "truncated": False,
        "encoding": "", "invalid_utf8": False, "xml_error": "", "looks_like_html": False, "news_count": 0, "entries": [], "sitemaps": [],
    }
    if doc["gzip"]:
        if len(data) < 10 or data[2] != 8:
            return doc | {"kind": "not-sitemap", "gzip_error": "gzip: invalid header"}
        data, doc["truncated"], doc["gzip_error"] = gunzip(data, limit)
    doc["uncompressed"] = len(data)
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        doc["invalid_utf8"] = True
    doc["looks_like_html"] = looks_like_html(data[:SNIFFED])
    trimmed = data.strip()
    if trimmed and not trimmed.startswith(b"<"):
        entries = read_list(trimmed)
        return doc | {"kind": "text" if entries else "not-sitemap", "entries": entries or []}
    # Bytes that aren't UTF-8 are shown as such, so that the XML round them can be read.
    read_xml(doc, data.decode("utf-8", "replace").encode() if doc["invalid_utf8"] else data)
    return doc


def parse_partition(batches, limit: int):
    for batch in batches:
        docs = pa.array([parse(b, limit) | {} for b in batch.column(1).to_pylist()], _DOCUMENT)
        yield pa.RecordBatch.from_arrays([batch.column(0), docs], names=["row", "doc"])


def documents(responses: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """responses (body and others) with the column doc (DOCUMENT) in place of body."""
    others = [c for c in responses.columns if c != "body"]
    packed = responses.select(F.struct(*others).alias("row"), "body")
    row = packed.schema["row"].dataType.simpleString()
    return map_arrow(packed, parse_partition, f"row {row}, doc struct<{_NESTED(DOCUMENT)}>", BATCH, limit).select("row.*", "doc")
