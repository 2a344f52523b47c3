"""Signals of an HTML page: title, h1, visible text length, meta robots, canonical links.

A small tokenizer reads tags, comments and raw text as browsers do; bodies are analysed in Arrow batches.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.sources.workers import map_arrow

# Elements by what the analysis does with them. Fixed values of the check.
SKIPPED = {"script", "style", "noscript", "svg", "template"}
RAW = {"iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "title", "xmp"}
DECODED = {"textarea", "title"}
BLOCKS = {"p", "div", "br", "li", "tr", "td", "th", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "ul", "ol", "table"}

BATCH = 64
PAGE = "title string, h1 string, text_length int, meta_robots array<string>, canonicals array<string>"
_S = pa.string()
_PAGE = pa.struct([("title", _S), ("h1", _S), ("text_length", pa.int32()), ("meta_robots", pa.list_(_S)), ("canonicals", pa.list_(_S))])

_BLANK = re.compile("[\x00-\x20\x7f\xa0]+")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


def clean(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def _tag(text: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """Name, attributes (the first of a name counts), whether it closes itself, and the place after it; -1 if cut off."""
    m = _NAME.match(text, at)
    name, at, attributes = m[0].lower(), m.end(), {}
    while True:
        m = _ATTRIBUTE.match(text, at)
        if not m:
            break
        value = next((v for v in m.groups()[1:] if v is not None), "")
        attributes.setdefault(m[1].lower(), html.unescape(value))
        at = m.end()
    end = text.find(">", at)
    return name, attributes, text[at:end].strip().endswith("/"), end + 1 if end >= 0 else -1


def tokens(text: str) -> Iterator[tuple]:
    """('text', text), ('start', name, attributes, closed) and ('end', name) in order."""
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        while lt >= 0 and not (text[lt + 1 : lt + 2].isascii() and text[lt + 1 : lt + 2].isalpha() or text[lt + 1 : lt + 2] in ("!", "?", "/")):
            lt = text.find("<", lt + 1)
        if lt < 0:
            yield "text", html.unescape(text[at:])
            return
        if lt > at:
            yield "text", html.unescape(text[at:lt])
        if text.startswith("<!--", lt):
            end = re.compile(r"--!?>|^-?>").search(text, lt + 4)
            short = re.match(r"-?>", text[lt + 4 : lt + 6])
            at = lt + 4 + short.end() if short else end.end() if end else n
        elif text[lt + 1] in "!?" or text[lt + 1] == "/" and not text[lt + 2 : lt + 3].isalpha():
            end = text.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif text[lt + 1] == "/":
            name = _NAME.match(text, lt + 2)[0].lower()
            end = text.find(">", lt)
            at = end + 1 if end >= 0 else n
            if end >= 0:
                yield "end", name
        else:
            name, attributes, closed, after = _tag(text, lt + 1)
            if after < 0:
                return
            yield "start", name, attributes, closed
            at = after
            if name in RAW:
                close = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
                raw = text[at : close.start() if close else n]
                if raw:
                    yield "text", html.unescape(raw) if name in DECODED else raw
                at = close.start() if close else n


class Event(NamedTuple):
    """A piece of a page outside the skipped elements, and whether it is in the head."""

    kind: str  # text, start or end
    what: str  # the text, or the element's name
    attributes: dict[str, str]
    in_head: bool


#: What opens and closes the head.
HEAD = {("start", "head"): True, ("end", "head"): False, ("start", "body"): False}


def events(text: str) -> list[Event]:
    """The page as a list. Elements of SKIPPED hide all but end tags until they are closed."""
    out, hidden, in_head = [], 0, False
    for kind, what, *more in tokens(text):
        if kind != "text" and what in SKIPPED:
            hidden = max(0, hidden - 1) if kind == "end" else hidden + (not more[1])
            continue
        if hidden and kind != "end":
            continue
        in_head = HEAD.get((kind, what), in_head)
        out.append(Event(kind, what, more[0] if kind == "start" else {}, in_head))
    return out


def element(page: list[Event], name: str) -> slice:
    """The content of the first element of that name, to its end tag or the end of the page; empty without one."""
    marks = [(e.kind, e.what) for e in page]
    if ("start", name) not in marks:
        return slice(0, 0)
    start = marks.index(("start", name))
    return slice(start + 1, marks.index(("end", name), start) if ("end", name) in marks[start:] else len(marks))


def texts(page: list[Event]) -> list[str]:
    return [e.what for e in page if e.kind == "text"]


def visible(page: list[Event]) -> str:
    """Text outside the head; blocks and all end tags separate words."""
    separates = lambda e: e.kind == "end" or e.kind == "start" and e.what in BLOCKS
    return "".join(" " if separates(e) else e.what for e in page if separates(e) or e.kind == "text" and not e.in_head)


def robots(page: list[Event], bot: str) -> list[str]:
    """Contents of the meta elements for all robots or for the bot."""
    metas = [e.attributes for e in page if (e.kind, e.what) == ("start", "meta")]
    return [m.get("content", "") for m in metas if m.get("name", "").lower() in {"robots", bot.strip().lower()} - {""}]


def canonicals(page: list[Event]) -> list[str]:
    """Addresses of the canonical links before the body."""
    ahead = itertools.takewhile(lambda e: (e.kind, e.what) != ("start", "body"), page)
    links = [e.attributes for e in ahead if (e.kind, e.what) == ("start", "link")]
    return [x.get("href", "").strip() for x in links if "canonical" in x.get("rel", "").lower().split()]


def analyze(body: bytes | None, bot: str = "") -> dict:
    """Signals of a page: title and h1 are those of the first such elements, and a title's text is not visible."""
    page = events(bytes(body or b"").decode("utf-8", "replace"))
    title = element(page, "title")
    rest = page[: title.start] + page[title.stop :]
    return {
        "title": clean("".join(texts(page[title]))),
        "h1": clean(" ".join(texts(rest[element(rest, "h1")]))),
        "text_length": len(clean(visible(rest))),
        "meta_robots": robots(page, bot),
        "canonicals": canonicals(page),
    }


def analyze_partition(batches, bot: str):
    for batch in batches:
        pages = pa.array([analyze(b, bot) for b in batch.column(1).to_pylist()], _PAGE)
        yield pa.RecordBatch.from_arrays([batch.column(0), pages], names=["row", "page"])


def pages(responses: DataFrame, bot: str = "") -> DataFrame:
    """responses (body and others) with the column page (PAGE) in place of body."""
    packed = responses.select(F.struct(*[c for c in responses.columns if c != "body"]).alias("row"), F.col("body").cast("binary").alias("body"))
    row = packed.schema["row"].dataType.simpleString()
    page = re.sub(r"(\w+) (?=[a-z])", r"\1: ", PAGE)
    return map_arrow(packed, analyze_partition, f"row {row}, page struct<{page}>", BATCH, bot).select("row.*", "page")
