"""Text and cell functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of error pages in common languages; matched against lower-case text. Fixed value of the check.
SOFT_404 = r"(^|[^0-9])404([^0-9]|$)|not found|page not found|error 404|nicht gefunden|introuvable|no encontrad|non trovat|não encontrad|niet gevonden|nie znaleziono|nu a fost g[aă]sit|не найден"
#: Directives of robots metadata that hold a colon themselves. Fixed values of the format.
DIRECTIVES = ("unavailable_after", "max-snippet", "max-image-preview", "max-video-preview")
HTML_MARKS = ("<!doctype html", "<html", "<head", "<body")
SNIFFED = 2048


#: White space, as at the ends of values that files and headers hold.
BLANKS = " \t\n\v\f\r\x85\xa0"
_TOKEN = r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+"
#: A media type and its parameters; one ; too many at the end is ignored.
_MEDIA = rf'''^\s*{_TOKEN}(?:/{_TOKEN})?\s*(?:;\s*{_TOKEN}\s*=\s*(?:{_TOKEN}|"(?:[^"\\]++|\\.)*+")\s*)*+;?\s*$'''


def stripped(v: Column) -> Column:
    """v without white space at its ends."""
    return F.btrim(v, F.lit(BLANKS))


def readable(body: Column) -> Column:
    """Bytes as text; those that aren't UTF-8 as replacement characters."""
    return F.make_valid_utf8(body.cast("string"))


def clean(v: Column) -> Column:
    """Runs of blanks, controls and no-break spaces as one space, none at the ends."""
    return F.trim(F.regexp_replace(v, r"[\x00-\x20\x7F\u00A0]+", " "))


def media_type(content_type: Column) -> Column:
    """Type of a Content-Type header in lower case; null if it can't be read."""
    return F.when(content_type.rlike(_MEDIA), F.lower(stripped(F.split(content_type, ";")[0])))


def is_html(content_type: Column, body: Column) -> Column:
    """By type, or by the first of each mark in the body where the type is missing, generic or unreadable."""
    kind = media_type(content_type)
    named = F.coalesce(kind.isin("text/html", "application/xhtml+xml"), F.lit(False))
    other = (F.coalesce(content_type, F.lit("")) != "") & kind.isNotNull() & ~kind.isin("application/octet-stream", "text/plain")
    # Byte by byte, as ISO-8859-1, so that places are those of the body.
    head = F.lower(F.decode(F.substring(F.coalesce(body, F.lit(b"")), 1, SNIFFED), "ISO-8859-1"))
    marks = []
    for mark in HTML_MARKS:
        at = F.locate(mark, head)
        follows = F.substring(head, at + len(mark), F.lit(1))
        marks.append((at > 0) & follows.isin("", ">", " ", "\n", "\t", "\r"))
    sniffed = marks[0] | marks[1] | marks[2] | marks[3]
    return named | (~F.coalesce(other, F.lit(False)) & sniffed)


def noindex(values: Column, bot: str) -> Column:
    """Whether robots directives say noindex or none to everyone or to the bot; a scope holds to the value's end."""
    bot = bot.strip().lower()

    def says(value: Column) -> Column:
        start = F.struct(F.lit("").alias("scope"), F.lit(False).alias("hit"))

        def fold(acc: Column, part: Column) -> Column:
            p = F.lower(stripped(part))
            name = F.regexp_extract(p, "^([^:]*):", 1)
            scoped = F.contains(p, F.lit(":")) & ~stripped(name).isin(*DIRECTIVES)
            scope = F.when(scoped, stripped(name)).otherwise(acc["scope"])
            said = F.when(scoped, stripped(F.regexp_replace(p, "^[^:]*:", ""))).otherwise(p)
            hit = acc["hit"] | (((scope == "") | (scope == bot)) & said.isin("noindex", "none"))
            return F.struct(scope.alias("scope"), hit.alias("hit"))

        return F.aggregate(F.split(value, ","), start, fold, lambda acc: acc["hit"])

    return F.coalesce(F.exists(F.filter(values, lambda v: v.isNotNull()), says), F.lit(False))


def safe_cell(v: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(v.rlike(r"^[=+@\t\r]|^-[^ 0-9]"), F.concat(F.lit("'"), v)).otherwise(v)


def dash(v: Column) -> Column:
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("-"))


def yes_no(v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit(False)), "YES").otherwise("NO")


def shown_number(v: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", v.cast("double")), "0+$", ""), r"\.$", "")


def shortened(v: Column, most: int) -> Column:
    """At most so many bytes and ..., cut at a character."""
    cut = readable(F.substring(F.encode(v, "UTF-8"), 1, most))
    return F.when(F.octet_length(v) <= most, v).otherwise(F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("...")))


def duration_text(seconds: Column) -> Column:
    """1m 05s; seconds only below a minute."""
    s = F.floor(seconds + 0.5).cast("bigint")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60).cast("bigint"), s % 60))


def status_class(crawled: Column, status: Column) -> Column:
    return (
        F.when(~crawled, "not crawled").when(status == 0, "no response").when(status < 200, "1xx")
        .when(status < 300, "2xx").when(status < 400, "3xx").when(status < 500, "4xx").otherwise("5xx")
    )


def status_key(crawled: Column, status: Column) -> Column:
    return F.when(~crawled, "-").when(status == 0, "000").otherwise(status.cast("string"))


def status_text(status: Column) -> Column:
    """The reason phrase, as the standard library has them."""
    from http import HTTPStatus

    older = {413: "Request Entity Too Large", 414: "Request URI Too Long", 416: "Requested Range Not Satisfiable", 418: "I'm a teapot", 422: "Unprocessable Entity"}
    pairs = {s.value: older.get(s.value, s.phrase) for s in HTTPStatus}
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    found = F.try_element_at(known, status)
    return F.when(status == 0, "No response (timeout / network error)").otherwise(F.coalesce(found, F.concat(F.lit("HTTP "), status.cast("string"))))
