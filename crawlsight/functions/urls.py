"""URL functions as column expressions; none runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions.text import stripped

# Parts of a URL whose other characters are percent-encoded already. Loops are possessive: Java matches these without
# recursion, so that a URL of any length fits on the stack.
_ESCAPE = "%[0-9A-Fa-f]{2}"
_USER = r"(?:[^/?#@\[\]]*@)?"
_HOST = r"(?:\[[0-9A-Fa-f:.]+\]|(?:[^\[\]:%/?#@]++|%[89A-Fa-f][0-9A-Fa-f])*+)"
_PORT = "(?::[0-9]*)?"
_PATH = f"(?:[^?#%]++|{_ESCAPE})*+"
_REST = rf"(?:\?[^#]*)?(?:#(?:[^%]++|{_ESCAPE})*+)?"
_ABSOLUTE = rf"^(?i:https?)://{_USER}(?!$|[/?#]){_HOST}{_PORT}(?:/{_PATH})?{_REST}$"
_PARSABLE = rf"^(?:[A-Za-z][A-Za-z0-9+.\-]*://{_USER}{_HOST}{_PORT}(?:/{_PATH})?|[A-Za-z][A-Za-z0-9+.\-]*:(?!//){_PATH}|//{_USER}{_HOST}{_PORT}(?:/{_PATH})?|(?!//)(?:[^:/?#%]++|{_ESCAPE})*+(?:/{_PATH})?){_REST}$"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
#: Bytes that stay as they are: printable ASCII without " < > ` { } | \ ^ and blanks.
_CLEAN = r"""^[!#-;=?-\[\]_a-z~]*$"""

#: Parameters that only track a visit. Fixed values of the check.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|gbraid|wbraid|fbclid|yclid|msclkid|dclid|mc_cid|mc_eid|_ga|_gl|igshid)$"
INDEX_FILE = r"(?i)/index\.(?:html?|php|aspx?)$"
FILE_EXTENSION = r"\.[A-Za-z0-9]{1,5}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes that stay as they are, in hexadecimal.
_PLAIN = "^(2[13-9A-F]|[35][0-9ABDF]|4[0-9A-F]|6[1-9A-F]|7[0-9AE])$"


def bytes_of(v: Column) -> Column:
    """Two hexadecimal digits for each UTF-8 byte."""
    return F.regexp_extract_all(F.hex(F.encode(v, "UTF-8")), F.lit("(..)"), F.lit(1))


def encode(v: Column) -> Column:
    """v with blanks, controls, non-ASCII and characters that URLs can't hold as %XX; a % stays."""
    one = lambda h: F.decode(F.unhex(h), "UTF-8")
    plain = lambda h: h.rlike(_PLAIN)
    slow = F.array_join(F.transform(bytes_of(v), lambda h: F.when(plain(h), one(h)).otherwise(F.concat(F.lit("%"), h))), "")
    return F.when(v.rlike(_CLEAN), v).otherwise(slow)


def absolute(v: Column) -> Column:
    """Whether the encoded v is an absolute http or https URL with a host; a null is not."""
    return F.coalesce(encode(v).rlike(_ABSOLUTE), F.lit(False))


def absolute_as_written(v: Column) -> Column:
    """The same without encoding it first: an unencoded control character makes it unreadable."""
    return F.coalesce(v.rlike(_ABSOLUTE) & ~v.rlike(r"[\x00-\x1F\x7F]") & ~F.regexp_extract(v, _AUTHORITY, 1).rlike(r"[ \"<>]"), F.lit(False))


def hostname(v: Column) -> Column:
    """Lower-case host of the encoded v without user and port; empty if there is none."""
    whole = F.regexp_replace(F.regexp_extract(encode(v), _AUTHORITY, 1), "^[^@]*@", "")
    return F.lower(F.regexp_replace(F.regexp_extract(whole, r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))


def host_with_port(v: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(encode(v), _AUTHORITY, 1), "^[^@]*@", "")


def bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def path_query(v: Column) -> tuple[Column, Column]:
    """Escaped path and query of the encoded v, which has a scheme and a host."""
    rest = F.regexp_replace(encode(v), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    return F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)


def unescaped(path: Column) -> Column:
    """Percent-decoded; + stays, and a path with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def normalize(v: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, / for an empty path; v itself if it can't be read."""

    def of(e: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(e, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
        rest = let(rest, lambda r: F.when(r.rlike(r"^(\?|$)"), F.concat(F.lit("/"), r)).otherwise(r))
        other = let(F.regexp_replace(e, "#.*$", ""), lambda r: F.when(r.rlike(r"^(\?|$)"), F.concat(F.lit("/"), r)).otherwise(r))
        head = F.regexp_extract(e, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        return F.when(~e.rlike(_PARSABLE), None).when(head != "", F.concat(_normal_head(head), rest)).otherwise(other)

    return F.coalesce(let(encode(stripped(v)), of), v)


def _normal_head(head: Column) -> Column:
    """scheme://user@host:port with the host in lower case and no default port."""
    lower = F.lower(F.regexp_replace(head, "://[^@]*@", "://"))
    plain = F.regexp_replace(lower, "^(http://.*):80$|^(https://.*):443$|^([^:]*://.*):$", "$1$2$3")
    user = F.regexp_extract(head, "://([^@]*@)", 1)
    return F.when(user == "", plain).otherwise(F.concat(F.regexp_extract(plain, "^[^:]*://", 0), user, F.regexp_replace(plain, "^[^:]*://", "")))


def same(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


# The plain split that checks of variants use: no decoding, no validation.


def is_split(v: Column) -> Column:
    return F.locate("://", v) > 1


def split_scheme(v: Column) -> Column:
    return F.when(is_split(v), F.lower(F.regexp_extract(v, "(?s)^(.*?)://", 1))).otherwise("")


def _after(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, "(?s)^.*?://", ""), "(?s)#.*$", "")


def split_host(v: Column) -> Column:
    """Lower case, with a port if there is one."""
    return F.when(is_split(v), F.lower(F.regexp_extract(_after(v), "^([^/?]*)", 1))).otherwise("")


def split_path(v: Column) -> Column:
    return F.when(is_split(v), F.regexp_extract(_after(v), r"(?s)^[^/?]*(/[^?]*)?", 1)).otherwise("")


def split_query(v: Column) -> Column:
    return F.when(is_split(v), F.regexp_extract(_after(v), r"(?s)^[^?]*\?(.*)$", 1)).otherwise("")


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, r":[^:\]]*$", "")


def page_key(v: Column, fold: bool = False) -> Column:
    """What variants of one page share: host without port and www., decoded path without index file and trailing /, and query."""
    whole = let(split_path(v), lambda p: F.regexp_replace(unescaped(F.when(p == "", "/").otherwise(p)), INDEX_FILE, "/"))
    path = let(F.regexp_replace(whole, "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    path = F.lower(path) if fold else path
    query = let(split_query(v), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    host = F.regexp_replace(without_port(split_host(v)), r"^www\.", "")
    return F.when(is_split(v), F.concat(host, path, query)).otherwise(v)


def slash_style(v: Column) -> Column:
    """slash or noslash; empty for the home page and for files."""

    def of(path: Column) -> Column:
        last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
        none = path.isin("", "/") | last.rlike(FILE_EXTENSION)
        return F.when(none, "").when(path.endswith("/"), "slash").otherwise("noslash")

    return let(split_path(v), of)


def parameter_names(query: Column) -> Column:
    parts = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1))


# Sections of a site.


def path_of(v: Column) -> Column:
    """What follows the host, query and fragment included; / if nothing or only a fragment does."""
    rest = F.regexp_extract(v, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.locate("://", v) == 0, v).when((rest == "") | rest.startswith("#"), "/").otherwise(rest)


def host_of(v: Column) -> Column:
    """Lower-case host without port and www.; empty without ://."""
    return F.when(F.locate("://", v) == 0, "").otherwise(bare(F.regexp_extract(v, r"(?s)^.*?://([^/?#:]*)", 1)))


def under(path: Column, prefix: Column) -> Column:
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/"))) | path.startswith(F.concat(prefix, F.lit("?")))


def site_id(v: Column) -> Column:
    """A site's URL without scheme, query, fragment and trailing /, its host in lower case."""
    v = F.regexp_replace(stripped(v), "(?i)^https?://", "")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)[?#].*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(v, "^([^/]*)", 1)), F.regexp_replace(v, "^[^/]*", ""))


# robots.txt.


def robots_path(p: Column) -> Column:
    """Escapes in upper case, non-ASCII bytes and blanks as %XX."""
    one = lambda h: F.decode(F.unhex(h), "UTF-8")
    slow = F.array_join(F.transform(bytes_of(p), lambda h: F.when((h <= "20") | (h >= "80"), F.concat(F.lit("%"), h)).otherwise(one(h))), "")
    p = F.when(p.rlike(r"^[\x21-\x7F]*$"), p).otherwise(slow)
    head = r"^%[0-9A-Fa-f]{2}"
    upper = lambda x: F.when(x.rlike(head), F.concat(F.upper(F.substring(x, 1, 3)), F.substring(x, 4, 1 << 30))).otherwise(x)
    return F.when(F.contains(p, F.lit("%")), F.array_join(F.transform(F.split(p, f"(?={_ESCAPE})"), upper), "")).otherwise(p)


def robots_pattern(v: Column) -> Column:
    return robots_path(F.when(v.rlike("^[/*]"), v).otherwise(F.concat(F.lit("/"), v)))


def robots_regex(pattern: Column) -> Column:
    """A regular expression for a pattern that a prefix or equality can't stand for; null otherwise."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))
    return F.when(F.contains(body, F.lit("*")), regex)


def robots_matches(target: Column, pattern: Column, regex: Column) -> Column:
    end = pattern.endswith("$")
    plain = F.when(end, F.concat(target, F.lit("$")) == pattern).otherwise(target.startswith(pattern))
    return F.when(regex.isNull(), plain).otherwise(F.rlike(target, regex))
