"""Everything the audit can report, and the policy that switches checks and sets severities."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks of severities.
SEVERITIES = {"notice": 1, "warning": 2, "error": 3}

GROUPS = (
    "site", "robots", "protocol", "extensions", "hreflang", "status", "redirects", "soft_404", "noindex", "robots_blocked",
    "canonical", "url_variants", "duplicates", "lastmod_mismatch", "performance", "content_type",
)

#: Codes in display order: code | severity | group | scope | title | description. Codes to titles are fixed values.
TABLE = """
SITE_UNREACHABLE | error | site | site | Site unreachable | There was no HTTP answer from the home page at all.
SITE_HTTP_ERROR | error | site | site | Home page error | The status of the home page is 400 or above.
SITE_WAF_BLOCK | warning | site | site | Blocked by a firewall | A 403 page with the words "access denied": a firewall hides the site from the audit.
SITE_FIRST_VISIT_DIFFERS | notice | site | site | First visit differs | A visitor without cookies is answered differently from one who comes again.
ROBOTS_MISSING | warning | robots | site | robots.txt missing | The host has no robots.txt that answers 200.
ROBOTS_SOFT_404 | warning | robots | site | robots.txt is an HTML page | What is served as robots.txt is a web page.
ROBOTS_NO_SITEMAP | notice | robots | site | No Sitemap line | robots.txt names no sitemap.
ROBOTS_SITEMAP_INVALID | error | robots | site | Broken sitemap in robots.txt | robots.txt names a sitemap that can't be read as one.
SITEMAP_NOT_FOUND | error | robots | site | No sitemap | Neither robots.txt nor a usual path leads to a sitemap.
SITEMAP_FALLBACK_ONLY | warning | robots | site | Sitemap not announced | A sitemap stands at a usual path, but robots.txt doesn't name it.
SITEMAP_SOFT_404 | warning | robots | site | Sitemap path is an HTML page | A usual sitemap path answers 200 with a web page.
SITEMAP_HTTP_ERROR | error | protocol | sitemap | Sitemap HTTP error | The file didn't answer with status 200.
SITEMAP_REDIRECT | notice | protocol | sitemap | Sitemap redirects | The file is elsewhere; its last address should be listed.
SITEMAP_NOT_SITEMAP | error | protocol | sitemap | Not a sitemap | The content is no urlset, no sitemapindex and no list of URLs.
SITEMAP_INVALID_XML | error | protocol | sitemap | Invalid XML | The XML is not well-formed, often for a bare & in a URL.
SITEMAP_NAMESPACE | error | protocol | sitemap | Wrong namespace | The root element is not in the namespace of the sitemap protocol 0.9.
SITEMAP_CONTENT_TYPE | warning | protocol | sitemap | Unexpected Content-Type | The type served is not XML, gzip or plain text.
SITEMAP_GZIP | error | protocol | sitemap | Gzip problem | A .gz file that isn't gzip, or whose stream is broken.
SITEMAP_TOO_MANY_URLS | error | protocol | sitemap | Over 50,000 entries | More entries than the protocol allows in a file.
SITEMAP_TOO_LARGE | error | protocol | sitemap | Over 50 MB | More than 52,428,800 bytes after decompression.
SITEMAP_ENCODING | error | protocol | sitemap | Not UTF-8 | The bytes or the declared encoding are not UTF-8.
SITEMAP_EMPTY | warning | protocol | sitemap | Empty sitemap | The file has no entries.
SITEMAP_INDEX_CYCLE | error | protocol | sitemap | Index cycle | An index leads back to itself.
SITEMAP_REPEAT | notice | protocol | sitemap | Sitemap listed twice | The file was read before, by way of another index.
SITEMAP_TOO_DEEP | warning | protocol | sitemap | Too deep | The index lies below the depth that is read.
SITEMAP_NESTED_INDEX | warning | protocol | sitemap | Nested index | An index stands in another index, which search engines don't follow.
SITEMAP_CROSS_HOST | warning | protocol | sitemap | Sitemap on another host | The index names a file on another host.
SITEMAP_LOC_INVALID | error | protocol | sitemap | Invalid sitemap <loc> | The address of an index entry is missing, relative or too long.
SITEMAP_LASTMOD_INVALID | warning | protocol | sitemap | Invalid index <lastmod> | The date of an index entry is malformed or in the future.
SITEMAP_DUPLICATE_ENTRIES | warning | duplicates | sitemap | Duplicates inside the file | A URL stands in the file more than once.
NEWS_TOO_MANY_URLS | warning | extensions | sitemap | Over 1,000 news URLs | More news entries than a file may have.
LOC_NOT_ABSOLUTE | error | protocol | url | Relative <loc> | The address is missing or no absolute http(s) URL.
LOC_TOO_LONG | error | protocol | url | <loc> too long | The address has more than 2,048 bytes.
LOC_NOT_ENCODED | warning | protocol | url | Unencoded characters | The address holds characters that need percent-encoding.
LOC_WHITESPACE | notice | protocol | url | Whitespace around <loc> | There are blanks before or after the address.
LOC_FRAGMENT | warning | protocol | url | Fragment in <loc> | The address has a #fragment, which search engines drop.
LOC_CROSS_HOST | warning | protocol | url | URL on another host | The address is on another host than its sitemap.
LOC_OUT_OF_SCOPE | warning | protocol | url | URL outside the sitemap's folder | The address is above the folder of a sitemap that robots.txt doesn't name.
LASTMOD_INVALID | warning | protocol | url | Invalid <lastmod> | The date is not written as a W3C datetime.
LASTMOD_FUTURE | warning | protocol | url | <lastmod> in the future | The date is more than a day ahead.
CHANGEFREQ_INVALID | warning | protocol | url | Invalid <changefreq> | The value is none of the seven that the protocol has.
PRIORITY_INVALID | warning | protocol | url | Invalid <priority> | The value is no number from 0.0 to 1.0.
IMAGE_INVALID | warning | extensions | url | Invalid image entry | The image has no absolute address.
IMAGE_TOO_MANY | warning | extensions | url | Over 1,000 images | More images than a URL may have.
VIDEO_MISSING_FIELD | error | extensions | url | Video field missing | The video lacks a thumbnail, title, description or address.
VIDEO_INVALID | warning | extensions | url | Invalid video field | An address, the duration (1 to 28800 s) or the rating (0 to 5) is wrong.
NEWS_MISSING_FIELD | error | extensions | url | News field missing | The article lacks publication name, language, date or title.
NEWS_INVALID | warning | extensions | url | Invalid news field | The article's language or date is malformed.
NEWS_STALE | notice | extensions | url | Old news entry | The article is older than news sitemaps should hold.
HREFLANG_INVALID | error | hreflang | url | Invalid hreflang | The alternate's relation, language tag or address is wrong.
HREFLANG_NO_SELF | warning | hreflang | url | hreflang without self | The alternates leave out the URL itself.
HREFLANG_CONFLICT | warning | hreflang | url | Conflicting hreflang | One language tag leads to different URLs.
HREFLANG_NOT_RECIPROCAL | warning | hreflang | url | hreflang not reciprocal | The alternate is listed, but doesn't name this URL.
HREFLANG_ALTERNATE_UNLISTED | notice | hreflang | url | Alternate not in the sitemap | The alternate is in none of the site's sitemaps.
DUPLICATE_URL | warning | duplicates | url | Duplicate URL | The site's sitemaps hold the URL more than once.
URL_NO_RESPONSE | error | status | url | No response | There was no HTTP answer, even after retries.
URL_HTTP_ERROR | error | status | url | HTTP error | The status is 400 or above.
URL_RETRIED | notice | status | url | Answered after retries | The first attempts had no answer.
URL_REDIRECT | warning | redirects | url | Redirect | The URL redirects; its last address should be listed.
URL_REDIRECT_CHAIN | warning | redirects | url | Redirect chain | It takes more than one hop to the page.
URL_REDIRECT_LOOP | error | redirects | url | Redirect loop | The hops come back to where they were.
URL_REDIRECT_BROKEN | error | redirects | url | Redirect to an error | The hops end on an error, or there are too many.
URL_REDIRECT_DOWNGRADE | error | redirects | url | Redirect to http | A hop leads from https to http.
SOFT_404 | error | soft_404 | url | Soft 404 | A 200 page that says "not found" or has hardly any text.
NOINDEX | error | noindex | url | noindex | The page or its headers ask not to be indexed.
ROBOTS_BLOCKED | error | robots_blocked | url | Blocked by robots.txt | robots.txt forbids the URL to the crawler.
CANONICAL_MISMATCH | warning | canonical | url | Canonical points elsewhere | The page names another URL as its canonical one.
CANONICAL_INVALID | warning | canonical | url | Invalid canonical | The page names several canonical URLs, or an unreadable one.
HTTP_URL | warning | url_variants | url | http:// URL | A plain http URL on an https site.
HOST_VARIANT | warning | url_variants | url | Host variant | Another host than the site's, with or without www.
TRAILING_SLASH | notice | url_variants | url | Trailing slash style | Most of the site's URLs end the other way.
TRACKING_PARAMS | warning | url_variants | url | Tracking parameters | The URL carries parameters that only track a visit.
QUERY_PARAMS | notice | url_variants | url | Query parameters | The URL carries parameters.
NEAR_DUPLICATE | warning | url_variants | url | Near duplicate | Another spelling of the same page is listed too.
CASE_VARIANT | warning | url_variants | url | Case variant | The same path in other letter case is listed too.
LASTMOD_MISMATCH | warning | lastmod_mismatch | url | lastmod disagrees | The sitemap's date and the Last-Modified header differ.
SLOW_RESPONSE | warning | performance | url | Slow response | The answer took longer than the threshold.
PAGE_TOO_LARGE | warning | performance | url | Large page | The body is larger than the threshold.
CONTENT_NOT_HTML | notice | content_type | url | Not an HTML page | A 200 answer that isn't a web page.
"""


@dataclass(frozen=True)
class Definition:
    cat_no: int
    code: str
    severity: str
    group: str
    scope: str
    title: str
    description: str


CATALOGUE = tuple(Definition(i, *(part.strip() for part in line.split(" | "))) for i, line in enumerate(TABLE.strip().splitlines()))
BY_CODE = {d.code: d for d in CATALOGUE}

SCHEMA = "cat_no int, code string, severity string, sev_rank tinyint, grp string, scope string, title string, description string, enabled boolean"


@dataclass(frozen=True)
class Policy:
    """Which codes are reported, and how seriously. A group that isn't named is on."""

    groups: Mapping[str, bool] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    override: Mapping[str, str] = field(default_factory=dict)

    def group_enabled(self, group: str) -> bool:
        return self.groups.get(group, True)

    def enabled(self, code: str) -> bool:
        return code in BY_CODE and code not in self.disabled and self.group_enabled(BY_CODE[code].group)

    def severity(self, code: str) -> str:
        return self.override.get(code, BY_CODE[code].severity)


def catalogue(spark: SparkSession, policy: Policy = Policy()) -> DataFrame:
    """The 79 definitions in display order, with the policy's severities and switches."""
    rows = []
    for d in CATALOGUE:
        severity = policy.severity(d.code)
        rows.append((d.cat_no, d.code, severity, SEVERITIES[severity], d.group, d.scope, d.title, d.description, policy.enabled(d.code)))
    return spark.createDataFrame(rows, SCHEMA)


# Issues as checks make them: an array of (code, message) a row, exploded in their order.

FOUND = "struct<code: string, message: string>"


def text(*parts: Column | str) -> Column:
    """A message: strings are literals; a null part shows as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def issue(code: str, condition: Column, *message: Column | str) -> Column:
    """(code, message) where the condition holds, else null."""
    return F.when(condition, F.struct(F.lit(code).alias("code"), text(*message).alias("message")))


def one_of(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def each(values: Column, make) -> Column:
    """An issue, or none, for each value of an array; make: value to issue or null."""
    return F.filter(F.transform(values, make), lambda x: x.isNotNull())


def found(*arrays: Column) -> Column:
    """One array of all issues, in order; null arrays count as empty."""
    empty = F.array().cast(f"array<{FOUND}>")
    return reduce(lambda a, b: F.concat(a, b), [F.coalesce(a, empty) for a in arrays])


ISSUES = "site_id string, scope string, target string, sm_order int, seq array<bigint>, code string, message string, sitemap string"


def reported(issues: DataFrame, spark: SparkSession, policy: Policy) -> DataFrame:
    """Rows of ISSUES that the policy reports, with severity and sev_rank."""
    known = catalogue(spark, policy).where("enabled").select("code", "severity", "sev_rank")
    return issues.join(F.broadcast(known), "code")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
