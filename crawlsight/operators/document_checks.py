"""Checks of a sitemap file as a whole: a projection over its parsed document and its HTTP answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.functions import urls
from crawlsight.functions.langcodes import quoted
from crawlsight.operators.catalogue import issue, one_of
from crawlsight.sources.sitemap_file import MAX_BYTES, MAX_ENTRIES, MAX_NEWS, NAMESPACE

#: Media types of sitemaps. Fixed values of the check.
TYPES = ("application/xml", "text/xml", "application/gzip", "application/x-gzip", "application/octet-stream", "text/plain")


def entry_count(doc: Column) -> Column:
    return F.when(doc["kind"] == "index", F.size(doc["sitemaps"])).otherwise(F.size(doc["entries"]))


def redirected(url: Column, final_url: Column) -> Column:
    """Whether the answer came from elsewhere than the URL, as written or as clients send it."""
    sent = F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*)", "$1")
    return (F.coalesce(final_url, F.lit("")) != "") & (final_url != url) & (final_url != urls.encode(sent))


def is_sitemap(status: Column, error: Column, doc: Column) -> Column:
    return (F.coalesce(error, F.lit("")) == "") & (status == 200) & doc["kind"].isin("urlset", "index", "text")


def document_issues(url: Column, final_url: Column, content_type: Column, truncated: Column, doc: Column) -> Column:
    """Issues of a file that answered 200, in order; of one that is no sitemap only what makes it none."""
    kind = doc["kind"]
    good, broken = kind != "not-sitemap", doc["gzip_error"] != ""
    served = F.coalesce(content_type, F.lit(""))
    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    bad = ~good & ~broken
    page = bad & doc["looks_like_html"]
    rooted = bad & ~doc["looks_like_html"] & (doc["root"] != "")
    unread = bad & ~doc["looks_like_html"] & (doc["root"] == "")
    declared = F.lower(doc["encoding"])
    n = entry_count(doc)
    return one_of(
        issue("SITEMAP_REDIRECT", redirected(url, final_url), "redirects to ", final_url),
        issue("SITEMAP_GZIP", path.endswith(".gz") & ~doc["gzip"], "the URL ends with .gz but the content is not gzip-compressed"),
        issue("SITEMAP_GZIP", broken, "broken gzip stream: ", doc["gzip_error"]),
        issue("SITEMAP_NOT_SITEMAP", page, "an HTML page instead of a sitemap"),
        issue("SITEMAP_NOT_SITEMAP", rooted, "root element <", doc["root"], "> instead of <urlset> or <sitemapindex>"),
        issue("SITEMAP_INVALID_XML", unread & (doc["xml_error"] != ""), doc["xml_error"]),
        issue("SITEMAP_NOT_SITEMAP", unread & (doc["xml_error"] == ""), "neither XML nor a list of URLs"),
        issue("SITEMAP_CONTENT_TYPE", good & (served != "") & ~F.coalesce(texts.media_type(served).isin(*TYPES), F.lit(False)), "served as ", quoted(served)),
        issue("SITEMAP_INVALID_XML", good & (doc["xml_error"] != ""), doc["xml_error"]),
        issue("SITEMAP_NAMESPACE", good & (kind != "text") & (doc["namespace"] != NAMESPACE), "namespace ", F.coalesce(F.nullif(doc["namespace"], F.lit("")), F.lit("none")), f" instead of {NAMESPACE}"),
        issue("SITEMAP_ENCODING", good & doc["invalid_utf8"], "the file holds bytes that are not valid UTF-8"),
        issue("SITEMAP_ENCODING", good & ~doc["invalid_utf8"] & ~declared.isin("", "utf-8", "utf8"), "declared encoding ", quoted(doc["encoding"])),
        issue("SITEMAP_TOO_LARGE", good & ((doc["uncompressed"] > MAX_BYTES) | doc["truncated"] | F.coalesce(truncated, F.lit(False))), doc["uncompressed"], f" bytes uncompressed (max {MAX_BYTES})"),
        issue("SITEMAP_TOO_MANY_URLS", good & (n > MAX_ENTRIES), n, f" entries (max {MAX_ENTRIES})"),
        issue("SITEMAP_EMPTY", good & (n == 0) & (doc["xml_error"] == ""), "no entries"),
        issue("NEWS_TOO_MANY_URLS", good & (doc["news_count"] > MAX_NEWS), doc["news_count"], f" news entries (max {MAX_NEWS})"),
    )
