"""Checks of a crawled URL's answer: status, speed and size, kind, soft 404, noindex, canonical, dates."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions import dates, urls
from crawlsight.functions import text as texts
from crawlsight.functions.langcodes import quoted
from crawlsight.operators.catalogue import issue, one_of
from crawlsight.sources.workers import by_name

#: Bytes of a page that are analysed.
PAGE_BYTES = 4 << 20
#: Seconds within which Last-Modified is taken for the time of the answer itself.
SAME_MOMENT = 60


def header(headers: Column, name: str) -> Column:
    """Values of a header, whatever the case of its name; null if there is none."""
    found = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower()))
    return F.nullif(F.flatten(found), F.array().cast("array<string>"))


def first_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(header(headers, name), F.lit(0)), F.lit(""))


def status_issues(status: Column, retries: Column, error: Column, redirect_to: Column) -> Column:
    """Up to the redirect itself; error is the text shown for the URL."""
    answered = status != 0
    return one_of(
        issue("URL_NO_RESPONSE", ~answered, error),
        issue("URL_RETRIED", answered & (retries > 0), error),
        issue("URL_HTTP_ERROR", status >= 400, status, " ", texts.status_text(status)),
        issue("URL_REDIRECT", status.between(300, 399) & (redirect_to == ""), status, " without a Location header"),
        issue("URL_REDIRECT", status.between(300, 399) & (redirect_to != ""), status, " -> ", redirect_to),
    )


def shown_error(status: Column, retries: Column, error: Column) -> Column:
    """What a URL's row says of its attempts."""
    after = F.concat(F.coalesce(error, F.lit("")), F.when(retries > 0, F.concat(F.lit(" (after "), retries.cast("string"), F.lit(" retries)"))).otherwise(""))
    return F.when(status == 0, after).when(retries > 0, F.concat(F.lit("ok after "), retries.cast("string"), F.lit(" retries"))).otherwise("")


def seconds_text(seconds: float) -> str:
    """A threshold as 1h2m3s, 1.5s or 300ms."""
    if seconds < 1:
        return f"{seconds * 1000:g}ms"
    hours, rest = divmod(seconds, 3600)
    minutes, rest = divmod(rest, 60)
    return (f"{hours:.0f}h" if hours else "") + (f"{minutes:.0f}m" if hours or minutes else "") + f"{round(rest, 9):g}s"


def performance_issues(status: Column, duration_s: Column, size: Column, slow_s: float, max_size: int) -> Column:
    return one_of(
        issue("SLOW_RESPONSE", (status != 0) & (duration_s > slow_s) & F.lit(slow_s > 0), F.format_string("%.2fs", duration_s.cast("double")), f" (threshold {seconds_text(slow_s)})"),
        issue("PAGE_TOO_LARGE", (status != 0) & (size > max_size) & F.lit(max_size > 0), size, f" bytes (threshold {max_size})"),
    )


def soft_404_issue(title: Column, h1: Column, text_length: Column, pattern: str, least: int) -> Column:
    named = F.lower(F.concat(title, F.lit(" "), h1)).rlike(pattern)
    return F.coalesce(
        issue("SOFT_404", named, "error text: ", F.when(title == "", h1).otherwise(title)),
        issue("SOFT_404", text_length < least, "almost empty: ", text_length, " characters of text"),
    )


def noindex_issue(meta_robots: Column, headers: Column, bot: str) -> Column:
    tags = header(headers, "X-Robots-Tag")
    return F.coalesce(
        issue("NOINDEX", texts.noindex(meta_robots, bot), "meta robots ", quoted(F.array_join(meta_robots, ", "))),
        issue("NOINDEX", texts.noindex(tags, bot), "X-Robots-Tag ", quoted(F.array_join(tags, ", "))),
    )


def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """ref as seen from base; null if it can't be read. Both are percent-encoded."""

    def one(b: str, r: str) -> str | None:
        try:
            whole = urljoin(b, r)
            parts = urlsplit(whole)
            parts.port  # noqa: B018  raises for a port that is no number
            return whole if parts.scheme not in ("http", "https") or parts.netloc else None
        except ValueError:
            return None

    return pd.Series([None if b is None or r is None else one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def resolved(base: Column, ref: Column) -> Column:
    """The address of a link on a page. Whole addresses take no Python; others are few."""
    run = by_name(resolve)

    def near(b: pd.Series, r: pd.Series) -> pd.Series:
        return run(b, r)

    near.__annotations__ = {"b": pd.Series, "r": pd.Series, "return": pd.Series}
    own = urls.encode(ref)
    return F.when(urls.absolute(ref), own).otherwise(F.pandas_udf(near, "string")(urls.encode(base), own))


def distinct_canonicals(canonicals: Column) -> Column:
    return F.array_distinct(F.filter(canonicals, lambda c: c != ""))


def canonical_issues(url: Column, links: Column, canonical: Column) -> Column:
    """links: distinct_canonicals(); canonical: the only one of them, resolved (null: unreadable)."""
    n = F.size(links)
    return one_of(
        issue("CANONICAL_INVALID", n > 1, n, " different canonical links: ", F.array_join(links, ", ")),
        issue("CANONICAL_INVALID", (n == 1) & canonical.isNull(), "cannot parse ", quoted(F.get(links, F.lit(0)))),
        issue("CANONICAL_MISMATCH", (n == 1) & canonical.isNotNull() & ~urls.same(canonical, url), "canonical is ", canonical),
    )


def lastmod_issue(lastmod: Column, headers: Column, tolerance_s: float) -> Column:
    """lastmod and Last-Modified far apart; a Last-Modified that is the time of the answer says nothing."""
    listed, header_value = dates.w3c(lastmod), first_header(headers, "Last-Modified")
    served, sent = dates.http_date(header_value), dates.http_date(first_header(headers, "Date"))
    generated = F.coalesce(F.abs(dates.seconds_between(sent, served)) < SAME_MOMENT, F.lit(False))
    apart = F.abs(dates.seconds_between(listed, served)) > tolerance_s
    shown = F.date_format(served, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return issue("LASTMOD_MISMATCH", (lastmod != "") & F.coalesce(apart, F.lit(False)) & ~generated, "<lastmod> ", lastmod, ", Last-Modified ", shown)
