"""Checks of sitemap entries: one projection over the columns of an entry, no join and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import dates, langcodes, urls
from crawlsight.functions.langcodes import quoted
from crawlsight.operators.catalogue import each, found, issue, one_of, text
from crawlsight.sources.sitemap_file import MAX_IMAGES, MAX_LOC

#: Fixed values of the protocol.
CHANGEFREQS = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
VIDEO_NEEDS = ("thumbnail_loc", "title", "description")
VIDEO_URLS = ("thumbnail_loc", "content_loc", "player_loc")
LONGEST_VIDEO = 28_800
#: Seconds that a date may lie ahead.
AHEAD = 86_400


def lastmod_issues(value: Column, now: Column, invalid: str, future: str) -> list[Column]:
    when = dates.w3c(value)
    return [
        issue(invalid, (value != "") & when.isNull(), "<lastmod> ", quoted(value), " is not a W3C datetime"),
        issue(future, (value != "") & (dates.seconds_between(when, now) > AHEAD), "<lastmod> ", value, " is in the future"),
    ]


def same_host(loc: Column, base: Column, allowed_hosts: list[str]) -> Column:
    host = urls.hostname(loc)
    return (host == urls.hostname(base)) | host.isin(*[h.strip().lower() for h in allowed_hosts])


def folder(base: Column) -> Column:
    """The folder of a sitemap's URL with a / at its end; ./ for a URL without a path."""
    path = urls.unescaped(urls.path_query(base)[0])
    return F.when(path == "", "./").otherwise(F.regexp_extract(F.regexp_replace(path, "/+", "/"), "^(.*/)", 1))


def loc_issues(base: Column, in_robots: Column, allowed_hosts: list[str]) -> Column:
    """Issues of loc, raw_loc and has_loc; base: the sitemap's last URL."""
    loc, raw = F.col("loc"), F.col("raw_loc")
    has = F.col("has_loc") & (loc != "")
    whole = has & urls.absolute(loc)
    near = same_host(loc, base, allowed_hosts)
    path = urls.unescaped(urls.path_query(loc)[0])
    path = F.when(path == "", "/").otherwise(path)
    outside = ~in_robots & (folder(base) != "/") & ~path.startswith(folder(base))
    return one_of(
        issue("LOC_NOT_ABSOLUTE", ~has, "<url> without <loc>"),
        issue("LOC_WHITESPACE", has & (raw != loc), "whitespace around ", quoted(loc)),
        issue("LOC_TOO_LONG", has & (F.octet_length(loc) > MAX_LOC), F.octet_length(loc), f" characters (max {MAX_LOC})"),
        issue("LOC_NOT_ENCODED", has & (urls.encode(loc) != loc), quoted(loc), " must be percent-encoded"),
        issue("LOC_NOT_ABSOLUTE", has & ~urls.absolute(loc), quoted(loc), " is not an absolute http(s) URL"),
        issue("LOC_FRAGMENT", whole & F.contains(loc, F.lit("#")), "#", urls.unescaped(F.regexp_extract(urls.encode(loc), "(?s)#(.*)$", 1))),
        issue("LOC_CROSS_HOST", whole & ~near, "on ", urls.host_with_port(loc), ", the sitemap on ", urls.host_with_port(base)),
        issue("LOC_OUT_OF_SCOPE", whole & near & outside, "not under ", folder(base), ", where the sitemap is"),
    )


def image_issues(images: Column) -> Column:
    many = issue("IMAGE_TOO_MANY", F.size(images) > MAX_IMAGES, F.size(images), f" images (max {MAX_IMAGES})")
    bad = each(images, lambda i: issue("IMAGE_INVALID", ~urls.absolute(i["loc"]), "<image:loc> ", quoted(i["loc"]), " is missing or not absolute"))
    return found(one_of(many), bad)


def video_issues(videos: Column) -> Column:
    def of(video: Column) -> Column:
        field = lambda name: F.coalesce(F.element_at(video, name), F.lit(""))
        missing = [F.when(field(name) == "", name) for name in VIDEO_NEEDS]
        missing.append(F.when((field("content_loc") == "") & (field("player_loc") == ""), "content_loc or player_loc"))
        lacks = F.array_compact(F.array(*missing))
        whole = F.when(field("duration").rlike(r"^[+-]?\d+$"), field("duration")).try_cast("bigint")
        return one_of(
            issue("VIDEO_MISSING_FIELD", F.size(lacks) > 0, "<video:video> without ", F.array_join(lacks, ", ")),
            *[issue("VIDEO_INVALID", (field(name) != "") & ~urls.absolute(field(name)), f"<video:{name}> ", quoted(field(name)), " is not absolute") for name in VIDEO_URLS],
            issue("VIDEO_INVALID", (field("duration") != "") & ~F.coalesce(whole.between(1, LONGEST_VIDEO), F.lit(False)), "<video:duration> ", quoted(field("duration")), f" (1-{LONGEST_VIDEO} seconds)"),
            issue("VIDEO_INVALID", (field("rating") != "") & ~dates.number_in(field("rating"), 0, 5), "<video:rating> ", quoted(field("rating")), " (0.0-5.0)"),
        )

    return F.flatten(F.transform(videos, of))


def news_issues(news: Column, now: Column, max_age_s: float) -> Column:
    def of(n: Column) -> Column:
        fields = (("publication language", "language"), ("publication name", "name"), ("publication_date", "publication_date"), ("title", "title"))
        lacks = F.array_compact(F.array(*[F.when(n[c] == "", shown) for shown, c in fields]))
        date, when = n["publication_date"], dates.w3c(n["publication_date"])
        stale = (dates.seconds_between(now, when) > max_age_s) if max_age_s > 0 else F.lit(False)
        return one_of(
            issue("NEWS_MISSING_FIELD", F.size(lacks) > 0, "<news:news> without ", F.array_join(lacks, ", ")),
            issue("NEWS_INVALID", (n["language"] != "") & ~langcodes.news_language(n["language"]), "<news:language> ", quoted(n["language"])),
            issue("NEWS_INVALID", (date != "") & when.isNull(), "<news:publication_date> ", quoted(date), " is not a W3C datetime"),
            issue("NEWS_STALE", when.isNotNull() & stale, "published ", date),
        )

    return F.flatten(F.transform(news, of))


def read_alternates(alternates: Column) -> Column:
    """Alternates with what the checks ask of them, worked out once."""
    return F.transform(
        alternates,
        lambda a: F.struct(
            a["rel"].alias("rel"), a["hreflang"].alias("hreflang"), a["href"].alias("href"), F.lower(a["hreflang"]).alias("lang"),
            (F.lower(a["rel"]) == "alternate").alias("related"), ((F.lower(a["rel"]) == "alternate") & urls.absolute(a["href"])).alias("kept"),
            urls.normalize(a["href"]).alias("norm"), langcodes.hreflang_error(a["hreflang"]).alias("error"),
        ),
    )


def alternate_issues(read: Column, loc: Column, has_self: Column) -> Column:
    """Issues of read_alternates(). Of one language the first address counts; others are compared with it."""
    norm = urls.normalize(loc)

    def first(a: Column, at: Column) -> Column:
        return F.get(F.filter(read, lambda b, j: (j < at) & b["kept"] & (b["lang"] == a["lang"])), F.lit(0))

    def of(a: Column, at: Column) -> Column:
        before = first(a, at)
        return one_of(
            issue("HREFLANG_INVALID", ~a["related"], "<xhtml:link rel=", quoted(a["rel"]), '> must be rel="alternate"'),
            issue("HREFLANG_INVALID", a["related"] & a["error"].isNotNull(), a["error"]),
            issue("HREFLANG_INVALID", a["related"] & ~a["kept"], "href ", quoted(a["href"]), " is not absolute"),
            issue("HREFLANG_CONFLICT", a["kept"] & (before["norm"] != a["norm"]), "hreflang ", quoted(a["hreflang"]), " points to ", before["href"], " and ", a["href"]),
        )

    own = F.exists(F.transform(read, lambda a, i: a["kept"] & first(a, i).isNull() & (a["norm"] == norm)), lambda x: x)
    no_self = has_self & F.exists(read, lambda a: a["kept"]) & ~own
    return found(F.flatten(F.transform(read, of)), one_of(issue("HREFLANG_NO_SELF", no_self, "the alternates do not include ", loc)))


def entry_columns(now: Column, allowed_hosts: list[str] = (), news_max_age_s: float = 0.0) -> dict[str, Column]:
    """Columns of ENTRY rows with base and in_robots, to be added in this order: whole, read, issues."""
    loc = F.col("loc")
    plain = one_of(
        *lastmod_issues(F.col("lastmod"), now, "LASTMOD_INVALID", "LASTMOD_FUTURE"),
        issue("CHANGEFREQ_INVALID", (F.col("changefreq") != "") & ~F.col("changefreq").isin(*CHANGEFREQS), "<changefreq> ", quoted(F.col("changefreq"))),
        issue("PRIORITY_INVALID", (F.col("priority") != "") & ~dates.number_in(F.col("priority"), 0, 1), "<priority> ", quoted(F.col("priority"))),
    )
    issues = found(
        loc_issues(F.col("base"), F.col("in_robots"), list(allowed_hosts)),
        plain,
        image_issues(F.col("images")),
        video_issues(F.col("videos")),
        news_issues(F.col("news"), now, news_max_age_s),
        alternate_issues(F.col("read"), loc, F.col("whole")),
    )
    return {"whole": F.col("has_loc") & urls.absolute(loc), "read": read_alternates(F.col("alternates")), "issues": issues}


def check_entries(entries: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """entries (ENTRY, base, in_robots and others) with entry_columns(): their issues, in order, and whether loc is absolute (whole)."""
    for name, column in columns.items():
        entries = entries.withColumn(name, column)
    return entries


def check_index_entries(entries: DataFrame, now: Column, allowed_hosts: list[str] = ()) -> DataFrame:
    """Index entries (INDEX_ENTRY, base and others) with their issues, which belong to the index, and whole: to be walked."""
    loc, base = F.col("loc"), F.col("base")
    has = F.col("has_loc") & (loc != "")
    written, line = urls.absolute_as_written(loc), text("line ", F.col("line"), ": ")
    size = F.octet_length(loc)
    issues = one_of(
        issue("SITEMAP_LOC_INVALID", ~has, line, "<sitemap> without <loc>"),
        issue("SITEMAP_LOC_INVALID", has & ~written, line, "<loc> ", quoted(loc), " is not an absolute URL"),
        issue("SITEMAP_LOC_INVALID", has & written & (size > MAX_LOC), line, "<loc> is ", size, f" characters long (max {MAX_LOC})"),
        issue("SITEMAP_CROSS_HOST", has & written & (size <= MAX_LOC) & ~same_host(loc, base, list(allowed_hosts)), loc, " is on ", urls.host_with_port(loc), ", the index on ", urls.host_with_port(base)),
        *[F.when(has, i) for i in lastmod_issues(F.col("lastmod"), now, "SITEMAP_LASTMOD_INVALID", "SITEMAP_LASTMOD_INVALID")],
    )
    return entries.withColumn("issues", issues).withColumn("whole", F.col("has_loc") & urls.absolute(loc))
