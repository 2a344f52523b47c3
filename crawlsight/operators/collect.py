"""From listed entries to the URLs of a site: sections, first sight, duplicates, alternates.

Order is kept in columns: an entry's place is (sm_order, entry_pos), its sitemap's place in the walk and its own in the
file. Groups by URL are plain aggregates; no list grows with a group but the sitemaps that hold a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions import urls
from crawlsight.functions.text import stripped
from crawlsight.operators.catalogue import text

PLACE = ("sm_order", "entry_pos")


def place() -> Column:
    return F.struct(*PLACE)


def seq(stage: int, *parts: Column | int) -> Column:
    """Where an issue stands in its target's list: a stage, then up to three numbers."""
    numbers = [F.lit(p) if isinstance(p, int) else p for p in (stage, *parts)]
    return F.array(*[n.cast("bigint") for n in numbers])


def sections_of(sites: DataFrame) -> DataFrame:
    """(site_id, section_id, section_prefix, ord): configured sites of the same host below a site's own path.

    sites: (site_id, url, ord). They come from a config file, so they are few.
    """
    own = sites.select("site_id", urls.host_of(F.col("url")).alias("host"), prefix(F.col("url")).alias("prefix"))
    other = sites.select(F.col("site_id").alias("section_id"), urls.host_of(F.col("url")).alias("host"), prefix(F.col("url")).alias("section_prefix"), "ord")
    below = (F.col("prefix") == "") | F.col("section_prefix").startswith(F.concat("prefix", F.lit("/")))
    met = own.join(other, "host").where((F.col("section_prefix") != "") & (F.col("section_prefix") != F.col("prefix")) & below)
    return met.select("site_id", "section_id", "section_prefix", "ord")


def prefix(site_url: Column) -> Column:
    return F.regexp_replace(urls.path_query(F.regexp_replace(stripped(site_url), "/+$", ""))[0], "/+$", "")


def in_sections(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """entries (site_id, loc and others) below their site's path, with the first section that has them (null: none).

    A site's sections are one array, so each entry is tested once, without a join row for each section.
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", F.col("section_prefix").alias("prefix"), F.col("section_id").alias("id"))))
    by_site = sections_of(sites).groupBy("site_id").agg(listed.alias("sections"))
    own = sites.select("site_id", prefix(F.col("url")).alias("prefix"), urls.host_of(F.col("url")).alias("host"))
    known = own.join(by_site, "site_id", "left")
    x = entries.join(known, "site_id").withColumn("path", urls.path_of(F.col("loc")))
    x = x.where(urls.under(F.col("path"), F.col("prefix")))
    first = F.get(F.filter("sections", lambda s: urls.under(F.col("path"), s["prefix"])), F.lit(0))
    section = F.when(urls.host_of(F.col("loc")) == F.col("host"), first)
    return x.withColumn("section", section["id"]).withColumn("section_prefix", section["prefix"]).drop("prefix", "host", "sections", "path")


def exclusions(placed: DataFrame) -> DataFrame:
    """(site_id, section_id, prefix, urls): distinct URLs left to each section."""
    own = placed.where("section IS NOT NULL").groupBy("site_id", F.col("section").alias("section_id"))
    return own.agg(F.first("section_prefix").alias("prefix"), F.countDistinct("loc").alias("urls"))


def file_counts(kept: DataFrame) -> DataFrame:
    """(site_id, sm_order, unique_urls, duplicates_inside) of the entries that no section has."""
    found = kept.groupBy("site_id", "sm_order").agg(F.countDistinct("loc").alias("unique_urls"), F.count("*").alias("entries"))
    return found.select("site_id", "sm_order", "unique_urls", (F.col("entries") - F.col("unique_urls")).alias("duplicates_inside"))


def collect_urls(kept: DataFrame, once: bool = True) -> DataFrame:
    """A row for each URL of a site, as written: occurrences, found_in (by first sight), lastmod (the first), first_order, seen.

    found_in names a file once, or else as often as it holds the URL.
    """
    by_file = kept.groupBy("site_id", "loc", "sm_url").agg(
        F.count("*").alias("n"), F.min(place()).alias("first"), F.min(F.when(F.col("lastmod") != "", F.struct(*PLACE, "lastmod"))).alias("dated")
    )
    # Files that hold one URL are few, so their list is short.
    files = F.array_sort(F.collect_list(F.struct("first", "sm_url", "n")))
    files = F.transform(files, lambda f: f["sm_url"]) if once else F.flatten(F.transform(files, lambda f: F.array_repeat(f["sm_url"], f["n"].cast("int"))))
    found = by_file.groupBy("site_id", F.col("loc").alias("url")).agg(
        F.sum("n").alias("occurrences"), files.alias("found_in"), F.coalesce(F.min("dated")["lastmod"], F.lit("")).alias("lastmod"), F.min("first").alias("seen")
    )
    return found.withColumn("first_order", F.col("seen")["sm_order"])


def entry_issues(kept: DataFrame) -> DataFrame:
    """Issues of the URLs' entries, each code and message of a URL once, at its first place and with that sitemap."""
    each = kept.select("site_id", "loc", *PLACE, "sm_url", F.posexplode("issues").alias("pos", "issue"))
    first = F.min(F.struct(*PLACE, "pos", "sm_url")).alias("first")
    found = each.groupBy("site_id", F.col("loc").alias("target"), "issue.code", "issue.message").agg(first)
    at = F.col("first")
    return found.select("site_id", F.lit("url").alias("scope"), "target", F.lit(None).cast("int").alias("sm_order"), seq(1, at["sm_order"], at["entry_pos"], at["pos"]).alias("seq"), "code", "message", at["sm_url"].alias("sitemap"))


def url_issues(rows: DataFrame, stage: int, code: Column, message: Column, *order: Column | int) -> DataFrame:
    """Issues of the URL-scope rows (site_id, url)."""
    return rows.select("site_id", F.lit("url").alias("scope"), F.col("url").alias("target"), F.lit(None).cast("int").alias("sm_order"), seq(stage, *order).alias("seq"), code.alias("code"), message.alias("message"), F.lit("").alias("sitemap"))


def duplicate_issues(listed: DataFrame) -> DataFrame:
    many = listed.where("occurrences > 1")
    return url_issues(many, 2, F.lit("DUPLICATE_URL"), text("listed ", F.col("occurrences"), " times in ", F.array_join("found_in", " | ")))


def alternates(kept: DataFrame) -> DataFrame:
    """(site_id, url, alternate): distinct normalised addresses of a URL's alternates over all its entries."""
    own = kept.select("site_id", F.col("loc").alias("url"), F.explode("read").alias("a")).where("a.kept")
    return own.select("site_id", "url", F.col("a.norm").alias("alternate")).distinct()


def hreflang_issues(listed: DataFrame, others: DataFrame) -> DataFrame:
    """Alternates that are not listed, or that don't name the URL back. Of URLs with one normal form the last seen counts."""
    normal = listed.select("site_id", "url", "seen", urls.normalize(F.col("url")).alias("norm"))
    winner = normal.groupBy("site_id", "norm").agg(F.max_by("url", "seen").alias("other"))
    mine = others.join(normal.select("site_id", "url", "norm"), ["site_id", "url"]).where(F.col("alternate") != F.col("norm"))
    met = mine.join(winner.select("site_id", F.col("norm").alias("alternate"), "other"), ["site_id", "alternate"], "left")
    back = others.select("site_id", F.col("url").alias("other"), F.col("alternate").alias("norm"), F.lit(True).alias("back"))
    met = met.join(back, ["site_id", "other", "norm"], "left")
    unlisted = F.col("other").isNull()
    bad = met.where(unlisted | F.col("back").isNull())
    code = F.when(unlisted, "HREFLANG_ALTERNATE_UNLISTED").otherwise("HREFLANG_NOT_RECIPROCAL")
    message = F.concat("alternate", F.when(unlisted, " is not in the sitemaps").otherwise(" does not link back"))
    # Issues of a URL come by address; a row number stands for it in seq.
    order = F.row_number().over(Window.partitionBy("site_id", "url").orderBy("alternate"))
    return url_issues(bad.withColumn("nth", order), 3, code, message, F.col("nth"))


def first_seen(listed: DataFrame, most: int) -> DataFrame:
    """At most so many URLs of a site, in the order of first sight; all for 0."""
    if not most:
        return listed
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("seen"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
