"""Variants of URLs within a site: scheme, host, trailing slash, parameters, near duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.functions import urls
from crawlsight.operators.catalogue import issue, one_of
from crawlsight.operators.collect import url_issues
from crawlsight.storage import written

#: Other URLs that a message names, and bytes of a query that it shows.
NAMED = 3
SHOWN = 80


def plain_issues(url: Column, reference: Column, slash: Column, noslash: Column) -> Column:
    """Issues that need the site's reference URL and its count of URLs with and without a trailing slash."""
    ok = urls.is_split(url)
    host, own = urls.without_port(urls.split_host(url)), urls.without_port(urls.split_host(reference))
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    style, query = urls.slash_style(url), urls.split_query(url)
    names = urls.parameter_names(query)
    track = F.filter(names, lambda n: n.rlike(urls.TRACKING))
    other = ok & (own != "") & (host != own)
    total = slash + noslash
    return one_of(
        issue("HTTP_URL", ok & (urls.split_scheme(url) == "http") & (urls.split_scheme(reference) == "https"), "http:// on an https site"),
        issue("HOST_VARIANT", other & (bare(host) == bare(own)), host, " instead of ", own, " (www / non-www)"),
        issue("HOST_VARIANT", other & (bare(host) != bare(own)), "other host ", host, " (site: ", own, ")"),
        issue("TRAILING_SLASH", ok & (style == "slash") & (noslash > slash), "ends with / while ", noslash, " of ", total, " URLs do not"),
        issue("TRAILING_SLASH", ok & (style == "noslash") & (slash > noslash), "no trailing / while ", slash, " of ", total, " URLs have one"),
        issue("TRACKING_PARAMS", ok & (F.size(track) > 0), F.array_join(track, ", ")),
        issue("QUERY_PARAMS", ok & (F.size(track) == 0) & (F.size(names) > 0), "?", texts.shortened(query, SHOWN)),
    )


def slash_votes(listed: DataFrame) -> DataFrame:
    """(site_id, slash, noslash) of all URLs of a site."""
    style = urls.slash_style(F.col("url"))
    return listed.groupBy("site_id").agg(F.count_if(style == "slash").alias("slash"), F.count_if(style == "noslash").alias("noslash"))


def others(listed: DataFrame, key: Column) -> DataFrame:
    """(site_id, url, shown): for URLs that share a key, the others by first sight, three named and the rest counted.

    Only the first four of a key are kept beside its count, so a key with any number of URLs stays small.
    """
    keyed = listed.select("site_id", "url", "seen", key.alias("key"))
    ahead = Window.partitionBy("site_id", "key").orderBy("seen")
    head = keyed.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= NAMED + 1)
    heads = head.groupBy("site_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda h: h["url"]).alias("head"))
    sizes = keyed.groupBy("site_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes.join(heads, ["site_id", "key"]), ["site_id", "key"])
    named = F.slice(F.filter("head", lambda u: u != F.col("url")), 1, NAMED)
    more = F.when(F.col("n") - 1 > NAMED, F.concat(F.lit(" (+"), (F.col("n") - 1 - NAMED).cast("string"), F.lit(" more)"))).otherwise("")
    return met.select("site_id", "url", F.concat(F.lit("also listed as "), F.array_join(named, ", "), more).alias("shown"))


def variant_issues(listed: DataFrame, references: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Issues of listed (site_id, url, seen); references: (site_id, reference), a row for each site. keep(): writes a table."""
    known = references.join(slash_votes(listed), "site_id")
    x = listed.join(known, "site_id")
    own = x.select("site_id", "url", F.posexplode(plain_issues(F.col("url"), F.col("reference"), F.col("slash"), F.col("noslash"))).alias("pos", "issue"))
    plain = url_issues(own, 4, F.col("issue.code"), F.col("issue.message"), F.col("pos"))
    near = keep(others(listed, urls.page_key(F.col("url"))), "near")
    folded = others(listed, urls.page_key(F.col("url"), fold=True)).join(near.select("site_id", "url"), ["site_id", "url"], "left_anti")
    duplicate = url_issues(near, 4, F.lit("NEAR_DUPLICATE"), F.col("shown"), 100)
    case = url_issues(folded, 4, F.lit("CASE_VARIANT"), F.col("shown"), 100)
    return plain.unionByName(duplicate).unionByName(case)
