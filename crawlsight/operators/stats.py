"""Counts over issues, URLs and sitemaps; all are plain aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.operators.catalogue import SEVERITIES

FILES = ("urlset", "index", "text")
LISTS = ("urlset", "text")
CLASSES = ("1xx", "2xx", "3xx", "4xx", "5xx", "no response", "not crawled")


def severity_name(rank: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, r in SEVERITIES.items() for x in (r, name)])
    return F.coalesce(F.try_element_at(names, rank.cast("int")), F.lit(""))


def url_counts(urls: DataFrame) -> DataFrame:
    """(site_id, urls, crawled, duplicates)."""
    return urls.groupBy("site_id").agg(F.count("*").alias("urls"), F.count_if("crawled").alias("crawled"), F.count_if(F.col("occurrences") > 1).alias("duplicates"))


def status_counts(urls: DataFrame) -> DataFrame:
    """(site_id, status_key, n) of crawled URLs."""
    return urls.where("crawled").groupBy("site_id", texts.status_key(F.col("crawled"), F.col("status")).alias("status_key")).agg(F.count("*").alias("n"))


def class_counts(urls: DataFrame) -> DataFrame:
    """(site_id, status_class, n) of all URLs."""
    return urls.groupBy("site_id", texts.status_class(F.col("crawled"), F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site_id", "severity").agg(F.count("*").alias("n"))


def code_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site_id", "code").agg(F.count("*").alias("n"))


def url_severity(issues: DataFrame) -> DataFrame:
    """(site_id, url, max_severity) of URLs with an issue."""
    worst = issues.where("scope = 'url'").groupBy("site_id", F.col("target").alias("url")).agg(F.max("sev_rank").alias("rank"))
    return worst.select("site_id", "url", severity_name(F.col("rank")).alias("max_severity"))


def sitemap_files(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.groupBy("site_id").agg(F.count_if(F.col("kind").isin(*FILES)).alias("sitemap_files"))


def owners(sitemaps: DataFrame) -> DataFrame:
    """(site_id, sitemap, sm_order): lists of URLs; of visits with one address the last."""
    return sitemaps.where(F.col("kind").isin(*LISTS)).groupBy("site_id", F.col("url").alias("sitemap")).agg(F.max("sm_order").alias("sm_order"))


def held(urls: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(site_id, sm_order, url, crawled, status): each URL with each sitemap that holds it."""
    each = urls.select("site_id", "url", "crawled", "status", F.explode("found_in").alias("sitemap"))
    return each.join(owners(sitemaps), ["site_id", "sitemap"]).drop("sitemap")


def sitemap_status_counts(urls: DataFrame, sitemaps: DataFrame) -> DataFrame:
    key = texts.status_key(F.col("crawled"), F.col("status")).alias("status_key")
    return held(urls, sitemaps).where("crawled").groupBy("site_id", "sm_order", key).agg(F.count("*").alias("n"))


def sitemap_code_counts(urls: DataFrame, sitemaps: DataFrame, issues: DataFrame) -> DataFrame:
    """(site_id, sm_order, code, n): URLs of a sitemap that have the code."""
    coded = issues.where("scope = 'url'").select("site_id", F.col("target").alias("url"), "code").distinct()
    return held(urls, sitemaps).join(coded, ["site_id", "url"]).groupBy("site_id", "sm_order", "code").agg(F.count("*").alias("n"))


def rendered(counts: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Counts as one text for each group: key:n in the order of keys, - for none."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "n")))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["n"].cast("string"))), " ")
    return counts.groupBy(*by).agg(shown.alias(name))


def totals(issues: DataFrame) -> DataFrame:
    """(severity, n) of the whole run."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def max_severity(issues: DataFrame) -> DataFrame:
    return issues.agg(severity_name(F.coalesce(F.max("sev_rank"), F.lit(0))).alias("max_severity"))


def summary(issues: DataFrame, known: DataFrame) -> DataFrame:
    """(severity, sev_rank, code, title, n) of the run, severity by the first issue seen, the worst and most first."""
    place = F.struct("site_id", "seq", "target")
    found = issues.groupBy("code").agg(F.min_by("sev_rank", place).alias("sev_rank"), F.count("*").alias("n"))
    found = found.join(F.broadcast(known.select("code", "title")), "code", "left")
    found = found.select(severity_name(F.col("sev_rank")).alias("severity"), "sev_rank", "code", F.coalesce("title", "code").alias("title"), "n")
    return found.orderBy(F.desc("sev_rank"), F.desc("n"), "code")


def worst_summary(issues: DataFrame, known: DataFrame) -> DataFrame:
    """The same by the worst severity of a code, as the HTML page shows it."""
    found = issues.groupBy("code").agg(F.max("sev_rank").alias("sev_rank"), F.count("*").alias("n"))
    found = found.join(F.broadcast(known.select("code", "title")), "code", "left")
    found = found.select(severity_name(F.col("sev_rank")).alias("severity"), "sev_rank", "code", F.coalesce("title", "code").alias("title"), "n")
    return found.orderBy(F.desc("sev_rank"), F.desc("n"), "code")


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.desc("sev_rank"), "code", "site_id", "target", "seq")
