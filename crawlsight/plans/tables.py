"""The report tables of a run: rows of text in report order, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.functions.text import dash, shown_number, status_class, status_key, yes_no
from crawlsight.operators import stats
from crawlsight.operators.tree import CYCLE, REPEAT
from crawlsight.plans.audit import Audit

URLS = ("site_id", "url", "status", "status_text", "redirect_to", "final_status", "content_type", "error", "retries", "occurrences", "found_in", "lastmod", "title", "h1", "text_length", "canonical", "size_bytes", "time_s", "max_severity", "issues", "details")
SITEMAPS = ("site_id", "sitemap", "parent", "depth", "kind", "http", "content_type", "gzip", "size_bytes", "uncompressed_bytes", "entries", "unique_urls", "duplicates_inside", "statuses", "url_issues", "issues", "details")
SITES = ("site_id", "url", "time_s", "home_status", "home_redirect", "robots", "robots_http", "robots_url", "sitemap", "sitemap_source", "sitemap_files", "urls", "crawled", "2xx", "3xx", "4xx", "5xx", "000", "duplicates", "errors", "warnings", "notices", "issues", "note")
ISSUES = ("site_id", "scope", "target", "severity", "code", "title", "message", "sitemap")


def texts_of(issues: DataFrame, scope: str, *by: str, once: bool = True) -> DataFrame:
    """(by..., issues, details): codes in the order of their issues, each once or as often as it comes, and all messages; of one scope."""
    own = issues.where(F.col("scope") == scope)
    held = F.array_sort(F.collect_list(F.struct("seq", "code", "message")))
    listed = own.groupBy(*by).agg(held.alias("held"))
    codes = F.transform("held", lambda i: i["code"])
    codes = F.array_join(F.array_distinct(codes) if once else codes, "; ")
    details = F.array_join(F.transform("held", lambda i: F.concat(i["code"], F.lit(": "), i["message"])), "; ")
    return listed.select(*by, codes.alias("issues"), details.alias("details"))


def order_of(run: Audit) -> DataFrame:
    return run.sites.select("site_id", "ord")


def _cells(df: DataFrame, names: tuple[str, ...], *order: str) -> DataFrame:
    return df.orderBy(*order).select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names])


def url_table(run: Audit) -> DataFrame:
    """A row for each URL, by site, the place of its first sitemap, and address."""
    told = texts_of(run.issues, "url", "site_id", "target").withColumnRenamed("target", "url")
    x = run.urls.join(told, ["site_id", "url"], "left").join(order_of(run), "site_id")
    final = F.when(F.coalesce("final_status", F.lit(0)) != 0, F.col("final_status").cast("string")).otherwise("-")
    x = x.withColumns({
        "status": F.when(~F.col("crawled"), "-").otherwise(status_key(F.col("crawled"), F.col("status"))), "final_status": final, "found_in": F.array_join("found_in", " | "), "time_s": shown_number(F.col("time_s")),
        **{c: dash(F.col(c)) for c in ("status_text", "redirect_to", "content_type", "error", "lastmod", "canonical", "max_severity", "issues", "details")},
    })
    return _cells(x, URLS, "ord", "first_order", "url")


def sitemap_table(run: Audit) -> DataFrame:
    """A row for each visit of the walk, in its order."""
    by = ["site_id", "sm_order"]
    statuses = stats.rendered(stats.sitemap_status_counts(run.urls, run.sitemaps), by, "status_key", "statuses")
    coded = stats.rendered(stats.sitemap_code_counts(run.urls, run.sitemaps, run.issues), by, "code", "url_issues")
    told = texts_of(run.issues, "sitemap", *by)
    x = run.sitemaps.join(statuses, by, "left").join(coded, by, "left").join(told, by, "left").join(order_of(run), "site_id")
    x = x.withColumns({
        "sitemap": F.col("url"), "http": status_key(~F.col("kind").isin(REPEAT, CYCLE), F.col("status")), "gzip": yes_no(F.col("gzip")),
        **{c: dash(F.col(c)) for c in ("parent", "content_type", "statuses", "url_issues", "issues", "details")},
    })
    return _cells(x, SITEMAPS, "ord", "sm_order")


def _pivoted(counts: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """(site_id, a column for each name) of counts (site_id, key, n)."""
    return counts.groupBy("site_id").agg(*[F.coalesce(F.sum(F.when(F.col(key) == value, F.col("n"))), F.lit(0)).alias(name) for name, value in names.items()])


def site_facts(run: Audit) -> DataFrame:
    """sites with all their counts as numbers: the base of every summary."""
    classes = _pivoted(stats.class_counts(run.urls), "status_class", {"2xx": "2xx", "3xx": "3xx", "4xx": "4xx", "5xx": "5xx", "000": "no response"})
    severities = _pivoted(stats.severity_counts(run.issues), "severity", {"errors": "error", "warnings": "warning", "notices": "notice"})
    spent = run.urls.groupBy("site_id").agg(F.sum("time_s").alias("time_s"))
    x = run.sites
    for part in (stats.url_counts(run.urls), stats.sitemap_files(run.sitemaps), classes, severities, spent):
        x = x.join(part, "site_id", "left")
    return x.na.fill(0)


def site_table(run: Audit) -> DataFrame:
    """A summary row for each site, in their order."""
    left = run.excluded.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "urls"))).alias("left"))
    told = texts_of(run.issues, "site", "site_id").select("site_id", F.col("details").alias("told"))
    x = site_facts(run).join(left, "site_id", "left").join(told, "site_id", "left")
    note = F.array_join(F.transform("left", lambda e: F.concat(F.lit("excluded "), e["urls"].cast("string"), F.lit(" URLs -> "), e["section_id"])), "; ")
    true = F.lit(True)
    x = x.withColumns({
        "time_s": shown_number(F.col("time_s")), "home_status": status_key(true, F.col("home.status")), "home_redirect": dash(F.col("home.location")), "robots": yes_no(F.col("robots_found")),
        "robots_http": status_key(true, F.col("robots_status")), "sitemap": dash(F.col("sitemap")), "sitemap_source": dash(F.col("sitemap_source")), "issues": dash(F.col("told")), "note": dash(note),
    })
    return _cells(x, SITES, "ord")


def ordered_issues(run: Audit) -> DataFrame:
    """Issues with their title, in report order: by site; site, sitemap, URL scope; target; emission."""
    places = run.urls.select("site_id", F.col("url").alias("target"), F.lit("url").alias("scope"), "first_order")
    x = run.issues.join(places, ["site_id", "scope", "target"], "left").join(order_of(run), "site_id")
    x = x.join(F.broadcast(run.known.select("code", "title")), "code", "left")
    scope = F.when(F.col("scope") == "site", 0).when(F.col("scope") == "sitemap", 1).otherwise(2)
    return x.withColumn("scope_no", scope).orderBy("ord", "scope_no", "sm_order", "first_order", "target", "seq")


def issue_table(run: Audit) -> DataFrame:
    x = ordered_issues(run)
    return x.select("site_id", "scope", "target", "severity", "code", F.coalesce("title", F.lit("")).alias("title"), "message", dash(F.col("sitemap")).alias("sitemap"))


def code_summary(run: Audit) -> DataFrame:
    return stats.summary(run.issues, run.known)


def junit_cases(run: Audit, most: int = 200) -> DataFrame:
    """(site_id, cat_no, code, title, n, sev_rank, lines): every site with every code; of its issues the first lines.

    Lines beyond most are cut off before they are gathered, so a code with any number of issues stays small.
    """
    from pyspark.sql import Window

    scope = F.when(F.col("scope") == "site", 0).when(F.col("scope") == "sitemap", 1).otherwise(2)
    places = run.urls.select("site_id", F.col("url").alias("target"), F.lit("url").alias("scope"), "first_order")
    x = run.issues.join(places, ["site_id", "scope", "target"], "left").withColumn("place", F.struct(scope.alias("s"), "sm_order", "first_order", "target", "seq"))
    rank = F.row_number().over(Window.partitionBy("site_id", "code").orderBy("place"))
    head = x.withColumn("nth", rank).where(F.col("nth") <= most)
    line = F.concat("target", F.lit(": "), "message")
    lines = head.groupBy("site_id", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda i: i["line"]).alias("lines"))
    counts = x.groupBy("site_id", "code").agg(F.count("*").alias("n"), F.max("sev_rank").alias("sev_rank"))
    every = run.sites.select("site_id", "ord").withColumn("d", F.explode(_definitions(run)))
    every = every.select("site_id", "ord", "d.cat_no", "d.code", "d.title")
    return every.join(counts, ["site_id", "code"], "left").join(lines, ["site_id", "code"], "left").orderBy("ord", "cat_no")


def _definitions(run: Audit) -> Column:
    """The catalogue as one array literal: each site gets every code without a join."""
    from crawlsight.operators.catalogue import CATALOGUE

    return F.array(*[F.struct(F.lit(d.cat_no).alias("cat_no"), F.lit(d.code).alias("code"), F.lit(d.title).alias("title")) for d in CATALOGUE])


def filter_urls(run: Audit, site: str = "", severity: str = "", status_in: str = "", code: str = "", words: str = "") -> DataFrame:
    """URLs of a site, with an issue at least so severe, of a status class, with a code, holding a text; '' is any."""
    x = run.urls
    if site:
        x = x.where(F.col("site_id") == site)
    if status_in:
        x = x.where(status_class(F.col("crawled"), F.col("status")) == status_in)
    own = run.issues.where("scope = 'url'").select("site_id", F.col("target").alias("url"), "code", "severity", "sev_rank")
    if severity:
        from crawlsight.operators.catalogue import SEVERITIES

        x = x.join(own.where(F.col("sev_rank") >= SEVERITIES[severity]), ["site_id", "url"], "left_semi")
    if code:
        x = x.join(own.where(F.col("code") == code), ["site_id", "url"], "left_semi")
    if words:
        hay = F.lower(F.concat_ws(" ", "url", "title", "h1", "redirect_to", "error"))
        x = x.where(F.contains(hay, F.lit(words.lower())))
    return x


def sanitized(table: DataFrame) -> DataFrame:
    """A table's cells as a spreadsheet may open them."""
    return table.select(*[texts.safe_cell(F.col(f"`{c}`")).alias(c) for c in table.columns])
