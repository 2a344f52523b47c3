"""The home page, robots.txt and where a site's sitemaps are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.functions import urls
from crawlsight.operators.catalogue import issue, one_of
from crawlsight.operators.collect import seq
from crawlsight.operators.document_checks import is_sitemap

FIRST_HOME_BYTES = 1 << 20


def site_issues(rows: DataFrame, stage: int, issues: Column, *order: Column | int) -> DataFrame:
    """Site-scope issues of rows (site_id, url and others)."""
    x = rows.select("site_id", "url", *[o.alias(f"o{i}") for i, o in enumerate(order) if isinstance(o, Column)], F.posexplode(issues).alias("pos", "issue"))
    place = [F.col(f"o{i}") if isinstance(o, Column) else o for i, o in enumerate(order)]
    return x.select("site_id", F.lit("site").alias("scope"), F.col("url").alias("target"), F.lit(None).cast("int").alias("sm_order"), seq(stage, *place, F.col("pos")).alias("seq"), "issue.code", "issue.message", F.lit("").alias("sitemap"))


def status_label(status: Column) -> Column:
    return F.when(status == 0, "000").otherwise(status.cast("string"))


def visit(response: Column, requested: Column) -> Column:
    """status, location, final_url and error of a home page's answer."""
    moved = (response["final_url"] != "") & (response["final_url"] != requested)
    location = F.when(response["primary_location"] != "", response["primary_location"]).when(moved, response["final_url"]).otherwise("")
    status = F.when(response["primary_status"] != 0, response["primary_status"]).otherwise(response["status"])
    return F.struct(status.alias("status"), location.alias("location"), response["final_url"].alias("final_url"), response["error"].alias("error"))


def home_pages(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """sites with home and warm_up (visits, null if not captured), home_body and reference_url."""
    fields = ["status", "primary_status", "primary_location", "final_url", "error", F.substring("body", 1, FIRST_HOME_BYTES).alias("body")]
    own = responses.where(F.col("phase").isin("home", "warm_up")).select("site_id", "phase", F.struct(*fields).alias("r"))
    by_phase = own.groupBy("site_id").agg(F.first(F.when(F.col("phase") == "home", F.col("r")), ignorenulls=True).alias("h"), F.first(F.when(F.col("phase") == "warm_up", F.col("r")), ignorenulls=True).alias("w"))
    target = F.concat("url", F.lit("/"))
    x = sites.join(by_phase, "site_id", "left")
    missing = F.struct(F.lit(0).alias("status"), F.lit("").alias("location"), F.lit("").alias("final_url"), F.lit("not captured").alias("error"))
    x = x.withColumn("home", F.when(F.col("h").isNull(), missing).otherwise(visit(F.col("h"), target)))
    x = x.withColumn("warm_up", F.when(F.col("w").isNotNull(), visit(F.col("w"), target)))
    final = F.coalesce(F.col("h.final_url"), F.lit(""))
    near = (final != "") & (urls.host_of(final) == urls.host_of(F.col("url")))
    return x.select(*sites.columns, "home", "warm_up", F.coalesce("h.status", F.lit(0)).alias("home_status"), F.col("h.body").alias("home_body"), F.when(near, final).otherwise(target).alias("reference_url"))


def home_issues(homes: DataFrame) -> DataFrame:
    home, warm, status = F.col("home"), F.col("warm_up"), F.col("home_status")
    differs = warm.isNotNull() & ((warm["status"] != home["status"]) | (warm["location"] != home["location"]))
    failed = home["error"] != ""
    denied = F.contains(F.lower(F.decode(F.coalesce("home_body", F.lit(b"")), "ISO-8859-1")), F.lit("access denied"))
    arrow = F.when(warm["location"] != "", F.concat(F.lit(" -> "), warm["location"])).otherwise("")
    found = one_of(
        issue("SITE_FIRST_VISIT_DIFFERS", differs, "first visit: ", status_label(warm["status"]), arrow),
        issue("SITE_UNREACHABLE", failed, home["error"]),
        issue("SITE_HTTP_ERROR", ~failed & (status >= 400), "the home page answers ", status),
        issue("SITE_WAF_BLOCK", ~failed & (status == 403) & denied, "403 Access denied"),
    )
    return site_issues(homes, 0, found)


def robots_files(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """(site_id, url, robots_url, status, error, body, html, found): a row for each site; the file is at the host's root."""
    origin = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = responses.where("phase = 'robots'").select("site_id", "status", "error", "content_type", "body").dropDuplicates(["site_id"])
    x = sites.select("site_id", "url", F.concat(origin, F.lit("/robots.txt")).alias("robots_url")).join(own, "site_id", "left")
    x = x.withColumn("status", F.coalesce("status", F.lit(0))).withColumn("error", F.coalesce("error", F.lit("")))
    x = x.withColumn("html", texts.is_html(F.col("content_type"), F.col("body")))
    return x.withColumn("found", (F.col("status") == 200) & ~F.col("html")).drop("content_type")


def robots_issues(files: DataFrame, listed: DataFrame) -> DataFrame:
    """files: robots_files(); listed: their Sitemap lines (site_id, line_no, url)."""
    counts = listed.groupBy("site_id").agg(F.count("*").alias("n"))
    x = files.join(counts, "site_id", "left")
    error = F.when(F.col("error") != "", F.concat(F.lit(" ("), "error", F.lit(")"))).otherwise("")
    found = one_of(
        issue("ROBOTS_MISSING", F.col("status") != 200, "robots.txt answers ", status_label(F.col("status")), error),
        issue("ROBOTS_SOFT_404", (F.col("status") == 200) & F.col("html"), "robots.txt is an HTML page"),
        issue("ROBOTS_NO_SITEMAP", F.col("found") & F.col("n").isNull(), "robots.txt has no Sitemap: line"),
    )
    return site_issues(x, 1, found)


def probes(documents: DataFrame) -> DataFrame:
    """(site_id, request_url, status, valid, html) of the captured sitemap files."""
    return documents.select("site_id", "request_url", "status", is_sitemap(F.col("status"), F.col("error"), F.col("doc")).alias("valid"), ((F.col("status") == 200) & F.col("html")).alias("html"))


def discovered(sites: DataFrame, robots: DataFrame, listed: DataFrame, tried: DataFrame, fallbacks: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots (site_id, root_no, url, in_robots), sources (site_id, sitemap, sitemap_source), and issues.

    All sitemaps that robots.txt names are roots, readable or not. If none is readable, the usual paths are tried in
    order, below the site and at its host's root, and the first readable one is a root too.
    """
    named = listed.groupBy("site_id", "url").agg(F.min("line_no").alias("root_no"))
    own = named.join(tried.withColumnRenamed("request_url", "url"), ["site_id", "url"], "left")
    own = own.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("status", F.coalesce("status", F.lit(0)))
    addresses = sites.select("site_id", F.col("url").alias("site_url"))
    broken = one_of(issue("ROBOTS_SITEMAP_INVALID", ~F.col("valid"), F.col("sitemap"), " answers ", status_label(F.col("status")), " and is not a readable sitemap"))
    invalid = site_issues(own.withColumnRenamed("url", "sitemap").join(addresses, "site_id").withColumnRenamed("site_url", "url"), 2, broken, F.col("root_no"))

    by_site = own.groupBy("site_id").agg(F.min_by(F.when(F.col("valid"), F.col("url")), F.when(F.col("valid"), F.col("root_no"))).alias("readable"), F.count("*").alias("n_listed"))
    origin = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    paths = [p.lstrip("/") for p in fallbacks]
    below = [c for i, p in enumerate(paths) for c in (F.struct(F.lit(2 * i).alias("n"), F.concat("url", F.lit(f"/{p}")).alias("to")), F.when(F.col("url") != origin, F.struct(F.lit(2 * i + 1).alias("n"), F.concat(origin, F.lit(f"/{p}")).alias("to"))))]
    x = sites.select("site_id", "url").join(by_site, "site_id", "left")
    open_ = x.where("readable IS NULL")
    candidates = open_.select("site_id", F.explode(F.array_compact(F.array(*below))).alias("c")) if paths else None
    none = F.lit(None).cast("string")
    if candidates is None:
        best = open_.select("site_id", none.alias("fallback"), F.lit(False).alias("soft"))
    else:
        fresh = candidates.select("site_id", "c.n", F.col("c.to").alias("url")).join(named.select("site_id", "url"), ["site_id", "url"], "left_anti")
        probed = fresh.join(tried.withColumnRenamed("request_url", "url"), ["site_id", "url"], "left")
        best = probed.groupBy("site_id").agg(F.min_by(F.when(F.col("valid"), F.col("url")), F.when(F.col("valid"), F.col("n"))).alias("fallback"), F.coalesce(F.bool_or("html"), F.lit(False)).alias("soft"))
    x = x.join(best, "site_id", "left").join(robots.select("site_id", F.col("found").alias("robots_found")), "site_id", "left")
    lost = F.col("readable").isNull() & F.col("fallback").isNull()
    found = one_of(
        issue("SITEMAP_FALLBACK_ONLY", F.col("readable").isNull() & F.col("fallback").isNotNull() & F.col("robots_found"), F.col("fallback"), " is not listed in robots.txt"),
        issue("SITEMAP_SOFT_404", lost & F.coalesce("soft", F.lit(False)), "a sitemap path answers 200 with an HTML page"),
        issue("SITEMAP_NOT_FOUND", lost & F.col("n_listed").isNull(), "no sitemap in robots.txt or at " + ", ".join(fallbacks)),
    )
    issues = invalid.unionByName(site_issues(x, 3, found))
    roots = own.select("site_id", "root_no", "url", F.lit(True).alias("in_robots"))
    extra = x.where("fallback IS NOT NULL").select("site_id", F.lit(1 << 30).alias("root_no"), F.col("fallback").alias("url"), F.lit(False).alias("in_robots"))
    source = F.when(F.col("readable").isNotNull(), "robots").when(F.col("fallback").isNotNull(), "fallback").otherwise("")
    sources = x.select("site_id", F.coalesce("readable", "fallback", F.lit("")).alias("sitemap"), source.alias("sitemap_source"))
    return roots.unionByName(extra), sources, issues


