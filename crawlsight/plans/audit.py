"""The audit as one plan over captured responses: discovery, walk, entries, URLs, crawl results, issues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import dates, urls
from crawlsight.functions import text as texts
from crawlsight.operators import catalogue, collect, discovery, document_checks, entry_checks, page_checks, redirects, robots_checks, stats, tree, variants
from crawlsight.operators.catalogue import Policy, found, issue, one_of
from crawlsight.operators.collect import seq, url_issues
from crawlsight.sources import html_page, robots_txt, sitemap_file
from crawlsight.sources.config import Config
from crawlsight.sources.schemas import captured
from crawlsight.storage import ahead, side_by_side, written

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass
class Audit:
    """The tables of a run. issues: ISSUES with severity and sev_rank; known: the catalogue under the policy."""

    sites: DataFrame
    sitemaps: DataFrame
    urls: DataFrame
    issues: DataFrame
    excluded: DataFrame
    known: DataFrame
    config: Config
    started_at: datetime
    finished_at: datetime | None = None


def parsed(responses: DataFrame, limit: int) -> DataFrame:
    """The captured sitemap files with doc, and html: whether they are web pages. Only what answered 200 is parsed."""
    own = responses.where("phase = 'sitemap'").dropDuplicates(["site_id", "request_url"])
    own = own.withColumn("html", texts.is_html(F.col("content_type"), F.col("body"))).withColumn("answered", (F.col("status") == 200) & (F.col("error") == ""))
    own = own.withColumn("body", F.when(F.col("answered"), F.col("body"))).drop("headers", "phase", "location", "primary_status", "primary_location", "retries", "duration_s")
    read = sitemap_file.documents(own.where("answered"), limit)
    return read.unionByName(own.where("NOT answered").drop("body").withColumn("doc", F.lit(None).cast(read.schema["doc"].dataType)))


def sitemap_issues(rows: DataFrame, stage: int, issues: Column, *order: Column | int) -> DataFrame:
    """Sitemap-scope issues of rows (site_id, sm_order, url and others)."""
    named = [o.alias(f"o{i}") for i, o in enumerate(order) if isinstance(o, Column)]
    x = rows.select("site_id", "sm_order", "url", *named, F.posexplode(issues).alias("pos", "issue"))
    place = [F.col(f"o{i}") if isinstance(o, Column) else o for i, o in enumerate(order)]
    return x.select("site_id", F.lit("sitemap").alias("scope"), F.col("url").alias("target"), "sm_order", seq(stage, *place, F.col("pos")).alias("seq"), "issue.code", "issue.message", F.col("url").alias("sitemap"))


def walked(roots: DataFrame, documents: DataFrame, max_depth: int) -> DataFrame:
    """Every visit of the walk with its file's answer and document (null for a file that was not captured)."""
    kids = F.transform(F.filter("doc.sitemaps", lambda e: e["has_loc"] & urls.absolute(e["loc"])), lambda e: e["loc"])
    indexes = documents.where("doc.kind = 'index'").select("site_id", F.col("request_url").alias("url"), kids.alias("children"))
    seen = tree.visits(roots, indexes, max_depth)
    x = seen.join(documents.withColumnRenamed("request_url", "url"), ["site_id", "url"], "left")
    return x.withColumn("status", F.coalesce("status", F.lit(0))).withColumn("error", F.when(F.col("answered").isNull(), "not captured").otherwise(F.coalesce("error", F.lit(""))))


def sitemap_rows(visits: DataFrame) -> DataFrame:
    """The table of sitemaps, without the counts of its URLs."""
    again = F.col("visit").isin(tree.REPEAT, tree.CYCLE)
    failed = ~F.coalesce("answered", F.lit(False))
    kind = F.when(again, F.col("visit")).when(failed, "not-sitemap").when((F.col("visit") == tree.TOO_DEEP), tree.TOO_DEEP).otherwise(F.col("doc.kind"))
    read = lambda c, empty: F.when(again | F.col(c).isNull(), F.lit(empty)).otherwise(F.col(c))
    moved = document_checks.redirected(F.col("url"), F.col("final_url"))
    entries = F.when(again | failed | (kind == "not-sitemap"), 0).otherwise(document_checks.entry_count(F.col("doc")))
    return visits.select(
        "site_id", "sm_order", "url", "parent", "depth", kind.alias("kind"), read("status", 0).alias("status"),
        F.when(~again & moved, F.col("final_url")).otherwise("").alias("final_url"), read("content_type", "").alias("content_type"),
        read("doc.gzip", False).alias("gzip"), read("size", 0).cast("bigint").alias("size_bytes"), read("doc.uncompressed", 0).cast("bigint").alias("uncompressed_bytes"),
        F.coalesce(entries, F.lit(0)).alias("entries"), "in_robots", F.when(~again & failed, F.col("error")).otherwise("").alias("error"),
    )


def visit_issues(visits: DataFrame, max_depth: int) -> DataFrame:
    """Issues of the visits themselves and of the files as a whole."""
    url, visit, kind = F.col("url"), F.col("visit"), F.col("doc.kind")
    met = visit.isin(tree.READ, tree.TOO_DEEP)
    answered = F.coalesce("answered", F.lit(False))
    nested = met & answered & (kind == "index") & (F.col("depth") > 0)
    whole = document_checks.document_issues(url, F.col("final_url"), F.col("content_type"), F.col("truncated"), F.col("doc"))
    all_ = found(
        one_of(
            issue("SITEMAP_INDEX_CYCLE", visit == tree.CYCLE, url, " is listed by itself or by one of its children"),
            issue("SITEMAP_REPEAT", visit == tree.REPEAT, "already read"),
            issue("SITEMAP_HTTP_ERROR", met & (F.col("error") != ""), "no response: ", F.col("error")),
            issue("SITEMAP_HTTP_ERROR", met & (F.col("error") == "") & (F.col("status") != 200), "answers ", F.col("status")),
        ),
        F.when(met & answered, whole),
        one_of(
            issue("SITEMAP_NESTED_INDEX", nested, "an index listed by the index ", F.col("parent")),
            issue("SITEMAP_TOO_DEEP", visit == tree.TOO_DEEP, f"max_depth {max_depth} reached"),
        ),
    )
    return sitemap_issues(visits, 0, all_)


def listed_entries(visits: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Entries of the lists that were read, with place, base and issues; columns: entry_checks.entry_columns()."""
    own = visits.where((F.col("visit") == tree.READ) & F.col("doc.kind").isin("urlset", "text"))
    rows = own.select("site_id", "sm_order", F.col("url").alias("sm_url"), _base().alias("base"), "in_robots", F.posexplode("doc.entries").alias("entry_pos", "e"))
    rows = rows.select("site_id", "sm_order", "sm_url", "base", "in_robots", "entry_pos", "e.*")
    checked = entry_checks.check_entries(rows, columns)
    return checked.select("site_id", "sm_order", "sm_url", "entry_pos", "loc", "lastmod", "read", "whole", "issues")


def _base() -> Column:
    return F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))


def index_entry_issues(visits: DataFrame, config: Config, now: Column) -> DataFrame:
    own = visits.where((F.col("visit") == tree.READ) & (F.col("doc.kind") == "index"))
    rows = own.select("site_id", "sm_order", "url", _base().alias("base"), F.posexplode("doc.sitemaps").alias("entry_pos", "e")).select("site_id", "sm_order", "url", "base", "entry_pos", "e.*")
    checked = entry_checks.check_index_entries(rows, now, config.sitemap.allowed_hosts)
    return sitemap_issues(checked, 1, F.col("issues"), F.col("entry_pos"))


def unrouted_issues(entries: DataFrame) -> DataFrame:
    """Entries without an absolute address are no URLs: their issues are the sitemap's, and name them."""
    lost = entries.where("NOT whole").withColumn("url", F.col("sm_url"))
    named = F.transform("issues", lambda i: F.struct(i["code"].alias("code"), F.when(F.col("loc") != "", F.concat("loc", F.lit(": "), i["message"])).otherwise(i["message"]).alias("message")))
    return sitemap_issues(lost, 1, named, F.col("entry_pos"))


def crawl_results(listed: DataFrame, responses: DataFrame, config: Config, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """URLs with their answers, and the issues of these.

    Pages are analysed where they are read; only what is found in them is shuffled to the URLs, never a body.
    """
    got = responses.where("phase = 'crawl'").withColumnRenamed("request_url", "url")
    status, tag = F.col("status"), lambda name: page_checks.header(F.col("headers"), name)
    rows = got.select(
        "site_id", "url", "status", "content_type", F.col("size").alias("size_bytes"), dates.rounded(F.col("duration_s")).alias("time_s"), "duration_s", "retries",
        F.when(status.between(300, 399), F.col("location")).otherwise("").alias("redirect_to"), page_checks.shown_error(status, F.col("retries"), F.col("error")).alias("error"),
        texts.status_text(status).alias("status_text"), F.coalesce(F.array_join(tag("X-Robots-Tag"), ", "), F.lit("")).alias("x_robots_tag"),
        page_checks.first_header(F.col("headers"), "Last-Modified").alias("last_modified"), F.map_filter("headers", lambda k, v: F.lower(k).isin("x-robots-tag", "last-modified", "date")).alias("headers"),
        F.when(status == 200, F.substring("body", 1, page_checks.PAGE_BYTES).cast("binary")).alias("body"),
    )
    rows = rows.withColumn("html", (status == 200) & texts.is_html(F.col("content_type"), F.col("body")))
    read = html_page.pages(rows.where("html"), config.robots.user_agent)
    plain = rows.where("NOT html").drop("body").withColumn("page", F.lit(None).cast(read.schema["page"].dataType))
    chosen = collect.first_seen(listed, config.crawl.max_urls).select("site_id", "url", "lastmod")
    x = chosen.join(read.unionByName(plain).dropDuplicates(["site_id", "url"]), ["site_id", "url"])
    x = x.withColumn("links", F.when(F.col("html"), page_checks.distinct_canonicals(F.col("page.canonicals"))))
    x = x.withColumn("link", F.when(F.size("links") == 1, F.get("links", F.lit(0))))
    x = x.withColumn("canonical", F.when(F.col("link").isNotNull(), page_checks.resolved(F.col("url"), F.col("link"))))
    x = keep(x, "crawl")
    t, html, page = config.thresholds, F.col("html"), F.col("page")
    ahead = page_checks.status_issues(status, F.col("retries"), F.col("error"), F.col("redirect_to"))
    after = found(
        page_checks.performance_issues(status, F.col("duration_s"), F.col("size_bytes"), t.slow_response, t.max_page_size),
        one_of(issue("CONTENT_NOT_HTML", (status == 200) & ~html, F.when(F.col("content_type") == "", "no Content-Type").otherwise(F.col("content_type")))),
        F.when(html, one_of(page_checks.soft_404_issue(page["title"], page["h1"], page["text_length"], t.soft_404_pattern, t.soft_404_min_text), page_checks.noindex_issue(page["meta_robots"], F.col("headers"), config.robots.user_agent))),
        F.when(html, page_checks.canonical_issues(F.col("url"), F.col("links"), F.col("canonical"))),
        F.when(html, one_of(page_checks.lastmod_issue(F.col("lastmod"), F.col("headers"), t.lastmod_tolerance))),
    )
    issues = [_crawl_issues(x, 6, ahead), _crawl_issues(x, 8, after)]
    ended = None
    if config.policy().group_enabled("redirects") and config.crawl.max_redirects:
        hops = responses.where(F.col("phase").isin("hop", "crawl")).select("site_id", "request_url", "status", F.when(F.col("status").between(300, 399), F.col("location")).otherwise("").alias("location"), "phase")
        hops = hops.groupBy("site_id", "request_url").agg(F.max_by(F.struct("status", "location"), F.col("phase")).alias("a")).select("site_id", "request_url", "a.*")
        ended = keep(redirects.chains(x.where("redirect_to <> ''"), hops, config.crawl.max_redirects, keep), "chains")
        issues.append(_crawl_issues(ended, 7, redirects.chain_issues(config.crawl.max_redirects)))
    out = x.select(
        "site_id", "url", F.lit(True).alias("crawled"), "status", "status_text", "redirect_to", "content_type", "error", "retries",
        *[F.coalesce(F.col(f"page.{c}"), F.lit("")).alias(c) for c in ("title", "h1")], F.coalesce("page.text_length", F.lit(0)).alias("text_length"),
        F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce(F.array_join("page.meta_robots", ", "), F.lit("")).alias("meta_robots"), "x_robots_tag", "last_modified", "size_bytes", "time_s",
    )
    if ended is None:
        out = out.withColumn("redirect_chain", F.array().cast(redirects.HOPS)).withColumn("final_status", F.lit(0))
    else:
        out = out.join(ended.select("site_id", "url", "redirect_chain", "final_status"), ["site_id", "url"], "left")
    return out, catalogue.union(issues)


def _crawl_issues(rows: DataFrame, stage: int, issues: Column) -> DataFrame:
    each = rows.select("site_id", "url", F.posexplode(issues).alias("pos", "issue"))
    return url_issues(each, stage, F.col("issue.code"), F.col("issue.message"), F.col("pos"))


#: What a URL has that wasn't crawled.
ABSENT = {"crawled": False, "status": 0, "status_text": "", "redirect_to": "", "content_type": "", "error": "", "retries": 0, "title": "", "h1": "", "text_length": 0, "canonical": "", "meta_robots": "", "x_robots_tag": "", "last_modified": "", "size_bytes": 0, "time_s": 0.0, "final_status": 0}


def audit(responses: DataFrame, sites: DataFrame, config: Config | None = None, now: datetime | None = None, all_sites: DataFrame | None = None, keep: Keep = written) -> Audit:
    """Audits sites (SITES) over their captured responses (RESPONSES).

    all_sites: the configured sites that define sections, if they are more than those audited. keep(): writes a table
    between stages and reads it back. Missing responses count as no answer; URLs without a captured answer stay
    uncrawled. Empty tables give empty tables.
    """
    spark, config, started = responses.sparkSession, config or Config(), now or datetime.now(UTC)
    policy: Policy = config.policy()
    moment = F.lit(started.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    responses = captured(responses)
    checks = ahead(spark, lambda: entry_checks.entry_columns(moment, config.sitemap.allowed_hosts, config.thresholds.news_max_age))
    documents = keep(parsed(responses, config.http.max_body_size), "documents")

    homes = discovery.home_pages(sites, responses)
    files = discovery.robots_files(sites, responses)
    lines = keep(robots_txt.numbered(robots_txt.lines(files.where("found").select("site_id", "body"))), "robots-lines")
    named = robots_txt.sitemaps(lines)
    rules = robots_txt.agent_rules(lines, config.robots.user_agent)
    roots, sources, located = discovery.discovered(sites, files, named, discovery.probes(documents), config.sitemap.fallbacks)
    visits = keep(walked(roots, documents, config.sitemap.max_depth), "visits")

    entries = keep(listed_entries(visits, checks()), "entries")
    configured = sites if all_sites is None else all_sites.unionByName(sites).dropDuplicates(["site_id"])
    placed = collect.in_sections(entries.where("whole"), configured)
    kept = keep(placed.where("section IS NULL"), "kept")
    listed = keep(collect.collect_urls(kept), "listed")

    def report(*issues: DataFrame) -> DataFrame | None:
        return keep(catalogue.reported(catalogue.union(list(issues)), spark, policy), "issues") if issues else None

    def of_files() -> tuple[DataFrame, DataFrame | None]:
        maps = sitemap_rows(visits).join(collect.file_counts(kept), ["site_id", "sm_order"], "left").na.fill(0, ["unique_urls", "duplicates_inside"])
        maps = keep(maps, "sitemaps")
        if not policy.group_enabled("duplicates"):
            return maps, None
        twice = one_of(issue("SITEMAP_DUPLICATE_ENTRIES", F.col("duplicates_inside") > 0, F.col("duplicates_inside"), " duplicate entries"))
        return maps, report(sitemap_issues(maps, 2, twice), collect.duplicate_issues(listed))

    def of_alternates() -> DataFrame | None:
        return report(collect.hreflang_issues(listed, keep(collect.alternates(kept), "alternates"))) if policy.group_enabled("hreflang") else None

    def of_variants() -> DataFrame | None:
        references = homes.select("site_id", F.col("reference_url").alias("reference"))
        return report(variants.variant_issues(listed, references, keep)) if policy.group_enabled("url_variants") else None

    def of_robots() -> DataFrame | None:
        own = rules.join(sites.select("site_id", urls.hostname(F.col("url")).alias("host")), "site_id")
        return report(robots_checks.robots_issues(listed.select("site_id", "url"), own.select("site_id", "host", "agent", "rules"))) if policy.enabled("ROBOTS_BLOCKED") else None

    def of_answers() -> tuple[DataFrame | None, DataFrame | None]:
        if not config.crawl.enabled:
            return None, None
        answers, found_ = crawl_results(listed, responses, config, keep)
        return answers, report(found_)

    # Plans of a few checks each, side by side: one plan of all would be optimised anew after each of its many stages.
    (answers, crawled), (maps, doubled), *others = side_by_side(
        spark, of_answers, of_files, of_variants,
        lambda: report(unrouted_issues(entries), collect.entry_issues(kept)),
        lambda: report(visit_issues(visits, config.sitemap.max_depth), index_entry_issues(visits, config, moment)),
        lambda: report(discovery.home_issues(homes), discovery.robots_issues(files, named), located),
        of_alternates, of_robots,
    )
    reported = catalogue.union([part for part in (crawled, doubled, *others) if part is not None])
    if answers is not None:
        rows = listed.join(answers, ["site_id", "url"], "left").na.fill(ABSENT)
    else:
        rows = listed
        for name, value in ABSENT.items():
            rows = rows.withColumn(name, F.lit(value))
        rows = rows.withColumn("redirect_chain", F.array().cast(redirects.HOPS))
    rows = rows.join(stats.url_severity(reported), ["site_id", "url"], "left").withColumn("max_severity", F.coalesce("max_severity", F.lit("")))
    robots = files.select("site_id", "robots_url", F.col("status").alias("robots_status"), F.col("found").alias("robots_found"))
    agents = rules.select("site_id", F.col("agent").alias("robots_group"), "crawl_delay")
    table = homes.drop("home_body").join(robots, "site_id").join(agents, "site_id", "left").join(sources, "site_id", "left")
    return Audit(table, maps, rows, reported, collect.exclusions(placed), catalogue.catalogue(spark, policy), config, started, now or datetime.now(UTC))


def exit_code(run: Audit) -> int:
    """1 if an issue is as bad as fail_on says, else 0."""
    least = catalogue.SEVERITIES.get(run.config.report.fail_on.lower(), 0)
    worst = run.issues.agg(F.max("sev_rank")).first()[0] or 0
    return int(bool(least) and worst >= least)


