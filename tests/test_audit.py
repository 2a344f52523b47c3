"""The whole plan over a made-up site."""

from datetime import UTC, datetime

import pytest

from crawlsight.plans import audit as plan
from crawlsight.sources.config import Config
from tests.helpers import JOURNAL, NURSERY, SITE, captured, plant_entries, response, responses, sites, urlset, web_page

NOW = datetime(2026, 4, 9, 8, 30, tzinfo=UTC)
LISTED = {e[0] if isinstance(e, tuple) else e for e in plant_entries(NURSERY)} - {"catalogue/old"} | {f"{NURSERY}/frost"}


def config():
    c = Config()
    c.sitemap.max_depth = 2
    c.thresholds.slow_response = 0.6
    c.thresholds.max_page_size = 200_000
    return c


def codes(issues, scope, target, site=SITE):
    return {r.code: r.message for r in issues if (r.site_id, r.scope, r.target) == (site, scope, target)}


@pytest.fixture(scope="module")
def run(spark):
    rows = captured() + captured(site=JOURNAL, home="/journal/")
    return plan.audit(responses(spark, rows), sites(spark, NURSERY, f"{NURSERY}/journal"), config(), NOW)


@pytest.fixture(scope="module")
def issues(run):
    return run.issues.collect()


@pytest.fixture(scope="module")
def urls(run):
    return {(r.site_id, r.url.removeprefix(NURSERY)): r for r in run.urls.collect()}


def test_sites(run, issues):
    """The home page twice, robots.txt, and where the sitemap was found."""
    rows = {r.site_id: r for r in run.sites.collect()}
    whole, journal = rows[SITE], rows[JOURNAL]
    assert (whole.home.status, whole.warm_up.status, journal.home.status) == (200, 307, 503)
    assert (whole.sitemap, whole.sitemap_source, whole.robots_found, whole.robots_group, whole.crawl_delay) == (f"{NURSERY}/maps/all.xml", "robots", True, "*", 4.0)
    assert set(codes(issues, "site", NURSERY)) == {"SITE_FIRST_VISIT_DIFFERS", "ROBOTS_SITEMAP_INVALID"}
    assert "SITE_HTTP_ERROR" in codes(issues, "site", f"{NURSERY}/journal", JOURNAL)


def test_sections(run, urls):
    """URLs below the journal are that site's own, and excluded from the whole one's."""
    assert [tuple(r[c] for c in ("site_id", "section_id", "prefix", "urls")) for r in run.excluded.collect()] == [(SITE, JOURNAL, "/journal", 3)]
    assert {u for s, u in urls if s == JOURNAL} == {"/journal/2024", "/journal/2025", "/journal/2026"}
    assert {u for s, u in urls if s == SITE} == {u.removeprefix(NURSERY) for u in LISTED}


FILES = {
    "all.xml": {"SITEMAP_LOC_INVALID"},
    "plants.xml": {"LOC_NOT_ABSOLUTE", "SITEMAP_DUPLICATE_ENTRIES", "SITEMAP_REPEAT"},
    "groups.xml": {"SITEMAP_NESTED_INDEX"},
    "sub.xml": {"SITEMAP_NESTED_INDEX", "SITEMAP_TOO_DEEP"},
    "journal.txt": set(),
    "post.xml.gz": set(),
    "torn.xml": {"SITEMAP_INVALID_XML", "SITEMAP_NAMESPACE"},
    "raw.xml.gz": {"SITEMAP_GZIP", "SITEMAP_EMPTY"},
    "lost.xml": {"SITEMAP_HTTP_ERROR"},
    "help.html": {"SITEMAP_NOT_SITEMAP"},
}


def test_files(run, issues):
    got = {name: set(codes(issues, "sitemap", f"{NURSERY}/maps/{name}")) - {"SITEMAP_INDEX_CYCLE"} for name in FILES}
    want = dict(FILES)
    assert got == want
    assert "SITEMAP_INDEX_CYCLE" in codes(issues, "sitemap", f"{NURSERY}/maps/all.xml")
    assert codes(issues, "sitemap", f"{NURSERY}/maps/plants.xml")["SITEMAP_DUPLICATE_ENTRIES"].startswith("2 ")


def test_walk(run):
    """In pre-order, an index's children where it names them."""
    rows = sorted((r for r in run.sitemaps.collect() if r.site_id == SITE), key=lambda r: r.sm_order)
    assert [(r.url.rpartition("/")[2], r.depth, r.kind) for r in rows] == [
        ("all.xml", 0, "index"), ("plants.xml", 1, "urlset"), ("groups.xml", 1, "index"), ("all.xml", 2, "cycle"), ("sub.xml", 2, "too-deep"), ("journal.txt", 2, "text"), ("plants.xml", 2, "repeat"),
        ("post.xml.gz", 1, "urlset"), ("torn.xml", 1, "urlset"), ("raw.xml.gz", 1, "urlset"), ("lost.xml", 1, "not-sitemap"), ("help.html", 0, "not-sitemap"),
    ]
    plants, post = rows[1], rows[7]
    assert (plants.entries, plants.unique_urls, plants.duplicates_inside) == (25, 22, 2)
    assert post.gzip and post.entries == 1


URL_CODES = {
    "/": set(),
    "/fern": {"HREFLANG_NOT_RECIPROCAL", "HREFLANG_ALTERNATE_UNLISTED"},
    "/nl/varen": set(),
    "/moss": {"LASTMOD_INVALID", "DUPLICATE_URL", "NEAR_DUPLICATE"},
    "/moss/": {"NEAR_DUPLICATE", "TRAILING_SLASH"},
    "/ivy": {"CHANGEFREQ_INVALID", "PRIORITY_INVALID"},
    "/palm": {"LASTMOD_FUTURE"},
    "/cart/list": {"ROBOTS_BLOCKED"},
    "/rose?gclid=7": {"TRACKING_PARAMS"},
    "/tulip bulbs": {"LOC_NOT_ENCODED"},
    "/cactus": {"LASTMOD_MISMATCH"},
    "/seeds.zip": {"CONTENT_NOT_HTML"},
    "/orchid": {"NOINDEX"},
    "/lily": {"NOINDEX"},
    "/daisy": {"CANONICAL_MISMATCH"},
    "/lotus": {"CANONICAL_INVALID"},
    "/reed": {"SOFT_404"},
    "/spring": {"URL_REDIRECT", "URL_REDIRECT_CHAIN"},
    "/winter": {"URL_REDIRECT", "URL_REDIRECT_LOOP"},
    "/autumn": {"URL_REDIRECT", "URL_REDIRECT_BROKEN"},
    "/catalogue": {"PAGE_TOO_LARGE"},
    "/greenhouse": {"SLOW_RESPONSE", "URL_RETRIED"},
    "/frost": {"NEWS_STALE"},
}


def test_url_issues(issues):
    got = {path: set(codes(issues, "url", NURSERY + path)) for path in URL_CODES}
    assert got == URL_CODES and {NURSERY + p for p in URL_CODES} == LISTED


def test_messages(issues):
    say = lambda path, code: codes(issues, "url", NURSERY + path)[code]
    b = NURSERY
    assert say("/spring", "URL_REDIRECT_CHAIN") == f"3 hops: {b}/spring -> {b}/spring/1 -> {b}/spring/2 -> {b}/fern"
    assert say("/cart/list", "ROBOTS_BLOCKED") == "Disallow: /cart/ (group *)"
    assert say("/moss", "DUPLICATE_URL") == f"listed 3 times in {b}/maps/plants.xml"
    assert say("/moss", "NEAR_DUPLICATE") == f"also listed as {b}/moss/"
    assert say("/greenhouse", "SLOW_RESPONSE") == "0.75s (threshold 600ms)"
    assert say("/cactus", "LASTMOD_MISMATCH") == "<lastmod> 2021-03-04, Last-Modified 2026-02-05T06:07:08Z"
    assert codes(issues, "sitemap", f"{b}/maps/plants.xml")["LOC_NOT_ABSOLUTE"].startswith("catalogue/old: ")


def test_urls(urls):
    """One row a URL, with what its answer says."""
    row = lambda path: urls[SITE, path]
    assert all(r.crawled for (s, _), r in urls.items() if s == SITE)
    assert (row("/spring").status, row("/spring").redirect_to, len(row("/spring").redirect_chain), row("/spring").final_status) == (308, f"{NURSERY}/spring/1", 3, 200)
    assert (row("/moss").occurrences, row("/moss").lastmod, row("/moss").max_severity) == (3, "2026-02-30", "warning")
    assert (row("/reed").title, row("/reed").text_length, row("/reed").status_text) == ("Reed", 4, "OK")
    assert (row("/daisy").canonical, row("/orchid").meta_robots, row("/orchid").h1) == (f"{NURSERY}/fern", "none", "Orchid")
    assert row("/fern").first_order == row("/").first_order < row("/frost").first_order


def test_exit_code(run):
    got = []
    for run.config.report.fail_on in ("none", "error", "warning", "notice"):
        got.append(plan.exit_code(run))
    assert got == [0, 1, 1, 1]


def audited(spark, rows, url, c=None):
    run = plan.audit(responses(spark, rows), sites(spark, url), c or config(), NOW)
    return run, run.issues.collect()


def test_without_crawl(spark):
    c = config()
    c.crawl.enabled = False
    run, issues = audited(spark, captured(), NURSERY, c)
    rows = run.urls.collect()
    assert not any(r.crawled for r in rows) and len(rows) == len(LISTED) + 3
    assert set(codes(issues, "url", f"{NURSERY}/cart/list")) == {"ROBOTS_BLOCKED"} and "NOINDEX" not in {i.code for i in issues}


def test_limit_and_policy(spark):
    c = config()
    c.crawl.max_urls = 2
    c.checks.groups = dict.fromkeys(("hreflang", "url_variants", "redirects"), False)
    c.checks.disable = ["LASTMOD_INVALID"]
    c.checks.severity = {"ROBOTS_BLOCKED": "notice"}
    run, issues = audited(spark, captured(), NURSERY, c)
    assert {r.url for r in run.urls.where("crawled").collect()} == {f"{NURSERY}/fern", f"{NURSERY}/nl/varen"}
    found = {r.code: r.severity for r in issues}
    assert found["ROBOTS_BLOCKED"] == "notice" and not [x for x in found if x.startswith(("HREFLANG", "URL_", "NEAR", "TRACK"))] and "LASTMOD_INVALID" not in found


def site_codes(issues):
    return {i.code for i in issues if i.scope == "site"}


def test_fallback(spark):
    """robots.txt names nothing; the first usual path is a web page, the second below the host's root a sitemap."""
    b, site = "http://tools.test", "tools.test/spades"
    rows = [
        response(site, "home", f"{b}/spades/", body=web_page("Spades")),
        response(site, "robots", f"{b}/robots.txt", body="User-agent: *\nAllow: /\n", kind="text/plain"),
        response(site, "sitemap", f"{b}/spades/sitemap.xml", body=web_page("Sitemap")),
        response(site, "sitemap", f"{b}/sitemap.xml", body=urlset(f"{b}/rakes", f"{b}/spades/long"), kind="text/xml"),
    ]
    run, issues = audited(spark, rows, f"{b}/spades")
    assert site_codes(issues) == {"ROBOTS_NO_SITEMAP", "SITEMAP_FALLBACK_ONLY"}
    assert run.sites.first().sitemap_source == "fallback" and [r.url for r in run.urls.collect()] == [f"{b}/spades/long"]


CLOSED = {
    "web pages everywhere": ([("home", "/", 200, web_page("x"), {}), ("robots", "/robots.txt", 200, web_page("x"), {}), ("sitemap", "/sitemap.xml", 200, web_page("x"), {})], {"ROBOTS_SOFT_404", "SITEMAP_SOFT_404", "SITEMAP_NOT_FOUND"}),
    "nothing but errors": ([("home", "/", 502, "", {}), ("robots", "/robots.txt", 404, "", {})], {"SITE_HTTP_ERROR", "ROBOTS_MISSING", "SITEMAP_NOT_FOUND"}),
    "a firewall": ([("home", "/", 403, "<p>ACCESS DENIED for you</p>", {})], {"SITE_WAF_BLOCK", "SITE_HTTP_ERROR", "ROBOTS_MISSING", "SITEMAP_NOT_FOUND"}),
    "no answer": ([("home", "/", 0, "", {"error": "connection refused"})], {"SITE_UNREACHABLE", "ROBOTS_MISSING", "SITEMAP_NOT_FOUND"}),
}


@pytest.mark.parametrize("name", CLOSED)
def test_closed_sites(spark, name):
    b, site = "http://closed.test", "closed.test"
    rows, want = CLOSED[name]
    _, issues = audited(spark, [response(site, phase, b + path, status, body, **more) for phase, path, status, body, more in rows], b)
    assert site_codes(issues) == want


def test_empty(spark):
    run = plan.audit(responses(spark, []), sites(spark), config(), NOW)
    assert [t.count() for t in (run.urls, run.sitemaps, run.issues, run.sites, run.excluded)] == [0] * 5
