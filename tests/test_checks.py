"""Checks of entries, files, variants, hreflang, sections, redirects and the walk on small tables."""

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import catalogue, collect, document_checks, entry_checks, page_checks, redirects, stats, tree, variants
from crawlsight.sources import sitemap_file
from crawlsight.storage import written
from tests.helpers import sites, values

E = sitemap_file.new_entry


def now():
    return F.lit("2024-02-28 23:15:00").cast("timestamp")


PORT = "https://harbour.test"
SHIPS = f"{PORT}/ships/"
FERRY = SHIPS + "ferry"


def entry(loc=None, raw=None, **more):
    return E(1) | ({"loc": loc, "raw_loc": loc if raw is None else raw, "has_loc": True} if loc is not None else {}) | more


def found(spark, entries, base=SHIPS + "list.xml", in_robots=False):
    rows = [(i, *e.values()) for i, e in enumerate(entries)]
    df = spark.createDataFrame(rows, f"n int, {sitemap_file.ENTRY}").withColumn("base", F.lit(base)).withColumn("in_robots", F.lit(in_robots))
    got = entry_checks.check_entries(df, entry_checks.entry_columns(now(), ["pictures.harbour.test"], 36 * 3600)).orderBy("n").select("issues").collect()
    return [[(i.code, i.message) for i in r.issues] for r in got]


#: By what an entry is given: the codes that it gets.
GIVEN = [
    ({"loc": FERRY, "lastmod": "2024-02-28T22:00:00-05:00", "changefreq": "never", "priority": "0"}, []),
    ({"loc": "ships/ferry"}, ["LOC_NOT_ABSOLUTE"]),
    ({"loc": FERRY, "raw": f"\t{FERRY} "}, ["LOC_WHITESPACE"]),
    ({"loc": SHIPS + "é"}, ["LOC_NOT_ENCODED"]),
    ({"loc": FERRY + "#deck"}, ["LOC_FRAGMENT"]),
    ({"loc": f"{FERRY}?{'t' * 2048}"}, ["LOC_TOO_LONG"]),
    ({"loc": FERRY + "x" * (2048 - len(FERRY))}, []),
    ({"loc": "https://www.harbour.test/ships/ferry"}, ["LOC_CROSS_HOST"]),
    ({"loc": "https://pictures.harbour.test/ships/ferry"}, []),
    ({"loc": f"{PORT}/docks"}, ["LOC_OUT_OF_SCOPE"]),
    ({"loc": f"{PORT}/shipsyard"}, ["LOC_OUT_OF_SCOPE"]),
    ({"loc": "hTTps://HARBOUR.test:443/ships/x"}, []),
    ({"loc": FERRY, "lastmod": "28-02-2024"}, ["LASTMOD_INVALID"]),
    ({"loc": FERRY, "lastmod": "2024-02-29"}, []),
    ({"loc": FERRY, "lastmod": "2024-03-02"}, ["LASTMOD_FUTURE"]),
    ({"loc": FERRY, "changefreq": "often", "priority": "1.01"}, ["CHANGEFREQ_INVALID", "PRIORITY_INVALID"]),
    ({"loc": FERRY, "priority": "top"}, ["PRIORITY_INVALID"]),
    ({"loc": FERRY + " a#b", "raw": f" {FERRY} a#b", "lastmod": "?"}, ["LOC_WHITESPACE", "LOC_NOT_ENCODED", "LOC_FRAGMENT", "LASTMOD_INVALID"]),
]


def test_entries(spark):
    got = found(spark, [entry(), *[entry(**g) for g, _ in GIVEN]])
    assert [code for code, _ in got[0]] == ["LOC_NOT_ABSOLUTE"]
    assert [(g, {code for code, _ in x}) for (g, _), x in zip(GIVEN, got[1:], strict=True)] == [(g, set(want)) for g, want in GIVEN]
    assert found(spark, [entry(f"{PORT}/docks")], in_robots=True) == [[]]  # a list that robots.txt names may hold any of the host's
    assert found(spark, [entry(f"{PORT}/docks")], base=f"{PORT}/list.xml") == [[]]


def test_images(spark):
    many = [{"loc": f"{SHIPS}{i}.jpg" if i % 2 else "i.jpg"} for i in range(1001)]
    got = found(spark, [entry(FERRY, images=many[:1000]), entry(FERRY, images=many), entry(FERRY, images=[])])
    assert [[code for code, _ in g] for g in got] == [["IMAGE_INVALID"] * 500, ["IMAGE_TOO_MANY"] + ["IMAGE_INVALID"] * 501, []]


FILM = {"thumbnail_loc": SHIPS + "f.png", "title": "Ferry", "description": "At sea", "player_loc": SHIPS + "play"}


@pytest.mark.parametrize(
    ("changes", "codes", "said"),
    [({}, [], ""), ({"duration": "28800", "rating": "0"}, [], ""), ({"title": ""}, ["VIDEO_MISSING_FIELD"], "without title"), ({"player_loc": "", "content_loc": SHIPS + "f.mp4"}, [], ""), ({"player_loc": ""}, ["VIDEO_MISSING_FIELD"], "content_loc or player_loc"),
     ({"thumbnail_loc": "f.png"}, ["VIDEO_INVALID"], '"f.png" is not absolute'), ({"duration": "28801"}, ["VIDEO_INVALID"], '"28801" (1-28800 seconds)'), ({"rating": "5.5"}, ["VIDEO_INVALID"], '"5.5" (0.0-5.0)'), ({"duration": "long", "rating": "-1"}, ["VIDEO_INVALID"] * 2, "")],
)
def test_videos(spark, changes, codes, said):
    [got] = found(spark, [entry(FERRY, videos=[{k: v for k, v in (FILM | changes).items() if v}])])
    assert [code for code, _ in got] == codes and (not said or said in got[0][1])


NEWS = {"name": "Harbour Times", "language": "da", "publication_date": "2024-02-28", "title": "Tide"}


def test_news(spark):
    cases = [({}, []), ({"title": "", "name": ""}, ["NEWS_MISSING_FIELD"]), ({"language": "danish"}, ["NEWS_INVALID"]), ({"language": "zh-tw"}, []), ({"publication_date": "today"}, ["NEWS_INVALID"]), ({"publication_date": "2024-02-27T11:14:59Z"}, ["NEWS_STALE"]), ({"publication_date": "2024-02-27T11:15:01Z"}, [])]
    got = found(spark, [entry(FERRY, news=[NEWS | c]) for c, _ in cases])
    assert [[code for code, _ in g] for g in got] == [want for _, want in cases]
    assert got[1][0][1] == "<news:news> without publication name, title" and got[5][0][1] == "published 2024-02-27T11:14:59Z"


def test_alternates(spark):
    link = lambda lang, path, rel="alternate": {"rel": rel, "hreflang": lang, "href": f"{PORT}{path}" if path[:1] == "/" else path}
    own = link("da", "/da")
    cases = [
        ([own, link("sv", "/sv"), link("x-default", "/")], []),
        ([link("sv", "/sv")], ["HREFLANG_NO_SELF"]),
        ([own, link("sv", "/sv"), link("SV", "/sv2")], ["HREFLANG_CONFLICT"]),
        ([own, link("sv", "/sv"), link("sv", "/sv#top")], []),
        ([own, link("da-UK", "/uk")], ["HREFLANG_INVALID"]),
        ([own, link("sv", "sv.html")], ["HREFLANG_INVALID"]),
        ([own, link("sv", "/sv", "next")], ["HREFLANG_INVALID"]),
        ([link("sv", "/sv"), link("sv", "/da")], ["HREFLANG_CONFLICT", "HREFLANG_NO_SELF"]),
    ]
    got = found(spark, [entry(f"{PORT}/da", alternates=links) for links, _ in cases], f"{PORT}/list.xml")
    assert [[code for code, _ in g] for g in got] == [want for _, want in cases]
    assert got[2][0][1] == f'hreflang "SV" points to {PORT}/sv and {PORT}/sv2' and got[1][0][1] == f"the alternates do not include {PORT}/da"


def test_index_entries(spark):
    part = f"{PORT}/part.xml"
    cases = [
        ({}, "SITEMAP_LOC_INVALID"), ({"loc": "/part.xml"}, "SITEMAP_LOC_INVALID"), ({"loc": part + "?" + "n" * 2030}, "SITEMAP_LOC_INVALID"), ({"loc": "https://files.harbour.test/part.xml"}, "SITEMAP_CROSS_HOST"), ({"loc": part}, None),
        ({"loc": part, "lastmod": "February"}, "SITEMAP_LASTMOD_INVALID"), ({"loc": part, "lastmod": "2024-03-01"}, "SITEMAP_LASTMOD_INVALID"), ({"loc": part, "lastmod": "2024-02"}, None),
    ]
    rows = [(i, c.get("loc", ""), c.get("loc", ""), "loc" in c, c.get("lastmod", ""), 1, f"{PORT}/index.xml") for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"n int, {sitemap_file.INDEX_ENTRY}, base string")
    got = [[i.code for i in r.issues] for r in entry_checks.check_index_entries(df, now()).orderBy("n").collect()]
    assert got == [[want] if want else [] for _, want in cases]


DOC = {"kind": "urlset", "namespace": sitemap_file.NAMESPACE, "entries": [E(1)]}
AT = {"url": f"{PORT}/list.xml"}
OTHER = {"kind": "not-sitemap"}
#: By how a file answered and what it holds: the codes that it gets.
DOCUMENTS = [
    *[(AT | {"content_type": kind}, DOC, [] if fine else ["SITEMAP_CONTENT_TYPE"]) for kind, fine in (("text/xml", True), ("Application/XML ; charset=x", True), ("", True), ("image/gif", False), ("xml", False))],
    *[(AT, DOC | {"encoding": name}, [] if fine else ["SITEMAP_ENCODING"]) for name, fine in (("utf-8", True), ("UTF8", True), ("koi8-r", False))],
    *[(AT, DOC | change, [code]) for change, code in ((({"xml_error": "line 3"}), "SITEMAP_INVALID_XML"), ({"namespace": "urn:x"}, "SITEMAP_NAMESPACE"), ({"invalid_utf8": True}, "SITEMAP_ENCODING"), ({"uncompressed": 1 + (50 << 20)}, "SITEMAP_TOO_LARGE"), ({"entries": []}, "SITEMAP_EMPTY"), ({"news_count": 1001}, "NEWS_TOO_MANY_URLS"))],
    *[(AT, DOC | {"uncompressed": 50 << 20, "news_count": 1000}, [])],
    *[(AT, OTHER | change, [code]) for change, code in (({}, "SITEMAP_NOT_SITEMAP"), ({"root": "feed"}, "SITEMAP_NOT_SITEMAP"), ({"root": "html", "looks_like_html": True}, "SITEMAP_NOT_SITEMAP"), ({"xml_error": "line 1"}, "SITEMAP_INVALID_XML"))],
    (AT | {"final_url": f"{PORT}/moved.xml"}, DOC, ["SITEMAP_REDIRECT"]),
    (AT | {"truncated": True}, DOC, ["SITEMAP_TOO_LARGE"]),
    ({"url": f"{PORT}/list.Xml.gZ?v=2"}, DOC, ["SITEMAP_GZIP"]),
    ({"url": f"{PORT}/list.xml.gz"}, DOC | {"gzip": True}, []),
    ({"url": f"{PORT}/list.xml.gz"}, OTHER | {"gzip": True, "gzip_error": "cut off"}, ["SITEMAP_GZIP"]),
    (AT, DOC | {"kind": "index", "entries": [], "sitemaps": [{"raw_loc": "", "loc": "", "has_loc": False, "lastmod": "", "line": 1}] * 50_001}, ["SITEMAP_TOO_MANY_URLS"]),
    (AT | {"content_type": "text/plain; charset=utf-8"}, {"kind": "text", "entries": [E(1)]}, []),
]


def test_documents(spark):
    empty = sitemap_file.parse(b"")
    rows = [(i, c["url"], c.get("final_url", c["url"]), c.get("content_type", ""), c.get("truncated", False), empty | {"kind": ""} | d) for i, (c, d, _) in enumerate(DOCUMENTS)]
    df = spark.createDataFrame(rows, f"n int, url string, final_url string, content_type string, truncated boolean, doc struct<{sitemap_file._NESTED(sitemap_file.DOCUMENT)}>")
    issues = document_checks.document_issues(*[F.col(c) for c in ("url", "final_url", "content_type", "truncated", "doc")])
    got = [[i.code for i in r.issues] for r in df.select("n", issues.alias("issues")).orderBy("n").collect()]
    assert got == [want for _, _, want in DOCUMENTS]


def variant_codes(spark, reference, addresses):
    listed = spark.createDataFrame([("s", u, (i,)) for i, u in enumerate(addresses)], "site_id string, url string, seen struct<n: int>")
    found = variants.variant_issues(listed, spark.createDataFrame([("s", reference)], "site_id string, reference string")).collect()
    return {u: {r.code: r.message for r in found if r.target == u} for u in addresses}


def test_variants(spark):
    w = "https://www.harbour.test"
    want = {
        f"{w}/": set(), f"{w}/quay": {"NEAR_DUPLICATE"}, f"{w}/quay/index.html": {"NEAR_DUPLICATE"}, "http://www.harbour.test/pier": {"HTTP_URL"}, "https://harbour.test/tug": {"HOST_VARIANT"}, "https://sail.test/": {"HOST_VARIANT"},
        f"{w}/crane/": {"TRAILING_SLASH"}, f"{w}/buoy?utm_campaign=a&size=2": {"TRACKING_PARAMS"}, f"{w}/dock?size=2": {"QUERY_PARAMS"}, f"{w}/Anchor": {"CASE_VARIANT"}, f"{w}/anchor": {"CASE_VARIANT"}, f"{w}/rope.zip": set(), "https://www.harbour.test:443/mast": {"NEAR_DUPLICATE"}, f"{w}/mast": {"NEAR_DUPLICATE"},
    }
    got = variant_codes(spark, f"{w}/", list(want))
    assert {u: set(c) for u, c in got.items()} == want
    assert "www / non-www" in got["https://harbour.test/tug"]["HOST_VARIANT"] and "other host" in got["https://sail.test/"]["HOST_VARIANT"]
    assert got[f"{w}/quay"]["NEAR_DUPLICATE"] == f"also listed as {w}/quay/index.html"


def test_slash_majority(spark):
    assert "2 of 3 URLs have one" in variant_codes(spark, "https://pier.test", ["https://pier.test/a/", "https://pier.test/b/", "https://pier.test/c"])["https://pier.test/c"]["TRAILING_SLASH"]
    assert not any(variant_codes(spark, "https://pier.test", ["https://pier.test/a/", "https://pier.test/b"]).values())


def test_many_duplicates(spark):
    got = variant_codes(spark, "https://pier.test", ["https://pier.test/x", "http://pier.test/x", "https://www.pier.test/x", "https://pier.test/x/", "https://pier.test/x/index.php", "not a url", "https://pier.test/q?" + "a=1&" * 40])
    assert got["https://pier.test/x"]["NEAR_DUPLICATE"] == "also listed as http://pier.test/x, https://www.pier.test/x, https://pier.test/x/ (+1 more)"
    assert got["not a url"] == {} and got["https://pier.test/q?" + "a=1&" * 40]["QUERY_PARAMS"].endswith("...")


def test_sections(spark):
    """Sites whose path lies below another site's of the host, www or not, are its sections."""
    addresses = [PORT, f"{PORT}/ships", f"{PORT}/ships/old/", "https://www.harbour.test/docks", f"{PORT}/shipsyard", "https://sail.test/ships"]
    got = {(r.site_id, r.section_prefix) for r in collect.sections_of(sites(spark, *addresses)).collect()}
    assert got == {("harbour.test", p) for p in ("/ships", "/ships/old", "/docks", "/shipsyard")} | {("harbour.test/ships", "/ships/old")}


def test_walk():
    # C is met too deep below E first; the later A to C is then a repeat, and y is never read.
    seen = tree.walk([("A", True)], {"A": ["D", "E", "C"], "E": ["C", "w"], "C": ["y"]}, 2)
    assert [(u, v) for _, u, _, _, v, _ in seen] == [("A", "read"), ("D", "read"), ("E", "read"), ("C", "too-deep"), ("w", "read"), ("C", "repeat")]
    loop = tree.walk([("A", True), ("B", False)], {"A": ["B", "A"], "B": ["A"]}, 5)
    assert [(u, v, r) for _, u, _, _, v, r in loop] == [("A", "read", True), ("B", "read", True), ("A", "cycle", True), ("A", "cycle", True), ("B", "repeat", False)]
    assert tree.walk([("A", True)], {"A": ["B"]}, 0)[0][4] == "too-deep"


def chain(spark, hops, limit=3, start="https://pier.test/0"):
    table = spark.createDataFrame([("s", u, s, to) for u, s, to in hops], "site_id string, request_url string, status int, location string")
    starts = spark.createDataFrame([("s", start, hops[0][0])], "site_id string, url string, redirect_to string")
    got = redirects.chains(starts, table, limit, written).withColumn("issues", redirects.chain_issues(limit)).first()
    return got.end, got.final_status, [(i.code, i.message) for i in got.issues]


def test_redirects(spark):
    u = "https://pier.test/%d"
    assert chain(spark, [(u % 1, 200, "")]) == ("answer", 200, [])
    assert chain(spark, [(u % 1, 301, u % 2), (u % 2, 404, "")]) == ("answer", 404, [("URL_REDIRECT_CHAIN", "2 hops: https://pier.test/0 -> https://pier.test/1 -> https://pier.test/2"), ("URL_REDIRECT_BROKEN", "ends on https://pier.test/2 (404)")])
    assert chain(spark, [(u % 1, 301, "https://PIER.test/0#x")])[::2] == ("loop", [("URL_REDIRECT_LOOP", "back to https://PIER.test/0#x after 2 hops")])
    assert chain(spark, [(u % i, 302, u % (i + 1)) for i in range(1, 6)])[::2] == ("limit", [("URL_REDIRECT_BROKEN", "more than 3 hops")])
    assert chain(spark, [("http://pier.test/x", 200, "")]) == ("answer", 200, [("URL_REDIRECT_DOWNGRADE", "https://pier.test/0 -> http://pier.test/x")])
    assert chain(spark, [(u % 1, 302, u % 9)])[1:] == (0, [("URL_REDIRECT_CHAIN", "2 hops: https://pier.test/0 -> https://pier.test/1 -> https://pier.test/9"), ("URL_REDIRECT_BROKEN", "ends on https://pier.test/9 (000)")])


def test_headers(spark):
    df = spark.createDataFrame([({"X-Robots-Tag": ["a", "b"], "date": ["d"]},), ({},), (None,)], "h map<string, array<string>>")
    got = df.select(page_checks.header(F.col("h"), "x-robots-tag").alias("x"), page_checks.first_header(F.col("h"), "Date").alias("d")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], "d"), (None, ""), (None, "")]
    assert [page_checks.seconds_text(s) for s in (0.1, 3, 90, 3600, 1.5)] == ["100ms", "3s", "1m30s", "1h0m0s", "1.5s"]


def test_canonical(spark):
    df = spark.createDataFrame([(0, "https://pier.test/a/b", "../c"), (1, "https://pier.test/a/b", "//o.org/x"), (2, "https://pier.test/a/b", "https://pier.test/ü"), (3, "https://pier.test/a/b", "http://[bad")], "n int, u string, l string")
    got = [r[0] for r in df.select("n", page_checks.resolved(F.col("u"), F.col("l")).alias("r")).orderBy("n").select("r").collect()]
    assert got == ["https://pier.test/c", "https://o.org/x", "https://pier.test/%C3%BC", None]


def test_catalogue(spark):
    rows = catalogue.catalogue(spark).collect()
    assert len(rows) == len({r.code for r in rows}) == 79 and {r.grp for r in rows} == set(catalogue.GROUPS)
    policy = catalogue.Policy({"site": False}, frozenset({"NOINDEX"}), {"SOFT_404": "notice"})
    assert not policy.enabled("SITE_UNREACHABLE") and not policy.enabled("NOINDEX") and not policy.enabled("NO_SUCH") and policy.severity("SOFT_404") == "notice"


def test_counts(spark):
    issues = spark.createDataFrame([("s", "url", "u1", [1], "A", "error", 3), ("s", "url", "u1", [0], "B", "notice", 1), ("s", "url", "u2", [0], "B", "notice", 1)], "site_id string, scope string, target string, seq array<bigint>, code string, severity string, sev_rank int")
    assert {r.url: r.max_severity for r in stats.url_severity(issues).collect()} == {"u1": "error", "u2": "notice"}
    assert stats.max_severity(issues).first()[0] == "error" and stats.max_severity(issues.limit(0)).first()[0] == ""
    known = spark.createDataFrame([("A", "Title")], "code string, title string")
    assert [(r.code, r.n, r.title) for r in stats.summary(issues, known).collect()] == [("A", 1, "Title"), ("B", 2, "B")]
    assert [r.code for r in stats.by_severity(issues).collect()] == ["A", "B", "B"]


@pytest.mark.parametrize("n", [0, 2])
def test_first_seen(spark, n):
    listed = spark.createDataFrame([("s", f"u{i}", (3 - i,)) for i in range(3)], "site_id string, url string, seen struct<n: int>")
    assert sorted(r.url for r in collect.first_seen(listed, n).collect()) == (["u1", "u2"] if n else ["u0", "u1", "u2"])


def test_robots_target(spark):
    from crawlsight.operators.robots_checks import target

    cases = {"https://pier.test": "/", "https://pier.test?x": "/?x", "https://pier.test/a?": "/a", "https://pier.test/a?b?": "/a?b?", "https://pier.test/a b?c#d": "/a%20b?c", "https://pier.test/#x": "/"}
    got = values(spark, [(u,) for u in cases], "u string", t=target(F.col("u")))
    assert [g[0] for g in got] == list(cases.values())
