"""Sitemap files, HTML pages, robots.txt."""

import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlsight.functions import urls
from crawlsight.sources import html_page, robots_txt, sitemap_file
from crawlsight.sources.sitemap_file import NAMESPACE, parse
from tests.helpers import values

MUSEUM = f"""<?xml version='1.0' encoding='utf-8'?>
<urlset xmlns="{NAMESPACE}" xmlns:p="urn:pictures" xmlns:f="urn:films" xmlns:n="urn:news" xmlns:h="urn:links">
 <url><priority>0.30</priority><loc>
   https://museum.test/hall?floor=2&amp;room=7   </loc>
  <lastmod>
2019-11-05T06:07+02:00</lastmod><changefreq> yearly </changefreq>
  <p:image><p:caption>c</p:caption><p:loc> https://museum.test/vase.webp </p:loc></p:image><p:image/>
  <f:video><f:rating>3.5</f:rating><f:title>Tour &lt;1&gt;</f:title></f:video>
  <n:news><n:title>Opening</n:title><n:publication><n:language>pt</n:language><n:name>Gazette</n:name></n:publication><n:publication_date>2026-04-01</n:publication_date></n:news>
  <h:link hreflang="pt-BR" href="https://museum.test/sala" rel="alternate"/><h:link href="x"/></url>
 <url><loc><![CDATA[https://museum.test/a&b]]></loc></url>
 <url><lastmod>2020</lastmod></url>
</urlset>"""


def test_urlset():
    doc = parse(MUSEUM.encode())
    assert (doc["kind"], doc["namespace"], doc["encoding"].upper(), doc["xml_error"], doc["news_count"], doc["gzip"]) == ("urlset", NAMESPACE, "UTF-8", "", 1, False)
    hall, plain, empty = doc["entries"]
    assert (hall["loc"], hall["lastmod"], hall["changefreq"], hall["priority"]) == ("https://museum.test/hall?floor=2&room=7", "2019-11-05T06:07+02:00", "yearly", "0.30")
    assert hall["raw_loc"].strip() == hall["loc"] != hall["raw_loc"]
    assert [x["loc"] for x in hall["images"]] == ["https://museum.test/vase.webp", ""] and hall["videos"] == [{"rating": "3.5", "title": "Tour <1>"}]
    assert hall["news"] == [{"name": "Gazette", "language": "pt", "publication_date": "2026-04-01", "title": "Opening"}]
    assert [x["href"] for x in hall["alternates"]] == ["https://museum.test/sala", "x"] and hall["alternates"][0]["hreflang"] == "pt-BR"
    assert plain["loc"] == "https://museum.test/a&b" and (empty["has_loc"], empty["lastmod"], empty["line"]) == (False, "2020", 12)


def maps_index(n):
    """An index of n files, every third without an address."""
    parts = "".join(f"<sitemap>{'' if i % 3 == 2 else f'<loc>https://museum.test/part-{i}.xml</loc>'}<lastmod>2026-0{i % 9 + 1}-01</lastmod></sitemap>" for i in range(n))
    return f'<sitemapindex xmlns="{NAMESPACE}">{parts}</sitemapindex>'.encode()


@pytest.mark.parametrize("n", [1, 7, 40])
def test_index_and_gzip(n):
    plain, packed = maps_index(n), gzip.compress(maps_index(n))
    doc = parse(packed)
    assert (doc["kind"], doc["gzip"], doc["uncompressed"], doc["truncated"], doc["gzip_error"]) == ("index", True, len(plain), False, "")
    assert [(x["loc"], x["has_loc"]) for x in doc["sitemaps"]] == [("", False) if i % 3 == 2 else (f"https://museum.test/part-{i}.xml", True) for i in range(n)]
    assert doc["sitemaps"] == parse(plain)["sitemaps"]
    half = len(plain) // 2
    assert parse(gzip.compress(plain[:half]) + gzip.compress(plain[half:]))["sitemaps"] == doc["sitemaps"]  # members one after the other
    assert parse(packed, half)["truncated"] and not parse(packed, len(plain))["truncated"]


@pytest.mark.parametrize("cut", [2, 9, 20, -1])
def test_damaged_gzip(cut):
    doc = parse(gzip.compress(maps_index(30))[:cut])
    assert doc["gzip"] and doc["gzip_error"]


ODD = {
    "two addresses and blank lines": (b"\r\nhttp://museum.test/1\r\n \r\n\thttps://museum.test/2", "text", 2),
    "an address and a word": (b"https://museum.test/1\nclosed\n", "not-sitemap", 0),
    "a feed": (b'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"/>', "not-sitemap", 0),
    "a page": (b"<html lang=nl><title>Museum</title>", "not-sitemap", 0),
    "JSON": (b'{"urls": ["https://museum.test/"]}', "not-sitemap", 0),
    "a prefixed root": (f'<s:urlset xmlns:s="{NAMESPACE}"><s:url><s:loc>https://museum.test/s</s:loc></s:url></s:urlset>'.encode(), "urlset", 1),
    "a mark of byte order": (f'<urlset xmlns="{NAMESPACE}"><url><loc>https://museum.test/m</loc></url></urlset>'.encode("utf-8-sig"), "urlset", 1),
    "a bare ampersand in the second of three": (b"<urlset><url><loc>https://museum.test/1</loc></url><url><loc>https://museum.test/?p=1&q</loc></url><url/></urlset>", "urlset", 1),
    "no end": (b"<urlset><url><loc>https://museum.test/1</loc></url>", "urlset", 1),
    "a prefix that nothing declares": (b"<urlset><url><loc>https://museum.test/1</loc><video:video><video:title>v</video:title></video:video></url></urlset>", "urlset", 1),
    "nothing": (b"", "not-sitemap", 0),
}


def test_odd_files():
    docs = {name: parse(body) for name, (body, _, _) in ODD.items()}
    assert {name: (d["kind"], len(d["entries"])) for name, d in docs.items()} == {name: (kind, n) for name, (_, kind, n) in ODD.items()}
    assert docs["a feed"]["root"] == "feed" and docs["a page"]["looks_like_html"] and not docs["JSON"]["looks_like_html"]
    assert [e["line"] for e in docs["two addresses and blank lines"]["entries"]] == [1, 3]  # counted from the first that isn't blank
    assert "&amp;" in docs["a bare ampersand in the second of three"]["xml_error"] and docs["no end"]["xml_error"]
    assert docs["a prefix that nothing declares"]["xml_error"] == "" and docs["a prefix that nothing declares"]["entries"][0]["videos"] == [{"title": "v"}]
    assert parse(None) == parse(b"")


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "windows-1252"])
def test_encodings(encoding):
    doc = parse(f'<?xml version="1.0" encoding="{encoding}"?><urlset><url><loc>https://museum.test/grün</loc></url></urlset>'.encode(encoding))
    assert doc["encoding"] == encoding and doc["invalid_utf8"] and doc["entries"][0]["loc"].startswith("https://museum.test/gr")


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.text(alphabet="<>/&;urlsetindexloc \n\"'=:x", max_size=300).map(str.encode)))
def test_any_bytes_have_a_kind(data):
    assert parse(data)["kind"] in ("urlset", "index", "text", "not-sitemap")


def test_documents(spark):
    df = spark.createDataFrame([(1, bytearray(MUSEUM.encode())), (2, None)], "n int, body binary")
    got = {r.n: r for r in sitemap_file.documents(df).collect()}
    assert len(got[1].doc.entries) == 3 and got[1].doc.entries[0].videos == [{"rating": "3.5", "title": "Tour <1>"}] and got[2].doc.kind == "not-sitemap"
    assert sitemap_file.documents(df.limit(0)).count() == 0


BAKERY = """<HTML><HEAD><META NAME='Robots' CONTENT='NoArchive'>
<meta content="noindex" name=otherbot><meta name="Crawlbot" content="none"><meta name="description" content="d">
<script>if (1 < 2) document.write("<title>No</title><h1>No</h1>")</script>
<title>Rye &amp; wheat
 bread</title><title>Second</title>
<link href="/bread " rel="alternate CANONICAL"><link rel=icon href=/i.png><link rel=canonical href=https://bakery.test/b>
</HEAD><BODY class=x><noscript>Turn it on</noscript>
<svg viewBox="0 0 1 1"><h1>Drawing</h1><text>drawn</text></svg>
<!-- <h1>Never</h1> -- > still a comment -->
<H1>Our<br>daily <em>bread</em></H1><h1>Again</h1>
<ul><li>rye<li>oat</ul><template><p>copy</p></template>
fresh&#160;&#x2014;&nbsp;warm<style>p { color: brown }</style>
<link rel="canonical" href="/late"></BODY></HTML>"""


def test_page():
    info = html_page.analyze(BAKERY.encode(), " CRAWLBOT ")
    assert info["title"] == "Rye & wheat bread" and info["h1"] == "Our daily bread"
    assert info["meta_robots"] == ["NoArchive", "none"] and html_page.analyze(BAKERY.encode())["meta_robots"] == ["NoArchive"]
    assert info["canonicals"] == ["/bread", "https://bakery.test/b"]
    assert info["text_length"] == len("Ourdaily bread Again rye oat fresh — warm") + 1  # br separates


SHORT = {
    b"": 0, b"just words": 10, b"<title>t</title>": 0, b"<head>hidden</head>shown": 5, b"<div>a</div><span>b</span>c": 5, b"1 < 2 & 3 > 2": 13, b"<p>x<!-- to the end": 1, b"<p>x<b": 1, b"a<br/>b<br>c": 5,
    "<p>žluť</p>".encode(): 4, b"\xff\xfe": 2, b"<svg><p>in</p>": 0, b"<svg/>out": 3, b"<textarea>typed &amp; shown</textarea>": 13, b"</nothing>x</nothing>": 1,
}


def test_text_lengths():
    assert {page: html_page.analyze(page)["text_length"] for page in SHORT} == SHORT
    assert html_page.analyze(None) == html_page.analyze(b"") == {"title": "", "h1": "", "text_length": 0, "meta_robots": [], "canonicals": []}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ahp1 \"'=&;scripttitle", max_size=200))
def test_any_page(text):
    assert html_page.analyze(text.encode())["text_length"] >= 0


LIBRARY = """\ufeffSitemap: https://library.test/maps/books.xml
# for everyone
USER-AGENT : *
Crawl-Delay: 0.5
Disallow: /desk
Allow: /desk/hours$
Disallow: /*/draft

User-Agent: archivist
User-Agent: Curator/3.2
Crawl-delay: 12
Disallow: /stacks/
Allow: /stacks/open
Disallow:

User-Agent: archivist-images
Disallow: /*.tiff$
 sitemap :https://library.test/maps/films.xml#films
"""


def numbered(spark, text):
    body = bytearray(text if isinstance(text, bytes) else text.encode())
    return robots_txt.numbered(robots_txt.lines(spark.createDataFrame([("s", body)], "site_id string, body binary")))


def allowed(spark, text, agent, paths):
    rules = robots_txt.agent_rules(numbered(spark, text), agent).first()
    found = [] if rules is None else rules.rules
    schema = "path string, rules array<struct<rule_no: int, allow: boolean, raw: string, pattern: string, regex: string>>"
    got = values(spark, [(p, found) for p in paths], schema, v=robots_txt.verdict(F.col("path"), F.col("rules")))
    return {p: (v[0].allowed, v[0].rule) for p, v in zip(paths, got, strict=True)}


def test_groups(spark):
    rows = numbered(spark, LIBRARY.replace("\n", "\r\n"))
    assert [r.url for r in robots_txt.sitemaps(rows).orderBy("line_no").collect()] == ["https://library.test/maps/books.xml", "https://library.test/maps/films.xml"]
    groups = {"Reader 1.0": ("*", 0.5), "Archivist/9 (+https://library.test)": ("archivist", 12.0), "curator": ("curator", 12.0), "archivist-images": ("archivist-images", None), "archivist-films": ("archivist", 12.0)}
    got = {agent: robots_txt.agents(rows, agent).first() for agent in groups}
    assert {agent: (r.agent, r.crawl_delay) for agent, r in got.items()} == groups


def test_allowed(spark):
    want = {
        "*": {"/desk": (False, "Disallow: /desk"), "/desks": (False, "Disallow: /desk"), "/desk/hours": (True, "Allow: /desk/hours$"), "/desk/hours?day=1": (False, "Disallow: /desk"), "/a/draft1": (False, "Disallow: /*/draft"), "/draft": (True, ""), "": (True, "")},
        "curator": {"/desk": (True, ""), "/stacks/9": (False, "Disallow: /stacks/"), "/stacks/open/9": (True, "Allow: /stacks/open"), "/stacks": (True, "")},
        "archivist-images": {"/scan.tiff": (False, "Disallow: /*.tiff$"), "/scan.tiff/1": (True, ""), "/stacks/9": (True, "")},
    }
    for agent, paths in want.items():
        assert allowed(spark, LIBRARY, agent, list(paths)) == paths
    assert allowed(spark, LIBRARY, "*", ["/robots.txt"])["/robots.txt"][0]


#: The examples of the protocol's public documentation, then others.
MATCHES = [
    ("/fish", "/fish.html", True), ("/fish", "/Fish", False), ("/*.php", "/filename.php/", True), ("/*.php$", "/filename.php?q", False), ("/fish*.php", "/fish/salmon.php", True),
    ("/", "/anything", True), ("/x$", "/x", True), ("/x$", "/xx", False), ("/x$y", "/x$yz", True), ("/*7*9", "/a7b8c9", True), ("/*7*9", "/a9b7", False), ("/**z", "/z", True), ("/q?*=", "/q?a=1", True), ("/q?*=", "/qqa=1", False),
    ("/[a]", "/[a]b", True), ("/[a]", "/a", False), ("/p|q", "/p", False), ("word", "/word", True), ("*word", "/a/word", True),
]


def test_match(spark):
    pattern = urls.robots_pattern(F.col("p"))
    got = values(spark, MATCHES, "p string, path string, want boolean", m=urls.robots_matches(F.col("path"), pattern, urls.robots_regex(pattern)))
    assert [g[0] for g in got] == [w for _, _, w in MATCHES]


def by_hand(pattern, path):
    """Wildcards tried one character after the other."""
    ends = pattern.endswith("$")
    parts = (pattern[:-1] if ends else pattern).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    for i, part in enumerate(parts[1:], 2):
        found = path.rfind(part) if ends and i == len(parts) else path.find(part, at)
        if found < at:
            return False
        at = found + len(part)
    return not ends or at == len(path)


def test_match_at_random(spark):
    rng = random.Random(6)
    word = lambda letters, n: "/" + "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    cases = [(word("ab*", 5) + rng.choice(["", "", "$"]), word("ab", 6)) for _ in range(400)]
    pattern = urls.robots_pattern(F.col("p"))
    got = values(spark, cases, "p string, path string", m=urls.robots_matches(F.col("path"), pattern, urls.robots_regex(pattern)))
    assert [g[0] for g in got] == [by_hand(p, path) for p, path in cases]


def test_longest_rule(spark):
    text = "User-agent: *\nDisallow: /m\nAllow: /m\nAllow: /n/*\nDisallow: /n/secret\nDisallow: /o*\nAllow: /o.txt$\n"
    assert {p: v[0] for p, v in allowed(spark, text, "x", ["/m", "/n/open", "/n/secret", "/o.txt", "/o.txt2"]).items()} == {"/m": True, "/n/open": True, "/n/secret": False, "/o.txt": True, "/o.txt2": False}


def test_odd_lines(spark):
    odd = "user-agent:*\nDISALLOW:/straße\nDisallow: /b%2fc\nthis is no rule\nHost: x\nCrawl-delay: soon\nDisallow: shelf\n"
    assert not any(v[0] for v in allowed(spark, odd, "bot", ["/stra%C3%9Fe/1", "/b%2Fc", "/shelf/2"]).values())
    assert robots_txt.agents(numbered(spark, odd), "bot").first().crawl_delay is None
    early = "Disallow: /\nAllow: /p\nUser-agent: *\nDisallow: /q\n"  # rules before any group hold for nobody
    assert allowed(spark, early, "bot", ["/r", "/q"]) == {"/r": (True, ""), "/q": (False, "Disallow: /q")}
    assert allowed(spark, "", "bot", ["/r"]) == {"/r": (True, "")}
    latin = "User-agent: *\nDisallow: /shut\n# naïve\n".encode("latin-1")
    assert not allowed(spark, latin, "bot", ["/shut"])["/shut"][0]


def test_size_limit(spark):
    fill = "# " + "-" * 97 + "\n"
    text = "User-agent: *\nDisallow: /early\n" + fill * (robots_txt.MAX_SIZE // len(fill) + 1) + "Disallow: /late\n"
    assert {p: v[0] for p, v in allowed(spark, text, "bot", ["/late", "/early"]).items()} == {"/late": True, "/early": False}


@pytest.mark.parametrize("text", ["User-agent", "user agent", "useragent"])
def test_spellings(spark, text):
    assert not allowed(spark, f"{text}: *\nDissallow: /x", "bot", ["/x"])["/x"][0]
