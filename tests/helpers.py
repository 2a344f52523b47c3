"""Small tables for tests, and the made-up site of a plant nursery as a crawl would have captured it."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from crawlsight.sources.schemas import RESPONSES, SITES


def values(spark, cases, schema, **columns):
    """What column expressions give for rows, one tuple a row, in the rows' order."""
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, " + schema)
    rows = df.select("n", *[c.alias(k) for k, c in columns.items()]).orderBy("n").collect()
    return [tuple(r)[1:] for r in rows]


def one(spark, cases, make, kind="string"):
    """make(column) for each single value."""
    return [v[0] for v in values(spark, [(c,) for c in cases], f"v {kind}", out=make(F.col("v")))]


NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
XHTML = "http://www.w3.org/1999/xhtml"
NURSERY, SITE = "https://plants.nursery.test", "plants.nursery.test"
JOURNAL = f"{SITE}/journal"


def web_page(title, head="", words=25):
    """A page with so many times five words."""
    return f"<html><head><title>{title}</title>{head}</head><body><h1>{title}</h1><p>{'soil water light seed pot ' * words}</p></body></html>"


def index(*locs):
    return f'<sitemapindex xmlns="{NS}">' + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def urlset(*entries):
    """(loc, more XML) or loc of each entry."""
    pairs = [e if isinstance(e, tuple) else (e, "") for e in entries]
    return f'<urlset xmlns="{NS}" xmlns:xhtml="{XHTML}">' + "".join(f"<url><loc>{loc}</loc>{more}</url>" for loc, more in pairs) + "</urlset>"


def alternates(**hrefs):
    return "".join(f'<xhtml:link rel="alternate" hreflang="{lang.replace("_", "-")}" href="{href}"/>' for lang, href in hrefs.items())


def plant_entries(b):
    """What the nursery lists, with the faults of its entries."""
    fern = alternates(en=f"{b}/fern", nl=f"{b}/nl/varen", pt=f"{b}/pt/samambaia")
    return [
        (f"{b}/fern", "<priority>0.7</priority>" + fern),
        (f"{b}/nl/varen", alternates(nl=f"{b}/nl/varen")),
        (f"{b}/moss", "<lastmod>2026-02-30</lastmod>"), f"{b}/moss", f"{b}/moss", f"{b}/moss/",
        (f"{b}/ivy", "<changefreq>fortnightly</changefreq><priority>-1</priority>"),
        (f"{b}/palm", "<lastmod>2031-05-06T07:08:09Z</lastmod>"),
        f"{b}/cart/list", f"{b}/rose?gclid=7", f"{b}/tulip bulbs",
        (f"{b}/cactus", "<lastmod>2021-03-04</lastmod>"),
        f"{b}/seeds.zip", f"{b}/orchid", f"{b}/lily", f"{b}/daisy", f"{b}/lotus", f"{b}/reed",
        f"{b}/spring", f"{b}/winter", f"{b}/autumn", f"{b}/catalogue", f"{b}/greenhouse", f"{b}/", "catalogue/old",
    ]


#: Lists of the nursery by path: body, Content-Type, status.
def lists(b):
    late = f'<news:news xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><news:publication><news:name>Nursery post</news:name><news:language>nl</news:language></news:publication><news:publication_date>2025-12-24</news:publication_date><news:title>Frost</news:title></news:news>'
    return {
        "/maps/all.xml": (index(*[f"{b}/maps/{x}" for x in ("plants.xml", "groups.xml", "post.xml.gz", "torn.xml", "raw.xml.gz", "lost.xml")], "news.xml"), "text/xml", 200),
        "/maps/groups.xml": (index(*[f"{b}/maps/{x}" for x in ("all.xml", "sub.xml", "journal.txt", "plants.xml")]), "text/xml", 200),
        "/maps/sub.xml": (index(f"{b}/maps/unread.xml"), "text/xml", 200),
        "/maps/plants.xml": (urlset(*plant_entries(b)), "text/xml", 200),
        "/maps/post.xml.gz": (gzip.compress(urlset((f"{b}/frost", late)).encode()), "application/x-gzip", 200),
        "/maps/raw.xml.gz": (urlset(), "text/xml", 200),
        "/maps/torn.xml": (f'<urlset xmlns="urn:other"><url><loc>{b}/basket?x=1&y=2</loc></url></urlset>', "text/xml", 200),
        "/maps/journal.txt": (f"{b}/journal/2026\n{b}/journal/2025\n{b}/journal/2024\n", "text/plain", 200),
        "/maps/lost.xml": ("", "text/html", 410),
        "/maps/help.html": (web_page("Help"), "text/html", 200),
    }


def answers(b):
    """What the nursery's pages answer: (status, body, and whatever else differs)."""
    robots, link = '<meta name="Robots" content="none">', lambda *to: "".join(f'<link rel="canonical" href="{x}">' for x in to)
    plain = ("/", "/fern", "/nl/varen", "/moss", "/moss/", "/ivy", "/palm", "/cart/list", "/rose?gclid=7", "/tulip bulbs", "/frost", "/journal/2026", "/journal/2025", "/journal/2024")
    return {p: (200, web_page(p), {}) for p in plain} | {
        "/seeds.zip": (200, "PK", {"kind": "application/zip"}),
        "/cactus": (200, web_page("Cactus"), {"headers": {"Last-Modified": ["Thu, 05 Feb 2026 06:07:08 GMT"]}}),
        "/orchid": (200, web_page("Orchid", robots), {}),
        "/lily": (200, web_page("Lily"), {"headers": {"X-ROBOTS-TAG": ["Googlebot: noindex, nofollow"]}}),
        "/daisy": (200, web_page("Daisy", link("/fern")), {}),
        "/lotus": (200, web_page("Lotus", link("/lotus", "/lily")), {}),
        "/reed": (200, "<title>Reed</title><p>soon", {}),
        "/catalogue": (200, web_page("Catalogue", words=9000), {}),
        "/greenhouse": (200, web_page("Greenhouse"), {"duration_s": 0.75, "retries": 2}),
        "/spring": (308, "", {"location": f"{b}/spring/1"}),
        "/winter": (302, "", {"location": f"{b}/winter/1"}),
        "/autumn": (301, "", {"location": f"{b}/autumn/1"}),
    }


def hops(b):
    """Three hops to a page, a ring of two, and one that ends on an error."""
    return {"/spring/1": (302, f"{b}/spring/2"), "/spring/2": (301, f"{b}/fern"), "/fern": (200, ""), "/winter/1": (302, f"{b}/winter"), "/autumn/1": (500, "")}


def captured(b=NURSERY, site=SITE, home="/"):
    """Rows of RESPONSES of the nursery, as the whole site or its journal saw it."""
    text = f"Sitemap: {b}/maps/all.xml\n\nUser-agent: *\nCrawl-delay: 4\nDisallow: /cart/\n\nSitemap: {b}/maps/help.html\n"
    rows = [response(site, "robots", f"{b}/robots.txt", kind="text/plain", body=text)]
    rows += [response(site, "sitemap", b + p, status, body, kind) for p, (body, kind, status) in lists(b).items()]
    if home == "/":
        rows.append(response(site, "warm_up", f"{b}/", body=web_page("Choose a country"), primary_status=307, primary_location=f"{b}/country", final_url=f"{b}/country"))
        rows.append(response(site, "home", f"{b}/", body=web_page("Nursery")))
    else:
        rows += [response(site, phase, b + home, 503, "closed") for phase in ("warm_up", "home")]
    rows += [response(site, "crawl", b + p, status, body, **more) for p, (status, body, more) in answers(b).items()]
    return rows + [response(site, "hop", b + p, status, location=to) for p, (status, to) in hops(b).items()]


def response(site, phase, url, status=200, body=b"", kind="text/html; charset=utf-8", **more):
    body = body.encode() if isinstance(body, str) else body
    row = {
        "site_id": site, "phase": phase, "request_url": url, "status": status, "primary_status": status, "primary_location": "", "final_url": url, "location": "",
        "headers": {"Content-Type": [kind]}, "content_type": kind, "body": body, "size": len(body), "truncated": False, "duration_s": 0.05, "error": "", "retries": 0,
    }
    return row | more


def responses(spark, rows):
    return spark.createDataFrame([tuple(r[n.split()[0]] for n in ORDER) for r in rows], RESPONSES)


ORDER = [c for c in RESPONSES.split(", ") if " " in c]


def sites(spark, *urls):
    from crawlsight.sources.schemas import site_rows

    return site_rows(spark, list(urls)) if urls else spark.createDataFrame([], SITES)
