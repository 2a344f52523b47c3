"""Column functions, case by case."""

import random
from datetime import UTC, datetime, timedelta, timezone
from email.utils import format_datetime
from http import HTTPStatus
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import dates, langcodes, urls
from crawlsight.functions import text as texts
from tests.helpers import one, values


def check(spark, cases, make):
    got = one(spark, [c for c, _ in cases], make)
    assert dict(zip([c for c, _ in cases], got, strict=True)) == dict(cases)


def test_w3c(spark):
    """Random moments in all the notations, and the same with one digit out of range."""
    rng, cases = random.Random(2), {}
    for _ in range(60):
        zone = timezone(timedelta(minutes=rng.choice([0, 90, -300, 765])))
        t = datetime(rng.randint(1971, 2090), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), tzinfo=zone)
        day = t.replace(hour=0, minute=0, second=0, tzinfo=UTC)
        cases |= {t.isoformat(): t.timestamp(), t.isoformat(timespec="minutes"): t.replace(second=0).timestamp(), f"{t:%Y-%m-%d}": day.timestamp(), f"{t:%Y-%m}": day.replace(day=1).timestamp(), f"{t:%Y}": day.replace(month=1, day=1).timestamp()}
        cases |= {t.isoformat(timespec="seconds").replace(f"T{t:%H}", "T25"): None, f"{t:%Y-%m}-32": None, f"{t:%Y}-00-01": None, f"{t:%d/%m/%Y}": None, f"{t:%Y-%m-%d %H:%M}": None}
    cases |= {"2023-02-29": None, "2028-02-29": datetime(2028, 2, 29, tzinfo=UTC).timestamp(), "1999-12-31T23:59:59.75Z": 946684799, "2001-02-03T04:05": None, "2001-02-03T04:05:60Z": None, "77-01-01": None, "": None, "soon": None, None: None}
    check(spark, list(cases.items()), lambda c: F.unix_seconds(dates.w3c(c)))


def test_http_dates(spark):
    rng, cases = random.Random(3), [("Mon, 32 Jan 2024 00:00:00 GMT", None), ("2024-01-01", None), ("", None)]
    for _ in range(40):
        t = datetime(rng.randint(1980, 2060), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), tzinfo=UTC)
        cases += [(format_datetime(t, usegmt=True), int(t.timestamp())), (t.ctime(), int(t.timestamp()))]
        if t.year < 2040:
            cases.append((f"{t:%A, %d-%b-%y %H:%M:%S} GMT", int(t.timestamp())))
    check(spark, cases, lambda c: F.unix_seconds(dates.http_date(c)))


def test_retry_after(spark):
    now = F.lit("2025-03-04 05:06:07").cast("timestamp")
    cases = [("0", 0.0), ("\t45 ", 45.0), ("-3", None), ("4.5 minutes", None), ("", None), (None, None)]
    cases += [(format_datetime(datetime(2025, 3, 4, 5, 6, 7, tzinfo=UTC) + timedelta(seconds=s), usegmt=True), max(0.0, float(s))) for s in (-86_400, -1, 0, 1, 59, 7200)]
    check(spark, cases, lambda c: dates.retry_after(c, now))


def test_numbers(spark):
    check(spark, [("0.25", True), ("0", True), ("1.0", True), ("1.0001", False), ("-0.0", True), ("-0.1", False), ("nan", True), ("0.5 ", False), ("0.5f", False), ("", False), ("1.", True), ("1e-3", True), ("1e3", False), ("half", False), ("-Infinity", False), (None, False)], lambda c: dates.number_in(c, 0, 1))
    assert one(spark, [7.00049, 0.0015, -1.0], dates.rounded, "double") == [7.0, 0.002, -1.0]


def test_encode(spark):
    """As the standard library quotes, with the characters left that an address may hold."""
    rng = random.Random(4)
    texts_ = ["".join(rng.choice("aZ09 /?#%&=+~é漢🙂\"<>\\^`{|}\n\t[]@!$'()*,;:._-") for _ in range(rng.randint(0, 25))) for _ in range(150)]
    check(spark, [(t, quote(t, safe="!#$%&'()*+,-./:;=?@[]_~")) for t in dict.fromkeys(texts_)], urls.encode)


def test_absolute(spark):
    good = ["http://zoo.test", "hTTps://ZOO.test/cages?n=1#top", "https://zoo.test:8443/a%2Fb c", "http://keeper:key@zoo.test/", "https://[2001:db8::7]:80/x", "https://żoo.test/ż", "https://zoo.test/" + "lion%20" * 9_000]
    bad = ["", " ", "//zoo.test/a", "zoo.test", "tel:+123", "ws://zoo.test/", "http:///cages", "http://", "https://zoo.test/100%", "http://zoo.test:port/", "http://[2001:db8::7", None]
    assert one(spark, good + bad, urls.absolute) == [True] * len(good) + [False] * len(bad)


def test_normalize(spark):
    check(spark, [
        ("HTTP://ZOO.test:80/Cages#map", "http://zoo.test/Cages"), ("https://zoo.test:443", "https://zoo.test/"), ("http://zoo.test:443/", "http://zoo.test:443/"), ("\thttps://zoo.test?day=2 ", "https://zoo.test/?day=2"),
        ("https://Keeper@ZOO.test/", "https://Keeper@zoo.test/"), ("https://zoo.test/sea lion", "https://zoo.test/sea%20lion"), ("https://[2001:DB8::7", "https://[2001:DB8::7"), ("cages/1#x", "cages/1"), ("https://zoo.test/%q", "https://zoo.test/%q"),
    ], urls.normalize)


def test_split(spark):
    cases = [("HTTPS://ZOO.test:81/a/b?c=1#d", ("https", "zoo.test:81", "/a/b", "c=1")), ("http://zoo.test", ("http", "zoo.test", "", "")), ("zoo.test/a?b", ("", "", "", "")), ("http:///a", ("", "", "", ""))]
    got = values(spark, [(c,) for c, _ in cases[:3]], "v string", s=urls.split_scheme(F.col("v")), h=urls.split_host(F.col("v")), p=urls.split_path(F.col("v")), q=urls.split_query(F.col("v")))
    assert got == [w for _, w in cases[:3]]
    check(spark, [("zoo.test:8080", "zoo.test"), ("zoo.test", "zoo.test"), ("[2001:db8::7]", "[2001:db8::7]"), ("[2001:db8::7]:90", "[2001:db8::7]")], urls.without_port)


def test_page_key(spark):
    check(spark, [("http://zoo.test", "zoo.test/"), ("https://www.zoo.test:443/birds/index.html", "zoo.test/birds"), ("https://zoo.test/birds///?page=3#x", "zoo.test/birds?page=3"), ("https://zoo.test/sea%20lion", "zoo.test/sea lion"), ("https://zoo.test/%/", "zoo.test/%"), ("birds", "birds")], urls.page_key)
    check(spark, [("https://ZOO.test/%42irds/", "zoo.test/birds"), ("https://zoo.test/BIRDS?Page", "zoo.test/birds?Page")], lambda c: urls.page_key(c, True))


def test_slash_style(spark):
    check(spark, [("https://zoo.test", ""), ("https://zoo.test/", ""), ("https://zoo.test/map.pdf", ""), ("https://zoo.test/map.pdf/", ""), ("zoo", ""), ("https://zoo.test/birds/owls/", "slash"), ("https://zoo.test/birds", "noslash"), ("https://zoo.test/birds?to=/", "noslash"), ("https://zoo.test/v1.penguins", "noslash")], urls.slash_style)


def test_parameters(spark):
    assert one(spark, ["page=1&sort=up;sort2&=x", "", "&&", "fbclid=1=2"], urls.parameter_names)[1:] == [[], [], ["fbclid"]]
    assert one(spark, ["page=1&sort=up;flag"], urls.parameter_names) == [["page", "sort", "flag"]]
    names = {"utm_medium": True, "Utm_Id": True, "fbclid": True, "utm": False, "sort": False, "ga": False}
    assert dict(zip(names, one(spark, list(names), lambda c: c.rlike(urls.TRACKING), "string"), strict=True)) == names


def test_sections(spark):
    check(spark, [("http://zoo.test", "/"), ("http://zoo.test/birds?x=1#y", "/birds?x=1#y"), ("http://zoo.test?y", "?y"), ("http://zoo.test#map", "/"), ("birds/owls", "birds/owls")], urls.path_of)
    check(spark, [("http://www.ZOO.test:8080/birds", "zoo.test"), ("birds", "")], urls.host_of)
    check(spark, [("/birds", True), ("/birds/owls", True), ("/birds?x", True), ("/birdsong", False), ("/", False)], lambda c: urls.under(c, F.lit("/birds")))
    check(spark, [("HTTP://Zoo.Test/Birds/?x", "zoo.test/Birds"), ("  zoo.test// ", "zoo.test"), ("www.zoo.test#x", "www.zoo.test")], urls.site_id)


def test_hreflang(spark):
    good = ["x-default", "nl", "NL-be", "fr-CA", "zh-Hans-CN", "kk-Cyrl", "es-003", "de-AT", "cy"]
    assert one(spark, good, langcodes.hreflang_error) == [None] * len(good)
    for tag, part in (("", "empty"), ("pt_BR", "instead of -"), ("dutch", "ISO 639-1"), ("qq-BE", "ISO 639-1"), ("nl-UK", "GB"), ("nl-QX", "ISO 3166-1"), ("fr-CAN", "ISO 3166-1"), ("zh-Hans-CN-1", "too many")):
        assert part in one(spark, [tag], langcodes.hreflang_error)[0]
    assert len(langcodes.LANGUAGES) == len(set(langcodes.LANGUAGES)) >= 180 and len(langcodes.regions()) >= 240
    check(spark, [("nl", True), ("Nl", False), ("zh-TW", True), ("haw", True), ("dutch", False), ("fr-CA", False)], langcodes.news_language)


def test_clean(spark):
    check(spark, [("\r\n sea \x02\x03 lion\xa0", "sea lion"), ("owl", "owl"), ("", ""), (" \t ", "")], texts.clean)


SNIFFED = [
    ("text/html", "", True), ("Application/XHTML+xml; q=1", "", True), ("image/png", "<html>", False), (None, "\n<!doctype HTML>", True), ("binary/octet-stream", "<head>", False), ("application/octet-stream", "<head>", True), ("", "<BODY class=x>", True),
    ("text/plain", "<header>", False), ("text/plain", "a <html\nlang=x>", True), ("", "words", False), (";", "<html>", True), ("", " " * 4000 + "<html>", False), (None, None, False),
]


@pytest.mark.parametrize(("kind", "body", "want"), SNIFFED)
def test_is_html(spark, kind, body, want):
    assert values(spark, [(kind, None if body is None else bytearray(body.encode()))], "k string, b binary", h=texts.is_html(F.col("k"), F.col("b"))) == [(want,)]


def test_noindex(spark):
    cases = [(["NoIndex"], True), (["follow, none"], True), (["all"], False), (["crawlbot: nosnippet, noindex"], True), (["elsebot: none"], False), (["elsebot: nofollow, crawlbot: noindex"], True), (["max-image-preview: large, noindex"], True), (["all", None, "noindex"], True), ([], False), (None, False)]
    assert one(spark, [c for c, _ in cases], lambda c: texts.noindex(c, "Crawlbot"), "array<string>") == [w for _, w in cases]


def test_soft_404(spark):
    check(spark, [("oops, page not found", True), ("404 - nursery", True), ("flight 4041", False), ("lost and found", False)], lambda c: c.rlike(texts.SOFT_404))


def test_cells(spark):
    check(spark, [("=SUM(A1)", "'=SUM(A1)"), ("+49", "'+49"), ("@home", "'@home"), ("\r1", "'\r1"), ("-x1", "'-x1"), ("-0.5", "-0.5"), ("-", "-"), ("", ""), ("a=b", "a=b")], texts.safe_cell)
    check(spark, [("", "-"), (None, "-"), ("0", "0")], texts.dash)
    check(spark, [("z" * 33, "z" * 30 + "..."), ("z" * 30, "z" * 30), ("z" * 28 + "漢z", "z" * 28 + "...")], lambda c: texts.shortened(c, 30))
    assert one(spark, [1.0, 59.99, 61.0, 3600.0], texts.duration_text, "double") == ["1s", "1m 00s", "1m 01s", "60m 00s"]
    assert one(spark, [10.0, 0.007, 2.25], texts.shown_number, "double") == ["10", "0.007", "2.25"]


def test_status(spark):
    """Names are those of the standard library; others are shown by number."""
    numbers = [s.value for s in HTTPStatus if s.value < 600 and s.value not in (103, 418, 421, 425)]
    got = values(spark, [(True, n) for n in [*numbers, 299, 599, 0]] + [(False, 0)], "c boolean, s int", k=texts.status_class(F.col("c"), F.col("s")), y=texts.status_key(F.col("c"), F.col("s")), t=texts.status_text(F.col("s")))
    assert [g[:2] for g in got[: len(numbers)]] == [(f"{n // 100}xx", str(n)) for n in numbers]
    phrases = {n: t for n, (_, _, t) in zip(numbers, got, strict=False)}
    assert {n: phrases[n] for n in (200, 302, 410, 503)} == {n: HTTPStatus(n).phrase for n in (200, 302, 410, 503)}
    assert got[len(numbers) :] == [("2xx", "299", "HTTP 299"), ("5xx", "599", "HTTP 599"), ("no response", "000", "No response (timeout / network error)"), ("not crawled", "-", "No response (timeout / network error)")]
