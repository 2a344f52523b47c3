"""Live capture from a small server on this machine, and the command that audits it."""

import gzip
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql.types import StructType

from crawlsight import cli
from crawlsight.sources import live
from crawlsight.sources.config import Config, Range, Site, dump, parse
from tests.helpers import NS, web_page


class Handler(BaseHTTPRequestHandler):
    seen: list = []
    flaky = 0

    def log_message(self, *args):
        pass

    def send(self, status, body=b"", kind="text/html", **headers):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        base = f"http://{self.headers['Host']}"
        Handler.seen.append((self.path, dict(self.headers)))
        pages = {"/a": web_page("A"), "/b%20c": web_page("B"), "/welcome": web_page("Welcome")}
        if self.path == "/" and "visited" not in (self.headers.get("Cookie") or ""):
            self.send(302, Set_Cookie="visited=1; Path=/", Location="/welcome")
        elif self.path == "/":
            self.send(200, web_page("Home").encode())
        elif self.path == "/robots.txt":
            self.send(200, f"User-agent: *\nSitemap: {base}/index.xml\n".encode(), "text/plain")
        elif self.path == "/index.xml":
            self.send(200, f'<sitemapindex xmlns="{NS}"><sitemap><loc>{base}/pages.xml</loc></sitemap></sitemapindex>'.encode(), "application/xml")
        elif self.path == "/pages.xml":
            locs = "".join(f"<url><loc>{base}{p}</loc></url>" for p in ("/a", "/b c", "/moved", "/flaky", "/zip"))
            self.send(200, gzip.compress(f'<urlset xmlns="{NS}">{locs}</urlset>'.encode()), "application/gzip")
        elif self.path == "/moved":
            self.send(301, Location="/a", Set_Cookie="late=1")
        elif self.path == "/flaky":
            Handler.flaky += 1
            self.send(429 if Handler.flaky % 2 else 200, web_page("Flaky").encode(), Retry_After="0")
        elif self.path == "/zip":
            self.send(200, gzip.compress(web_page("Zip").encode()), Content_Encoding="gzip")
        elif self.path in pages:
            self.send(200, pages[self.path].encode())
        else:
            self.send(404, web_page("404 Not found").encode())


@pytest.fixture(scope="module")
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}"
    http.shutdown()


def quick():
    c = Config()
    c.politeness.delay = c.politeness.crawl_delay = c.politeness.retry_delay = Range(0, 0)
    c.http.headers = {"X-Own": "1"}
    return c


def test_capture(server):
    Handler.seen.clear()
    waits = []
    rows = list(live.capture_site(Site(server), quick(), waits.append))
    by = {(r["phase"], r["request_url"].removeprefix(server)): r for r in rows}
    assert [r["phase"] for r in rows[:4]] == ["warm_up", "home", "robots", "sitemap"]
    warm, home = by["warm_up", "/"], by["home", "/"]
    assert (warm["status"], warm["primary_status"], warm["primary_location"], warm["final_url"]) == (200, 302, f"{server}/welcome", f"{server}/welcome") and home["primary_status"] == 200
    assert {p for k, p in by if k == "crawl"} == {"/a", "/b c", "/moved", "/flaky", "/zip"}
    assert (by["crawl", "/moved"]["status"], by["crawl", "/moved"]["location"]) == (301, f"{server}/a") and by["hop", "/a"]["status"] == 200
    assert (by["crawl", "/flaky"]["status"], by["crawl", "/flaky"]["retries"]) == (200, 1)
    assert b"Zip" in by["crawl", "/zip"]["body"] and by["crawl", "/b c"]["status"] == 200
    path, headers = Handler.seen[0]
    assert headers["X-Own"] == "1" and headers["X-Audit"] == "crawlsight" and "Chrome" in headers["User-Agent"] and headers["Sec-Fetch-Mode"] == "navigate"
    assert "late" not in (Handler.seen[-1][1].get("Cookie") or "")


def test_limits_and_errors(server):
    c = quick()
    c.politeness.retries = 0
    client = live.Client(c, "127.0.0.1", lambda s: None)
    got = client.get(f"{server}/a", keep=10)
    assert len(got["body"]) == 10 and got["size"] > 100 and not got["truncated"]
    c.http.max_body_size = 50
    got = client.get(f"{server}/a")
    assert (len(got["body"]), got["size"], got["truncated"]) == (50, 50, True)
    dead = client.get("http://127.0.0.1:9/")
    assert dead["status"] == 0 and dead["error"]
    assert live.error_text(TimeoutError()) == "timeout"
    assert "X-Own" not in client.headers("http://other.example/") and "X-Own" in client.headers("http://127.0.0.1/x")


def test_retry_after():
    now = datetime(2026, 7, 28, 9, 59, 30, tzinfo=UTC)
    cases = {"5": 5.0, "": None, "-1": None, "soon": None, "Tue, 28 Jul 2026 10:00:00 GMT": 30.0, "Mon, 27 Jul 2026 10:00:00 GMT": 0.0, None: None}
    assert {v: live.retry_after(v, now) for v in cases} == cases


QUICK = "politeness: {delay: {min: 0, max: 0}, crawl_delay: {min: 0, max: 0}, retry_delay: {min: 0, max: 0}}\nreport: {formats: [json, tables]}\n"


def test_source_and_command(server, spark, tmp_path, monkeypatch):
    rows = live.capture(spark, parse(QUICK), [server]).collect()
    assert {r.phase for r in rows} == {"warm_up", "home", "robots", "sitemap", "crawl", "hop"}
    monkeypatch.chdir(tmp_path)
    (tmp_path / "crawlsight.yaml").write_text(QUICK)
    assert cli.main(["run", server, "--out", "out", "--fail-on", "warning", "--work", str(tmp_path / "work")]) == 1
    assert (tmp_path / "out" / "latest").exists() and len(list((tmp_path / "out").glob("*/report.json"))) == 1 and len(list((tmp_path / "out").glob("*/tables/urls"))) == 1
    assert list((tmp_path / "work").iterdir()) == []  # the run's own tables are gone


def test_flags_reach_the_capture(server, tmp_path, monkeypatch):
    """What the command line says is what sites are fetched by."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "crawlsight.yaml").write_text(QUICK)

    def fetched(*flags):
        config = cli.changed(cli.load(None), cli.arguments(["run", server, *flags]))
        reader = live.SiteCapture({"config": dump(config), "sites": server}).reader(StructType([]))
        rows = list(live.capture_site(reader.config.select([server])[0], reader.config, lambda s: None))
        return reader.config, [r for r in rows if r["phase"] == "crawl"]

    assert len(fetched()[1]) == 5
    config, rows = fetched("--no-crawl")
    assert not config.crawl.enabled and rows == []
    config, rows = fetched("--max-urls", "2", "--concurrency", "1")
    assert (config.crawl.max_urls, config.crawl.concurrency, len(rows)) == (2, 1, 2)
