"""Live capture: one task fetches one site politely, and gives the rows that an audit reads.

Sites are fetched side by side, a site by one task, so that its pauses hold; within a site up to `concurrency` requests
for listed URLs are open at once. Registered as the Python data source "site_capture".
"""

from __future__ import annotations

import gzip
import http.client
import http.cookiejar
import random
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from crawlsight.operators.tree import walk
from crawlsight.sources import robots_txt, sitemap_file
from crawlsight.sources.config import Config, Range, Site, dump
from crawlsight.sources.schemas import RESPONSES

HOME_BYTES = 1 << 20
PAGE_BYTES = 4 << 20
#: What a browser sends when a person opens a page. Fixed values.
NAVIGATION = {
    "Upgrade-Insecure-Requests": "1",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,image/apng,*/*;q=0.8",
    "Sec-Fetch-Site": "none",
    "Sec-Fetch-Mode": "navigate",
    "Sec-Fetch-User": "?1",
    "Sec-Fetch-Dest": "document",
    "Priority": "u=0, i",
}


def encoded(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,-./:;=?@[]_~")


def bare_host(host: str | None) -> str:
    return (host or "").lower().removeprefix("www.")


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or the time until a date, 0 at least; None if neither."""
    v = (value or "").strip()
    if v.lstrip("+").isdigit():
        return float(v)
    try:
        when = parsedate_to_datetime(v)
    except ValueError:
        return None
    return max(0.0, (when.astimezone(UTC) - now).total_seconds()) if when.tzinfo else None


def error_text(error: BaseException) -> str:
    """What a person needs to read of a failed request."""
    cause = getattr(error, "reason", error)
    if isinstance(cause, TimeoutError) or isinstance(error, TimeoutError):
        return "timeout"
    return str(cause) or type(cause).__name__


def read_body(stream, limit: int, keep: int) -> tuple[bytes, int, bool]:
    """The first bytes of a body (keep; 0: all up to limit), its size counted up to limit, and whether it has more."""
    keep = limit if keep <= 0 else min(keep, limit)
    body, total = bytearray(), 0
    while total <= limit and (chunk := stream.read(min(1 << 16, limit + 1 - total))):
        body += chunk[: max(0, keep - len(body))]
        total += len(chunk)
    return bytes(body), min(total, limit), total > limit


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class _Follow(urllib.request.HTTPRedirectHandler):
    """Follows up to so many redirects; remembers the first; site headers don't go to other hosts."""

    def __init__(self, most: int, site_host: str, own: dict):
        self.max_redirections, self.max_repeats, self.site_host, self.own = most, most, site_host, own
        self.primary: tuple[int, str] | None = None

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None:
            if self.primary is None:
                self.primary = (code, newurl)
            if bare_host(urlsplit(newurl).hostname) != bare_host(self.site_host):
                for name in self.own:
                    new.remove_header(name.capitalize())
        return new


@dataclass
class Client:
    """Requests of one site's audit. sleep: takes seconds, so that tests need not wait."""

    config: Config
    site_host: str
    sleep: Callable[[float], None] = time.sleep
    cookies: http.cookiejar.CookieJar = field(default_factory=http.cookiejar.CookieJar)

    def headers(self, url: str) -> dict[str, str]:
        """Of several values for a name the last one counts; empty ones are left out."""
        h = self.config.http
        name, _, value = (x.strip() for x in h.audit_header.partition(":"))
        own_host = bare_host(urlsplit(url).hostname) == bare_host(self.site_host)
        layers = [
            {"Sec-Ch-Ua": h.sec_ch_ua, "Sec-Ch-Ua-Mobile": h.sec_ch_ua and "?0", "Sec-Ch-Ua-Platform": h.sec_ch_ua_platform} if h.browser_headers else {},
            NAVIGATION if h.browser_headers else {},
            {"User-Agent": h.user_agent, "Accept-Language": h.accept_language},
            {name: value} if name else {},
            h.headers if own_host else {},
            {"Accept-Encoding": "gzip"},
        ]
        return {k: v for layer in layers for k, v in layer.items() if v}

    def opener(self, redirects, store: bool):
        jar = self.cookies
        if not store:  # answers of listed URLs read cookies, but never change them
            jar = http.cookiejar.CookieJar()
            for c in self.cookies:
                jar.set_cookie(c)
        context = ssl._create_unverified_context() if self.config.http.insecure_skip_verify else ssl.create_default_context()
        return urllib.request.build_opener(redirects, urllib.request.HTTPCookieProcessor(jar), urllib.request.HTTPSHandler(context=context))

    def once(self, url: str, follow: bool, keep: int, store: bool) -> dict:
        row = {"request_url": url, "status": 0, "primary_status": 0, "primary_location": "", "final_url": "", "location": "", "headers": {}, "content_type": "", "body": b"", "size": 0, "truncated": False, "duration_s": 0.0, "error": "", "retries": 0}
        target, began = encoded(url), time.monotonic()
        redirects = _Follow(max(1, self.config.crawl.max_redirects), self.site_host, self.config.http.headers) if follow else _Stay()
        try:
            request = urllib.request.Request(target, headers=self.headers(target))
            try:
                answer = self.opener(redirects, store).open(request, timeout=self.config.http.timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                names: dict[str, list[str]] = {}
                for k, v in answer.headers.items():
                    names.setdefault(k, []).append(v)
                row |= {"status": answer.status, "primary_status": answer.status, "headers": names, "content_type": answer.headers.get("Content-Type") or "", "final_url": answer.url}
                if 300 <= answer.status < 400 and (to := answer.headers.get("Location")):
                    row["location"] = urljoin(answer.url, to)
                packed = (answer.headers.get("Content-Encoding") or "").lower() == "gzip"
                stream = gzip.GzipFile(fileobj=answer) if packed else answer
                row["body"], row["size"], row["truncated"] = read_body(stream, self.config.http.max_body_size, keep)
        except (OSError, http.client.HTTPException, ValueError, EOFError) as e:
            row["error"] = error_text(e)
        if follow and redirects.primary:
            row["primary_status"], row["primary_location"] = redirects.primary
        return row | {"duration_s": time.monotonic() - began}

    def get(self, url: str, follow: bool = False, keep: int = 0, store: bool = False) -> dict:
        """Tried again when there is no answer, or a 429 or 503 that says when."""
        p = self.config.politeness
        for attempt in range(p.retries + 1):
            row = self.once(url, follow, keep, store) | {"retries": attempt}
            wait = None
            if row["error"]:
                wait = random.uniform(p.retry_delay.min, max(p.retry_delay.min, p.retry_delay.max))
            elif row["status"] in (429, 503):
                given = next((v[0] for k, v in row["headers"].items() if k.lower() == "retry-after"), None)
                asked = retry_after(given, datetime.now(UTC))
                wait = None if asked is None else min(asked, p.max_retry_after)
            if wait is None or attempt == p.retries:
                break
            self.sleep(wait)
        return row


def _pause(client: Client, span: Range) -> None:
    client.sleep(random.uniform(span.min, max(span.min, span.max)))


def sitemap_lines(body: bytes) -> tuple[list[str], dict[str, float]]:
    """Sitemaps that robots.txt names, and delays by agent; for the capture only, audits read robots.txt as rows."""
    named, delays, open_, agents = [], {}, False, []
    for line in body[: robots_txt.MAX_SIZE].decode("utf-8", "replace").removeprefix("﻿").replace("\r", "\n").split("\n"):
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key in robots_txt.AGENT:
            agents = [*agents, robots_txt.token_of(value)] if open_ else [robots_txt.token_of(value)]
        elif key in robots_txt.SITEMAP and value:
            named.append(value)
        elif key in robots_txt.DELAY:
            try:
                delays |= {a: max(float(value), delays.get(a, 0.0)) for a in agents}
            except ValueError:
                pass
        open_ = key in robots_txt.AGENT
    return named, delays


def capture_site(site: Site, config: Config, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of RESPONSES of one site: home, robots.txt, sitemaps as the walk meets them, listed URLs, redirects."""
    url = site.url.strip().rstrip("/")
    parts = urlsplit(url)
    origin = f"{parts.scheme}://{parts.netloc}"
    client = Client(config, parts.hostname or "", sleep)
    row = lambda phase, answer: {"site_id": site.id, "phase": phase} | answer

    def visit(phase: str, target: str, keep: int = 0) -> dict:
        _pause(client, config.politeness.delay)
        return row(phase, client.get(target, follow=True, keep=keep, store=True))

    if config.crawl.warm_up:
        yield visit("warm_up", f"{url}/", HOME_BYTES)
    yield visit("home", f"{url}/", HOME_BYTES)
    robots = visit("robots", f"{origin}/robots.txt", robots_txt.MAX_SIZE)
    yield robots
    named, delays = sitemap_lines(robots["body"]) if robots["status"] == 200 else ([], {})

    files: dict[str, dict] = {}
    docs: dict[str, dict] = {}

    def fetch(target: str) -> Iterator[dict]:
        if target not in files:
            files[target] = visit("sitemap", target)
            good = files[target]["status"] == 200 and not files[target]["error"]
            docs[target] = sitemap_file.parse(files[target]["body"], config.http.max_body_size) if good else {"kind": "", "sitemaps": [], "entries": []}
            yield files[target]

    roots = list(dict.fromkeys(named))
    for target in roots:
        yield from fetch(target)
    readable = lambda target: docs[target]["kind"] in ("urlset", "index", "text")
    if not any(map(readable, roots)):
        for path in config.sitemap.fallbacks:
            for start in dict.fromkeys((url, origin)):
                target = f"{start}/{path.lstrip('/')}"
                if target in files or any(map(readable, files)):
                    continue
                yield from fetch(target)
                if readable(target):
                    roots.append(target)
    # The walk is made again after each fetch until it meets no file that wasn't fetched.
    while True:
        children = {u: [e["loc"] for e in d["sitemaps"] if e["has_loc"] and e["loc"].lower().startswith(("http://", "https://"))] for u, d in docs.items() if d["kind"] == "index"}
        met = walk([(r, True) for r in roots], children, config.sitemap.max_depth)
        fresh = next((v[1] for v in met if v[1] not in files), None)
        if fresh is None:
            break
        yield from fetch(fresh)
    if not config.crawl.enabled:
        return
    listed = dict.fromkeys(e["loc"] for v in met if v[4] == "read" for e in docs[v[1]]["entries"] if e["has_loc"] and urlsplit(encoded(e["loc"])).netloc)
    listed = list(listed)[: config.crawl.max_urls or None]
    token = robots_txt.token_of(config.robots.user_agent)
    delay, workers = config.politeness.crawl_delay, config.site_concurrency(site)
    if config.politeness.respect_crawl_delay and (own := delays.get(token, delays.get("*"))):
        delay, workers = Range(max(own, delay.min), max(own, delay.max)), 1
    known: dict[str, dict] = {}

    def page(target: str) -> dict:
        _pause(client, delay)
        return row("crawl", client.get(target, keep=PAGE_BYTES))

    with ThreadPoolExecutor(max(1, min(workers, len(listed) or 1))) as pool:
        for answer in pool.map(page, listed):
            yield answer
            if 300 <= answer["status"] < 400 and config.crawl.max_redirects:
                yield from _hops(client, row, answer["location"], known, delay)


def _hops(client: Client, row: Callable, target: str, known: dict, delay: Range) -> Iterator[dict]:
    """What a redirect leads to, each address once."""
    for _ in range(client.config.crawl.max_redirects):
        if not target or target in known:
            return
        _pause(client, delay)
        known[target] = row("hop", client.get(target, keep=1))
        yield known[target]
        target = known[target]["location"]


class _SitePartition(InputPartition):
    def __init__(self, site: Site):
        self.site = site


class _SiteReader(DataSourceReader):
    def __init__(self, config: Config, sites: list[Site], schema: StructType):
        self.config, self.sites, self.names = config, sites, schema.fieldNames()

    def partitions(self):
        return [_SitePartition(s) for s in self.sites]

    def read(self, partition):
        for r in capture_site(partition.site, self.config):
            yield tuple(r[n] for n in self.names)


class SiteCapture(DataSource):
    """spark.read.format("site_capture").option("config", YAML).option("sites", "URL or id, ...").load()"""

    @classmethod
    def name(cls) -> str:
        return "site_capture"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema: StructType) -> DataSourceReader:
        from crawlsight.sources.config import parse

        config = parse(self.options.get("config", ""))
        chosen = [s for s in self.options.get("sites", "").split(",") if s.strip()]
        return _SiteReader(config, config.select([s.strip() for s in chosen]), schema)


def capture(spark: SparkSession, config: Config, sites: list[str]) -> DataFrame:
    """Captured responses of the sites, fetched as config says. Write them before auditing: every read fetches again."""
    spark.dataSource.register(SiteCapture)
    return spark.read.format("site_capture").option("config", dump(config)).option("sites", ",".join(sites)).load()
