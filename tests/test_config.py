"""Configuration and command line."""

import pytest

from crawlsight import cli
from crawlsight.sources import config as configs
from crawlsight.sources.config import Config, ConfigError, duration, normalize_id, parse, size


def test_example_is_the_default():
    got = parse(configs.example())
    assert [s.url for s in got.sites] == ["https://www.example.com", "https://www.example.com/blog"] and got.sites[1].concurrency == 3
    got.sites, got.checks = [], configs.Checks()
    assert got == Config() and parse("") == Config()


def test_values():
    got = parse("http: {timeout: 500ms, max_body_size: 2MiB, headers: {X: y}}\npoliteness: {delay: {min: 0, max: 1m30s}}\nthresholds: {news_max_age: 0}\nchecks: {hreflang: false, disable: [noindex], severity: {soft_404: notice}}\n")
    assert (got.http.timeout, got.http.max_body_size, got.http.headers, got.politeness.delay.max) == (0.5, 2 << 20, {"X": "y"}, 90.0)
    policy = got.policy()
    assert not policy.group_enabled("hreflang") and not policy.enabled("NOINDEX") and policy.severity("SOFT_404") == "notice"


WRONG = [
    "sites: [ftp://e.com]", "sites: [https://]", "sites: [https://e.com, http://E.com/]", "sites: [{url: https://e.com, concurrency: -1}]", "sites: [{link: x}]", "http: {timeout: 0}", "http: {timeout: soon}", "http: {timeout: -1s}",
    "http: {max_body_size: 10}", "http: {max_body_size: x}", "http: {audit_header: bad}", "http: {headers: {accept-encoding: x}}", "http: {nope: 1}", "nope: 1", "politeness: {delay: {min: 2s, max: 1s}}", "politeness: {crawl_delay: {min: 2s, max: 1s}}",
    "politeness: {retries: 11}", "politeness: {retries: -1}", "crawl: {concurrency: 0}", "crawl: {concurrency: 65}", "crawl: {max_urls: -1}", "crawl: {max_redirects: 31}", "crawl: {enabled: maybe}", "sitemap: {max_depth: 21}", "robots: {user_agent: ' '}",
    "thresholds: {soft_404_pattern: '('}", "thresholds: {soft_404_min_text: -1}", "report: {formats: [pdf]}", "report: {fail_on: fatal}", "report: {out: ''}", "checks: {nope: true}", "checks: {site: 1}", "checks: {disable: [NOPE]}", "checks: {severity: {NOPE: error}}",
    "checks: {severity: {NOINDEX: fatal}}", "checks: [a]", "sites: [", "http: 5",
]


@pytest.mark.parametrize("text", WRONG)
def test_errors(text):
    with pytest.raises(ConfigError):
        parse(text)


def test_dump_is_read_back():
    c = parse("sites: [{url: https://e.com, concurrency: 3}]\nhttp: {timeout: 1ms, headers: {X: y}}\nchecks: {hreflang: false, disable: [noindex], severity: {soft_404: notice}}\npoliteness: {delay: {min: 0, max: 1e-6}}\n")
    assert parse(configs.dump(c)) == c and parse(configs.dump(Config())) == Config()


def test_all_errors_are_told():
    with pytest.raises(ConfigError) as e:
        parse("http: {timeout: 0}\ncrawl: {concurrency: 0}")
    assert len(str(e.value).splitlines()) == 2


def test_units():
    assert [duration(v) for v in ("15s", "500ms", "1h30m", "2", 1.5, "")] == [15, 0.5, 5400, 2, 1.5, 0]
    assert [size(v) for v in ("5MB", "512KiB", "1gib", "10 B", 7, "1.5KB", "")] == [5_000_000, 524_288, 1 << 30, 10, 7, 1500, 0]
    assert [normalize_id(v) for v in ("https://WWW.E.com/A/?x", " http://e.com ", "E.com/Blog/", "e.com#x")] == ["www.e.com/A", "e.com", "e.com/Blog", "e.com"]


def test_select():
    c = Config(sites=[configs.Site("https://e.com"), configs.Site("https://e.com/blog", 2)])
    assert [s.id for s in c.select([])] == [s.id for s in c.select(["all"])] == ["e.com", "e.com/blog"]
    assert [s.concurrency for s in c.select(["http://E.com/blog/"])] == [2] and c.site_concurrency(c.sites[0]) == 5
    assert c.select(["https://new.org"])[0].url == "https://new.org"
    for args in (["nope"], ["https://"]):
        with pytest.raises(ConfigError):
            c.select(args)
    with pytest.raises(ConfigError):
        Config().select([])


def test_commands(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["version"]) == 0 and cli.main(["checks"]) == 0 and cli.main(["checks", "--markdown"]) == 0
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 2 and cli.main(["init", "--force"]) == 0
    capsys.readouterr()
    assert cli.main(["list"]) == 0 and "www.example.com/blog" in capsys.readouterr().out
    assert cli.main(["nope-such-id"]) == 2 and cli.main(["run", "--bogus"]) == 2 and cli.main(["help"]) == 0
    (tmp_path / "bad.yaml").write_text("nope: 1")
    assert cli.main(["list", "--config", "bad.yaml"]) == 2 and cli.main(["list", "--config", "missing.yaml"]) == 2


def test_arguments():
    got = cli.arguments(["https://e.com", "--no-crawl", "https://f.com", "--max-urls", "5"])
    assert got.command == "run" and got.sites == ["https://e.com", "https://f.com"] and got.no_crawl and got.max_urls == 5
