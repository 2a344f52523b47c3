import random
from datetime import datetime, timedelta

from crawlsight.llm import url_filter

START = datetime(2024, 1, 1)
CAPTURES = "id long, url string, fetched_at timestamp"
ENTRIES = "list_name string, scope string, pattern string, effective_at timestamp, action string"


def host(url):
    rest = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]
    return rest.split("@")[-1].split(":")[0].lower()


def brute(captures, entries):
    out = []
    for i, url, at in captures:
        best = None
        if url is not None and at is not None:
            keys = [(1000, "u:" + url.split("#")[0])]
            if "://" in url:
                labels = host(url).split(".")
                keys += [(999, "h:" + host(url))] + [(len(labels) - k, "d:" + ".".join(labels[k:])) for k in range(len(labels) - 1)]
            for rank, key in keys:
                state = {}
                own = [e for e in entries if e[2] is not None and e[3] is not None and e[4] in ("block", "allow", "remove") and {"url": "u:" + e[2].split("#")[0], "host": "h:" + e[2].lower(), "domain": "d:" + e[2].lower()}.get(e[1]) == key and e[3] <= at]
                for name, _, _, _, action in sorted(own, key=lambda e: (e[3], e[0] or "", e[4])):
                    state[name or ""] = action
                for name, action in state.items():
                    if action != "remove":
                        best = min(best or (0,), (-rank, action, name, key))
        out.append((i, best[1] if best else "none", best[2] if best else None, best[3] if best else None))
    return sorted(out, key=repr)


def run(spark, captures, entries, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = url_filter.filter_urls(spark.createDataFrame(captures, CAPTURES).repartition(3), spark.createDataFrame(entries, ENTRIES).repartition(2))
        return sorted(((r.id, r.decision, r.matched_list, r.matched_key) for r in df.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def made(seed, n, hosts):
    rng = random.Random(seed)
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', ':8080'])}/{rng.choice(['a', 'b', ''])}{rng.choice(['', '#x', '?q=1'])}"
    when = lambda: START + timedelta(days=rng.randint(0, 20))
    captures = [(i, url(), when()) for i in range(n)]
    entries = []
    for _ in range(n // 2):
        scope = rng.choice(["url", "host", "domain"])
        entries.append((rng.choice(["x", "y", None]), scope, url() if scope == "url" else rng.choice([*hosts, "example.com", "org"]), when(), rng.choice(["block", "block", "allow", "remove"])))
    return captures, entries


def test_random(spark):
    for seed in range(2):
        captures, entries = made(seed, 200, ["a.example.com", "B.example.com", "c.d.example.com", "example.org", "localhost"])
        assert run(spark, captures, entries) == brute(captures, entries)


def test_hot_key(spark):
    """One host with nearly all captures and entries, over more partitions than it has neighbours."""
    captures, entries = made(9, 300, ["hot.example.com"])
    assert run(spark, captures, entries, parts=23) == brute(captures, entries)


def test_odd_rows(spark):
    captures = [(1, None, START), (2, "https://e.com/", None), (None, "https://e.com/", START), (4, "", START), (5, "not a url", START), (6, "https://e.com/", START), (6, "https://e.com/", START)]
    entries = [("l", "host", "e.com", START, "block"), ("l", "host", None, START, "block"), ("l", "host", "e.com", None, "allow"), ("l", "path", "e.com", START, "allow"), ("l", "host", "e.com", START, "deny"), ("l", "host", "e.com", START, None), ("l", None, "e.com", START, "allow"), ("l", "url", "not a url", START, "allow")]
    assert run(spark, captures, entries) == brute(captures, entries)
    assert run(spark, captures, []) == sorted(((i, "none", None, None) for i, _, _ in captures), key=repr)
    assert run(spark, [], entries) == []


def test_intervals(spark):
    """An entry holds from its date until the next one of its list and pattern."""
    day = lambda n: START + timedelta(days=n)
    entries = [("l", "domain", "e.com", day(2), "block"), ("l", "domain", "e.com", day(4), "remove"), ("l", "domain", "e.com", day(6), "allow"), ("m", "host", "x.e.com", day(5), "block")]
    got = run(spark, [(n, "https://x.e.com/p", day(n)) for n in range(8)], entries)
    assert [d for _, d, _, _ in got] == ["none", "none", "block", "block", "none", "block", "block", "block"]
    assert [k for _, _, _, k in got][2:] == ["d:e.com", "d:e.com", None, "h:x.e.com", "h:x.e.com", "h:x.e.com"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "https://e.com/", START, "clash", "clash", "clash")], CAPTURES + ", decision string, best string, at string")
    got = url_filter.filter_urls(df, spark.createDataFrame([], ENTRIES))
    assert got.columns == ["id", "url", "fetched_at", "best", "at", "decision", "matched_list", "matched_key"] and got.first().best == "clash"
