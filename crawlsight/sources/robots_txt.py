"""robots.txt as rows, in DataFrame functions: lines, groups, rules, sitemaps, and the group of a crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions import text as texts
from crawlsight.functions import urls

#: Bytes of a file that are read.
MAX_SIZE = 512_000

# Spellings of the keys. Fixed values of the format.
AGENT = ("user-agent", "useragent", "user agent")
ALLOW = ("allow",)
DISALLOW = ("disallow", "dissallow", "dissalow", "disalow", "diasllow", "disallaw")
DELAY = ("crawl-delay", "crawldelay", "crawl delay")
SITEMAP = ("sitemap", "site-map")


def product_token(user_agent: Column) -> Column:
    return F.lower(F.regexp_extract(texts.stripped(user_agent), r"^[^/ \t;(]*", 0))


def token_of(user_agent: str) -> str:
    head = user_agent.strip()
    for end in "/ \t;(":
        head = head.partition(end)[0]
    return head.lower()


def lines(files: DataFrame) -> DataFrame:
    """(site_id, line_no, key, value) of files (site_id, body): lines that have a colon, without comments."""
    text = texts.readable(F.substring("body", 1, MAX_SIZE))
    text = F.regexp_replace(text, "^﻿", "")
    rows = files.select("site_id", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", "(?s)#.*$", "")).where(F.contains("line", F.lit(":")))
    blanks = r"^[\s ]+|[\s ]+$"
    key = F.lower(F.regexp_replace(F.regexp_extract("line", "(?s)^([^:]*):", 1), blanks, ""))
    value = F.regexp_replace(F.regexp_replace("line", "(?s)^[^:]*:", ""), blanks, "")
    return rows.select("site_id", "line_no", key.alias("key"), value.alias("value"))


def numbered(rows: DataFrame) -> DataFrame:
    """lines() with grp_no: agents in succession open one group; any other line with a key ends their run.

    A window holds one file, 500 KiB at most.
    """
    by = Window.partitionBy("site_id").orderBy("line_no")
    agent = F.col("key").isin(*AGENT)
    opens = agent & ~F.coalesce(F.lag(agent).over(by), F.lit(False))
    return rows.withColumn("grp_no", F.sum(opens.cast("int")).over(by))


def rules(rows: DataFrame) -> DataFrame:
    """(site_id, grp_no, rule_no, allow, raw, pattern, regex) of numbered lines; rules before any agent count for nothing."""
    own = rows.where(F.col("key").isin(*ALLOW, *DISALLOW) & (F.col("value") != "") & (F.col("grp_no") > 0))
    pattern = urls.robots_pattern(F.col("value"))
    own = own.select("site_id", "grp_no", F.col("line_no").alias("rule_no"), F.col("key").isin(*ALLOW).alias("allow"), F.col("value").alias("raw"), pattern.alias("pattern"))
    return own.withColumn("regex", urls.robots_regex(F.col("pattern")))


def sitemaps(rows: DataFrame) -> DataFrame:
    """(site_id, line_no, url) of the Sitemap lines."""
    return rows.where(F.col("key").isin(*SITEMAP) & (F.col("value") != "")).select("site_id", "line_no", F.col("value").alias("url"))


def agents(rows: DataFrame, user_agent: str) -> DataFrame:
    """(site_id, agent, groups, crawl_delay): the group for the crawler, by the longest name, else *.

    All groups of that name count together; crawl_delay is the greatest, or null.
    """
    token = token_of(user_agent)
    named = rows.where(F.col("key").isin(*AGENT)).select("site_id", "grp_no", product_token(F.col("value")).alias("agent"))
    fits = ~F.col("agent").isin("*", "") & ((F.lit(token) == F.col("agent")) | F.startswith(F.lit(token), F.concat("agent", F.lit("-"))))
    best = named.groupBy("site_id").agg(F.max_by(F.when(fits, F.col("agent")), F.when(fits, F.length("agent"))).alias("best"))
    chosen = rows.select("site_id").distinct().join(best, "site_id", "left").select("site_id", F.coalesce("best", F.lit("*")).alias("agent"))
    groups = chosen.join(named.distinct(), ["site_id", "agent"])
    written = F.when(F.col("value").rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col("value")).try_cast("double")
    delays = rows.where(F.col("key").isin(*DELAY) & (F.col("grp_no") > 0)).select("site_id", "grp_no", "line_no", written.alias("delay")).where("delay IS NOT NULL")
    last = delays.groupBy("site_id", "grp_no").agg(F.max_by("delay", "line_no").alias("delay"))
    found = groups.join(last, ["site_id", "grp_no"], "left").groupBy("site_id").agg(F.sort_array(F.collect_list("grp_no")).alias("groups"), F.max("delay").alias("crawl_delay"))
    return chosen.join(found, "site_id", "left")


def agent_rules(rows: DataFrame, user_agent: str) -> DataFrame:
    """(site_id, agent, rules): the rules for the crawler as an array in file order; a file has 500 KiB at most."""
    chosen = agents(rows, user_agent)
    own = chosen.select("site_id", F.explode("groups").alias("grp_no")).join(rules(rows), ["site_id", "grp_no"])
    each = F.struct("rule_no", "allow", "raw", "pattern", "regex")
    held = own.groupBy("site_id").agg(F.array_sort(F.collect_list(each)).alias("rules"))
    empty = F.array().cast("array<struct<rule_no: int, allow: boolean, raw: string, pattern: string, regex: string>>")
    return chosen.join(held, "site_id", "left").select("site_id", "agent", "crawl_delay", F.coalesce("rules", empty).alias("rules"))


def verdict(target: Column, rules: Column) -> Column:
    """(allowed, rule) for a path with its query: the longest pattern decides, Allow before Disallow, the first of equals.

    No rule and /robots.txt allow.
    """

    def of(path: Column) -> Column:
        hits = F.filter(rules, lambda r: urls.robots_matches(path, r["pattern"], r["regex"]))
        return F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["pattern"]).alias("size"), r["allow"].alias("allow"), (-r["rule_no"]).alias("place"), r["raw"].alias("raw"))))

    def told(best: Column) -> Column:
        shown = F.concat(F.when(best["allow"], "Allow: ").otherwise("Disallow: "), best["raw"])
        return F.struct(F.coalesce(best["allow"], F.lit(True)).alias("allowed"), F.coalesce(shown, F.lit("")).alias("rule"))

    path = urls.robots_path(F.when(target == "", "/").otherwise(target))
    return urls.let(F.when(target != "/robots.txt", urls.let(path, of)), told)
