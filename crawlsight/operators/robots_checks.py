"""URLs that robots.txt forbids to the crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import urls
from crawlsight.operators.catalogue import text
from crawlsight.operators.collect import url_issues
from crawlsight.sources import robots_txt


def target(url: Column) -> Column:
    """Path and query of a URL as robots.txt sees them; / for an empty path."""
    rest = F.regexp_replace(F.regexp_replace(urls.encode(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(rest, r"^(\?|$)", "/$1"), r"^([^?]*)\?$", "$1")


def judged(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """listed (site_id, url and others) on the site's own host, with agent and verdict (allowed, rule).

    rules: (site_id, host, agent, rules), a row for each site whose robots.txt was found. A URL meets its site's rules as
    one array, so no row is made for a rule that a URL is tested by.
    """
    x = listed.join(rules, "site_id").where(urls.absolute(F.col("url")) & (urls.hostname(F.col("url")) == F.col("host")))
    return x.withColumn("verdict", robots_txt.verdict(target(F.col("url")), F.col("rules"))).drop("rules", "host")


def robots_issues(listed: DataFrame, rules: DataFrame) -> DataFrame:
    shut = judged(listed, rules).where("NOT verdict.allowed")
    return url_issues(shut, 5, F.lit("ROBOTS_BLOCKED"), text(F.col("verdict.rule"), " (group ", F.col("agent"), ")"))
