"""Checks of answers as they are captured.

Only checks that need one answer at a time run here: status, speed, size, kind, soft 404, noindex, canonical. Checks over
all URLs of a site (duplicates, variants, reciprocity) need the complete set and stay with the audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlsight.functions import dates
from crawlsight.functions import text as texts
from crawlsight.operators import catalogue, page_checks
from crawlsight.operators.catalogue import found, issue, one_of
from crawlsight.sources import html_page
from crawlsight.sources.config import Config
from crawlsight.sources.schemas import RESPONSES, captured


def read_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Captured responses as their files arrive, so many a batch at most."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files).parquet(path)


def answer_issues(responses: DataFrame, config: Config) -> DataFrame:
    """(site_id, url, pos, code, message) of crawled URLs, each by its own answer; of a batch or of a stream."""
    t, status = config.thresholds, F.col("status")
    x = captured(responses).where("phase = 'crawl'").withColumnRenamed("request_url", "url")
    x = x.withColumn("html", (status == 200) & texts.is_html(F.col("content_type"), F.col("body")))
    keep = ["site_id", "url", "status", "retries", "error", "location", "duration_s", "size", "content_type", "headers", "html"]
    body = F.when(F.col("html"), F.substring("body", 1, page_checks.PAGE_BYTES)).cast("binary").alias("body")
    x = html_page.pages(x.select(*keep, body), config.robots.user_agent)
    x = x.withColumn("links", page_checks.distinct_canonicals(F.col("page.canonicals")))
    x = x.withColumn("link", F.when(F.col("html") & (F.size("links") == 1), F.get("links", F.lit(0))))
    x = x.withColumn("canonical", F.when(F.col("link").isNotNull(), page_checks.resolved(F.col("url"), F.col("link"))))
    page, html = F.col("page"), F.col("html")
    error = page_checks.shown_error(status, F.col("retries"), F.col("error"))
    to = F.when(status.between(300, 399), F.col("location")).otherwise("")
    issues = found(
        page_checks.status_issues(status, F.col("retries"), error, to),
        page_checks.performance_issues(status, F.col("duration_s"), F.col("size"), t.slow_response, t.max_page_size),
        one_of(issue("CONTENT_NOT_HTML", (status == 200) & ~html, F.when(F.col("content_type") == "", "no Content-Type").otherwise(F.col("content_type")))),
        F.when(html, one_of(page_checks.soft_404_issue(page["title"], page["h1"], page["text_length"], t.soft_404_pattern, t.soft_404_min_text), page_checks.noindex_issue(page["meta_robots"], F.col("headers"), config.robots.user_agent))),
        F.when(html, page_checks.canonical_issues(F.col("url"), F.col("links"), F.col("canonical"))),
    )
    return x.select("site_id", "url", F.posexplode(issues).alias("pos", "issue")).select("site_id", "url", "pos", "issue.code", "issue.message")


def issue_stream(responses: DataFrame, path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Writes the issues of arriving responses below path, a folder for each batch; a batch done again replaces its own."""
    config = config or Config()

    def publish(batch: DataFrame, number: int) -> None:
        rows = catalogue.reported(answer_issues(batch, config), batch.sparkSession, config.policy())
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return responses.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Answers by time window and status class, of a stream of (fetched_at, status, duration_s); late ones are dropped."""
    kind = texts.status_class(F.lit(True), F.col("status")).alias("status_class")
    x = events.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", width), kind)
    return x.agg(F.count("*").alias("n"), dates.rounded(F.avg("duration_s")).alias("mean_s"), F.max("duration_s").alias("max_s"))
