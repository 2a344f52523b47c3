"""Checks of arriving answers."""

from pyspark.sql import functions as F

from crawlsight.sources.config import Config
from crawlsight.streaming import stream
from tests.helpers import NURSERY, captured, responses


def test_issue_stream(spark, tmp_path):
    rows = [r for r in captured() if r["phase"] == "crawl"]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    responses(spark, rows[:10]).write.parquet(source)
    stream.issue_stream(stream.read_stream(spark, source), out, state).awaitTermination()
    responses(spark, rows[10:]).write.mode("append").parquet(source)
    stream.issue_stream(stream.read_stream(spark, source), out, state).awaitTermination()
    got = {(r.url.removeprefix(NURSERY), r.code) for r in spark.read.parquet(out).collect()}
    want = {(r.url.removeprefix(NURSERY), r.code) for r in stream.answer_issues(responses(spark, rows), Config()).collect()}
    assert got == want and {("/orchid", "NOINDEX"), ("/spring", "URL_REDIRECT"), ("/lotus", "CANONICAL_INVALID"), ("/daisy", "CANONICAL_MISMATCH"), ("/reed", "SOFT_404"), ("/seeds.zip", "CONTENT_NOT_HTML")} <= got


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    at = "2026-01-01 00:0%d:00"
    rows = [(at % m, s, d) for m, s, d in ((0, 200, 1.0), (1, 200, 2.0), (6, 404, 0.5), (7, 0, 0.1))]
    spark.createDataFrame(rows, "at string, status int, duration_s double").select(F.col("at").cast("timestamp").alias("fetched_at"), "status", "duration_s").write.parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = stream.status_windows(live).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.window.start), r.status_class): (r.n, r.mean_s, r.max_s) for r in spark.table("windows").collect()}
    assert got == {("2026-01-01 00:00:00", "2xx"): (2, 1.5, 2.0), ("2026-01-01 00:05:00", "4xx"): (1, 0.5, 0.5), ("2026-01-01 00:05:00", "no response"): (1, 0.1, 0.1)}
