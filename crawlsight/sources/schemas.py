"""The tables an audit reads and makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a crawl captured: one row for each request. phase: warm_up, home, robots, sitemap, crawl or hop.
RESPONSES = (
    "site_id string, phase string, request_url string, status int, primary_status int, primary_location string, final_url string, "
    "location string, headers map<string, array<string>>, content_type string, body binary, size bigint, truncated boolean, "
    "duration_s double, error string, retries int"
)
SITES = "site_id string, url string, ord int"


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A captured table; partition it by site_id and phase, so that each stage reads its own files only."""
    return captured(spark.read.parquet(path))


def captured(df: DataFrame) -> DataFrame:
    """df with the columns of RESPONSES: missing ones and nulls as what an absent value stands for."""
    have = set(df.columns)
    none = {"status": 0, "primary_status": 0, "size": 0, "retries": 0, "truncated": False, "duration_s": 0.0, "headers": None, "body": None}
    out = []
    for column in RESPONSES.split(", "):
        name, _, kind = column.partition(" ")
        if name == "headers":
            kind = "map<string, array<string>>"
        elif name == "array<string>>":
            continue
        value = F.col(f"`{name}`").cast(kind) if name in have else F.lit(None).cast(kind)
        absent = none.get(name, "")
        out.append((value if absent is None else F.coalesce(value, F.lit(absent).cast(kind))).alias(name))
    return df.select(*out)


def bounded(df: DataFrame, limit: int, keep: int) -> DataFrame:
    """Bodies as a client with a limit leaves them: keep bytes, the size counted up to limit, truncated beyond."""
    whole = F.coalesce(F.octet_length("body"), F.lit(0))
    return df.withColumns({
        "size": F.least(whole, F.lit(limit)).cast("bigint"),
        "truncated": whole > limit,
        "body": F.substring("body", 1, min(keep, limit) if keep > 0 else limit).cast("binary"),
    })


def site_rows(spark: SparkSession, urls: list[str]) -> DataFrame:
    """SITES of configured addresses, in their order."""
    from crawlsight.sources.config import normalize_id

    return spark.createDataFrame([(normalize_id(u), u.strip().rstrip("/"), i) for i, u in enumerate(urls)], SITES)
