"""What the operators share: written tables in the shared folder, and functions run on the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.sources import workers
from crawlsight.sources.workers import by_name as on_workers
from crawlsight.storage import shared_path, written

__all__ = ["BATCH_ROWS", "WORD", "map_arrow", "on_workers", "shared_path", "table", "text_or_empty", "written"]

#: Rows that a worker's function is given at a time.
BATCH_ROWS = 500

#: White space that separates words, as a regular expression class that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, fn: Callable, schema: str, *args) -> DataFrame:
    """df.mapInArrow over batches of BATCH_ROWS rows and some megabytes of strings at most."""
    return workers.map_arrow(df, fn, schema, BATCH_ROWS, *args)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
