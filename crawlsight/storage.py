"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is open, if any.
_open: list[str] = []


def _own(spark: SparkSession) -> str:
    """A folder for a session that names none: on this machine, which is enough only if all of Spark runs on it."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="crawlsight-")
    spark.sparkContext.setCheckpointDir(f"file://{at}")
    return at


def _base(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own(spark)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the open work folder, or below spark.checkpoint.dir; a folder of our own only on a single machine without that."""
    return f"{_open[-1] if _open else _base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends here, for any lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plans that are worked out at a time: their stages are small, so that one alone leaves most cores idle.
AT_ONCE = 6


def side_by_side(spark: SparkSession, *makes: Callable) -> list:
    """What each of makes gives, in their order; they plan and run at the same time. The first error is raised."""
    with ThreadPoolExecutor(AT_ONCE, "crawlsight") as pool:
        started = [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]
        return [each.result() for each in started]


def ahead(spark: SparkSession, make: Callable) -> Callable:
    """Begins make, and gives a function that waits for what it gives."""
    pool = ThreadPoolExecutor(1, "crawlsight")
    begun = pool.submit(inheritable_thread_target(spark)(make))
    pool.shutdown(wait=False)
    return begun.result


@contextmanager
def work_folder(spark: SparkSession, base: str | None = None) -> Iterator[str]:
    """What is written while it is open lies in one folder below base (or the shared one), and goes when it is closed."""
    at = f"{(base or _base(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
    _open.append(at)
    try:
        yield at
    finally:
        _open.remove(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
