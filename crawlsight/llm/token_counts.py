"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes becomes signed sums, one row a group, that are written once below the rollup's path; the totals are the
sums over all committed batches. A batch counts from the moment its marker file exists: work cut short before that is
written again, and a batch that is committed already is not applied a second time.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm.common import map_arrow, text_or_empty
from crawlsight.llm.tokens import encoder

GROUP = ("source", "lang", "tokenizer_version")
#: Changes: kind is insert, delete or revise; old_tokens counts for revise only.
CHANGES = "kind string, source string, lang string, tokenizer_version string, tokens long, old_tokens long"
TOTALS = "source string, lang string, tokenizer_version string, documents long, tokens long"


def count_partition(batches, path: str):
    encode = encoder(path)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        counts = [encode.count(t) for t in texts]
        inner = [n if t == t.strip() else encode.count(t.strip()) for t, n in zip(texts, counts, strict=True)]
        arrays = [batch.column(1), pa.array(counts, pa.int64()), pa.array(inner, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "tokens", "inner_tokens"])


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokens of each whole text, and inner_tokens of it without white space at its ends."""
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    rows = docs.select(text_or_empty().alias("text"), doc.alias("doc"))
    schema = "doc struct<doc_id: long, source: string, lang: string>, tokens long, inner_tokens long"
    return map_arrow(rows, count_partition, schema, tokenizer).select("doc.*", "tokens", "inner_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """The changes as additive rows: documents (+1, -1 or 0) and tokens. A null count is 0, an unknown kind an error."""
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("long")
    documents = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong)
    tokens = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old).otherwise(wrong)
    return changes.select(*GROUP, documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


class Rollup:
    """Totals below ``path`` (a folder that driver and executors share). One writer at a time commits a given batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop("/".join((self.path, *names)))

    def _mark(self, name: str, text: str = "") -> None:
        out = self._fs.create(self._at("committed", name), False)
        out.write(text.encode())
        out.close()

    def _marks(self) -> list[str]:
        at = self._at("committed")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _folded(self, base: str) -> set[str]:
        stream = self._fs.open(self._at("committed", base))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return set(json.loads(text))

    def _held(self, marks: list[str]) -> set[str]:
        """Batches within the newest base of the marks."""
        return self._folded(_bases(marks)[-1]) if _bases(marks) else set()

    def _counted(self, marks: list[str]) -> list[str]:
        return sorted({m.removeprefix("batch-") for m in marks if m.startswith("batch-")} | self._held(marks))

    def committed(self) -> list[str]:
        """Batches that count, those within a compacted base too."""
        return self._counted(self._marks())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch (named by letters, digits, - and _) once; False if it was committed before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        sums = signed(changes).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        self._mark(f"batch-{batch}")
        return True

    def _sums(self, marks: list[str]) -> DataFrame:
        """Totals of what the marks name: the newest base and the batches that it doesn't hold."""
        held = self._held(marks)
        parts = _bases(marks)[-1:] + [m for m in marks if m.startswith("batch-") and m.removeprefix("batch-") not in held]
        if not parts:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/{p}" for p in parts])
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, documents, tokens; groups that nothing is left of are left out.

        Null sources, languages and versions are groups of their own. Without any batch there are no rows.
        """
        return self._sums(self._marks())

    def compact(self) -> str:
        """Folds the batches committed when it starts into a new base, which counts from its marker on. Its name.

        One that is committed meanwhile is neither in the base's sums nor in its list, and counts beside it. One
        compaction at a time: a second one of the same number fails at its marker.
        """
        marks = self._marks()
        base = f"base-{len(_bases(marks)):06d}"
        self._sums(marks).write.mode("overwrite").parquet(f"{self.path}/{base}")
        self._mark(base, json.dumps(self._counted(marks)))
        return base


def _bases(marks: list[str]) -> list[str]:
    return [m for m in marks if m.startswith("base-")]
