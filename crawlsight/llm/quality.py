"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Random cosines of the standardised statistics approximate a Gaussian kernel. Each partition sums its rows' share of the
normal equations, by fold; the driver adds up a few such sums and solves them once a fold and once for all. Scores of
rows by the weights fitted without their fold are counted by label in narrow bins, and pooling adjacent violators over
the bins gives the calibration. Only statistics of the text are inputs.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import BATCH_ROWS, map_arrow, on_workers, text_or_empty, written
from crawlsight.sources.workers import slices

#: Labelled documents that are fitted, at most: the first by a hash of doc_id. Copies of a row count once.
SAMPLE = 20_000
#: Partitions that these rows' statistics and sums are made in.
PARTS = 8
FEATURES = 192
SEED = 11
RIDGE = 1e-3
FOLDS = 5
#: Bins of scores, between -0.5 and 1.5.
BINS = 2000
REJECT = 0.3
#: Part of the final score that keeps the order of ridge scores within a calibrated step.
ORDER = 1e-3

_GROUPS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "beyond": range(0x80, 0x100),
    "stop": b".,;:",
    "bang": b"!?",
    "bar": b"|",
    "bracket": b"()[]{}<>",
    "sign": b"#$%&*+=@\\^_`~/",
    "newline": b"\n",
}


def _weights() -> np.ndarray:
    table = np.zeros((256, len(_GROUPS)))
    for j, group in enumerate(_GROUPS.values()):
        table[list(group), j] = 1
    return table


BYTES = _weights()
STATISTICS = len(_GROUPS) + 10


def statistics(text: str) -> np.ndarray:
    """Shares and logarithms that say how a text is made; zeros for one without words."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return np.zeros(STATISTICS)
    n, size = len(words), len(data)
    shares = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ BYTES / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = text.split("\n")
    own = [
        np.log1p(n) / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        (lengths <= 3).mean(),
        len(counts) / n,
        np.log(len(counts)) / np.log1p(n),
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5,
    ]
    return np.concatenate([np.sqrt(shares), own])


class Model:
    """What a score is made of: standardisation, random cosines, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, size: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.width = np.sqrt(2 * len(self.mean))  # of the Gaussian kernel: the usual distance of two standardised rows
        self.w = rng.normal(size=(len(self.mean), size)) / self.width
        self.b = rng.uniform(0, 2 * np.pi, size)
        self.beta, self.x, self.y = np.zeros(size + 1), np.array([0.0]), np.array([0.5])

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray, beta=None) -> np.ndarray:
        return np.clip(self.cosines(stats) @ (self.beta if beta is None else beta), -0.5, 1.5)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.raw(np.array([statistics(t) for t in texts]))
        return np.clip((1 - ORDER) * np.interp(raw, self.x, self.y) + ORDER * (raw + 0.5) / 2, 0, 1)


def statistics_partition(batches):
    for batch in batches:
        stats = [statistics(t) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "quality", "tk", "stats"])


def _rows(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stats = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), stats


def moments_partition(batches):
    n, s, q = 0, np.zeros(STATISTICS), np.zeros(STATISTICS)
    for batch in batches:
        x = _rows(batch)[2]
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"sums": pa.array([[float(n), *s, *q]], pa.list_(pa.float64()))})


def equations_partition(batches, model: Model):
    size = len(model.beta)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        fold, y, stats = _rows(batch)
        z = np.hstack([model.cosines(stats), y[:, None]])
        for k in set(fold.tolist()):
            own = z[fold == k]
            sums[k] = sums.get(k, np.zeros((size + 1, size + 1))) + own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.ravel() for x in sums.values()], pa.list_(pa.float64()))], names=["fold", "sums"])


def bins_partition(batches, model: Model, betas: dict):
    seen: Counter = Counter()
    good: Counter = Counter()
    for batch in batches:
        fold, y, stats = _rows(batch)
        for k in set(fold.tolist()):
            bins = np.floor((model.raw(stats[fold == k], betas[k]) + 0.5) / 2 * BINS).astype(int)
            for b, label in zip(bins.tolist(), y[fold == k].tolist(), strict=True):
                seen[b] += 1
                good[b] += label
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([float(good[b]) for b in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["bin", "good", "n"])


def pooled(bins: list[tuple[int, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin, sum of labels, rows): both ends of each step, and its mean, rising."""
    blocks: list[tuple] = []
    for b, good, n in sorted(bins):
        blocks.append((good, n, b, b))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            (good, n, _, high), (g, m, low, _) = blocks.pop(), blocks.pop()
            blocks.append((good + g, n + m, low, high))
    ends = [(b + side) / BINS * 2 - 0.5 for _, _, low, high in blocks for b, side in ((low, 0.25), (high, 0.75))]
    return np.array(ends), np.repeat([g / n for g, n, _, _ in blocks], 2)


def solve(sums: np.ndarray) -> np.ndarray:
    gram, target = sums[:-1, :-1], sums[:-1, -1]
    n = max(1.0, gram[-1, -1])  # the constant's own entry counts the rows
    penalty = np.full(len(gram), RIDGE * n / len(gram) + 1e-6)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), target)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(fold, quality, stats) of at most ``sample`` labelled documents that aren't held out, the first by a hash of doc_id.

    Rows of one doc_id, label and text are one document, so copies of a labelled row, however many, don't count again.
    """
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    single = rows.groupBy("doc_id", F.col("quality").cast("long").alias("quality"), F.xxhash64("text").alias("tk")).agg(F.first("text").alias("text"))
    stats = map_arrow(single, statistics_partition, "doc_id long, quality long, tk long, stats array<double>")
    chosen = stats.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "tk").limit(sample)
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % FOLDS
    return written(chosen.select(fold.alias("fold"), "quality", "stats"), "quality-rows")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, quality 0 or 1) of docs (doc_id, text) that aren't held out.

    Rows with another or no quality, or a null doc_id, teach nothing; a document with both labels counts once for each,
    a repeated row once, a doc_id with several texts once for each; null texts are empty. Without any row all scores are about one half.
    """
    rows = labelled(docs, labels, sample).coalesce(PARTS)
    sums = np.array([r.sums for r in map_arrow(rows, moments_partition, "sums array<double>").collect()]).reshape(-1, 2 * STATISTICS + 1).sum(axis=0)
    n, mean = sums[0], sums[1 : STATISTICS + 1] / max(1, sums[0])
    scale = np.sqrt(np.maximum(sums[STATISTICS + 1 :] / max(1, n) - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0))
    if not n:
        return model
    size = len(model.beta) + 1
    by_fold: dict[int, np.ndarray] = {}
    for r in map_arrow(rows, equations_partition, "fold long, sums array<double>", model).toLocalIterator():
        by_fold[r.fold] = by_fold.get(r.fold, 0) + np.array(r.sums).reshape(size, size)
    total = sum(by_fold.values())
    betas = {k: solve(total - x if len(by_fold) > 1 else total) for k, x in by_fold.items()}
    bins = map_arrow(rows, bins_partition, "bin long, good double, n long", model, betas).groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    model.beta = solve(total)
    model.x, model.y = pooled([(r.bin, r.good, r.n) for r in bins.collect()])
    return model


def score_arrays(arrays, model: Model):
    for texts in arrays:
        parts = [model.scores(part.column(0).to_pylist()) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), BATCH_ROWS)]
        yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of each whole text (null: empty), 0 to 1; a column of that name is replaced."""
    from collections.abc import Iterator

    run = on_workers(score_arrays, model)

    def own(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(arrays)

    own.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(column, F.arrow_udf(own, "double")(text_or_empty()))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= REJECT) of each row of docs (doc_id, text).

    held_out is false for a null doc_id; repeated rows are scored alike; an empty table gives no rows.
    """
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that the classifier doesn't reject."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return scored(packed, fit(docs, labels, sample)).where(F.col("score") >= REJECT).select("row.*")
