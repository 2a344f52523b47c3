"""Document fingerprints by consistent weighted sampling.

Terms are a text's runs of five words (lower-cased; of fewer words the whole sequence), weighted by how often they come.
For each of SAMPLES samples a term has a fixed c ~ Gamma(2, 1), and r ~ Gamma(2, 1) and beta ~ U(0, 1), looked up in two
pools by separate bits of a hash of term and sample; with t = floor(ln w / r + beta) and y = exp(r (t - beta)) the term
with the least c / (y exp(r)) is sampled, and (term, t) enters the signature. Two signatures agree at a place with the probability of the generalised Jaccard
similarity, sum of least weights over sum of greatest. Terms of the same two entries are ranked by hash, alike everywhere.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import map_arrow, text_or_empty

SAMPLES = 128
SHINGLE = 5
SEED = 5
POOL_BITS = 16
POOL = (1 << POOL_BITS) - 1
#: Terms that are sampled at a time, and words whose hashes a worker remembers.
CHUNK = 4096
REMEMBERED = 1 << 20
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS = 8
MOST_BUCKETS = 1 << 14
LEAST_ID = -(1 << 63)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Sampler:
    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.samples, self.shingle, self.words = samples, shingle, _Words()
        self.r, self.c = (rng.gamma(2.0, 1.0, size) for _ in range(2))
        self.beta = rng.uniform(0.0, 1.0, size)
        self.first = self.c.astype(np.float32)
        self.once = np.exp(-self.r * (1 - self.beta)).astype(np.float32)  # the other factor at weight 1, where t is 0
        self.odd = (rng.integers(0, 1 << 63, samples, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)).view(np.int64)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the terms, and their weights."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.shingle, len(words))
        whole = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(whole)]
        return np.unique(_mixed(whole), return_counts=True)

    def signature(self, text: str) -> np.ndarray:
        """Sixteen bits of each sampled (term, t); zeros for a text without words."""
        hashes, weights = self.terms(text)
        best = np.full(self.samples, np.inf, np.float32)
        found = np.zeros(self.samples, np.uint64)
        every = np.arange(self.samples)
        for at in range(0, len(hashes), CHUNK):
            h, w = hashes[at : at + CHUNK], weights[at : at + CHUNK]
            mixed = h.view(np.int64)[None, :] * self.odd  # overflow wraps; the upper bits are the best mixed
            at_c, at_r = (mixed >> (64 - POOL_BITS)) & POOL, (mixed >> (64 - 2 * POOL_BITS)) & POOL
            a = self.first.take(at_c)
            a *= self.once.take(at_r)
            more = np.flatnonzero(w > 1)
            if len(more):
                r, beta = self.r[at_r[:, more]], self.beta[at_r[:, more]]
                t = np.floor(np.log(w[more]) / r + beta)
                a[:, more] = self.c[at_c[:, more]] * np.exp(-r * (t - beta + 1))
            least = a.argmin(axis=1)
            values = h[least]
            if len(more):
                place = np.searchsorted(more, least)
                heavy = np.flatnonzero(more[np.minimum(place, len(more) - 1)] == least)
                values[heavy] ^= t[heavy, place[heavy]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            low = a[every, least]
            better = low < best
            best[better], found[better] = low[better], values[better]
        return (_mixed(found) >> np.uint64(48)).astype(">u2")


@cache
def sampler(samples: int, shingle: int, seed: int) -> Sampler:
    return Sampler(samples, shingle, seed)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint_partition(batches, *params):
    own = sampler(*params)
    for batch in batches:
        prints = [own.signature(t).tobytes().hex() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs (doc_id, text): four hexadecimal digits for each sample.

    A null or blank text has zeros; a null doc_id stays; repeated rows come as often as they are; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(rows, fingerprint_partition, "doc_id long, fingerprint string", samples, shingle, seed)


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, kind, did, doc_id, text), sorted in partitions so that a document's next one follows it there.

    Buckets are ranges of doc_id between quantiles. The documents at a bucket's start also stand, as kind 1, at the end
    of the bucket before, and the first of all, as kind 2, at the end of the last. Null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("did"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(BUCKETS * parts, MOST_BUCKETS)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("did"))
    first = ids.agg(F.min("did")).first()[0]
    # As percentile_approx, not approxQuantile: ids stay whole numbers, and every bound is a document's id.
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = sorted({b for b in ids.agg(F.percentile_approx("did", shares, 20 * n)).first()[0] or [] if b != first})
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]
    at = F.array(*[F.lit(b) for b in bounds]) if bounds else F.expr("cast(array() AS array<bigint>)")
    up = lambda low, step: F.when(F.get(at, low + step - 1) <= F.col("did"), low + step).otherwise(low)
    bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), up)
    placed = rows.withColumn("bucket", bucket)
    opens = F.when(F.get(at, F.col("bucket") - 1) == F.col("did"), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("kind")))
    wraps = F.when(F.col("did") == F.lit(first), F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("kind")))
    places = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("kind")), opens, wraps))
    spread = placed.withColumn("place", F.explode(places)).select("place.bucket", "place.kind", "did", "doc_id", "text")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "did", F.xxhash64("text"), "text")


def edited_partition(batches, *params):
    """Each row of kind 0 with the one after it."""
    own = sampler(*params)
    before = None
    for batch in batches:
        out: list[tuple] = []
        for _, kind, _, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            signature = None
            if before is not None:
                last_id, last_text, last = before
                signature = own.signature(text)
                n = len(last_text)
                changed = last_text[: n - n // 2] + text[: n // 2]
                edited = own.signature(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((last_id, n, digest, last.tobytes().hex(), edited.tobytes().hex(), likeness(last, edited), likeness(last, signature)))
            before = (doc_id, text, own.signature(text) if signature is None else signature) if kind == 0 else None
        yield pa.RecordBatch.from_pylist([dict(zip(EDITED.names, x, strict=True)) for x in out], schema=EDITED)


EDITED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
EDITED_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text) and of its edited text, and their likeness to each other and to the next.

    The edited text ends with as many code points of the next document's start as half of the text has (rounded down),
    or all it has. Next: by doc_id, nulls first, rows of one doc_id by a hash of the text; after the last the first. Null
    texts are empty; a table of one row is its own next; an empty one gives no rows; other columns are ignored.
    """
    if docs.select("doc_id").isEmpty():
        return docs.sparkSession.createDataFrame([], EDITED_SCHEMA)
    return map_arrow(beside_next(docs), edited_partition, EDITED_SCHEMA, samples, shingle, seed)
