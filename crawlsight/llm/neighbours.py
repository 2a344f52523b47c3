"""Nearest neighbours by largest inner product, with collision-counting hashing.

Vectors are scaled by the greatest norm M and given one more component, sqrt(1 - |x|^2), queries are scaled to length 1:
inner products then fall as distances grow. A block of vectors is projected on random directions, each projection sorted
by itself. A query opens a window round its own projection in each sorted array, and widens all windows step by step
(virtual rehashing: no wider index is kept). A vector that is in at least THRESHOLD of the windows is verified by its inner
product. At a radius R the half-width is R: a vector at the distance R is in a window with the probability 0.68, a nearer one
with a higher one. A query ends when the last of its k best lies within R, so most of them are nearer than that.

Vectors are held as fractions of 1 and a power of two of their own, so that no product over- or underflows: any finite
vectors are compared by their true inner products, even where the score, as a double, is infinite or zero.

A block is one task: its index is built once and all queries stream through it, so the work is blocks times queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import on_workers

K = 20
PROJECTIONS = 24
#: Of the windows. A vector at the very edge of the last radius is missed with a probability of 0.05, others with less.
THRESHOLD = 13
RADII = 0.5 * 1.2 ** np.arange(8)
SEED = 23
#: Vectors in a block at most, and bytes of them; and vectors that are worth a task of their own.
BLOCK = 32_768
BLOCK_BYTES = 32 << 20
LEAST_BLOCK = 1_024
#: Queries whose windows are looked up together.
TOGETHER = 256
FOUND = "query_id long, vec_id long, score double, power int, fraction double"
#: What is added to the powers of two of positive products, so that their order is that of the products.
ABOVE = 10_000


def fractions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as m * 2**e, their greatest component at least 1/2 and below 1."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -e[:, None]), e


class Block:
    """The sorted projections of a block of vectors; equal vectors are held once. top: log2 of the greatest norm of all."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, projections: int = PROJECTIONS, seed: int = SEED):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
        again = np.append(True, ids[1:] != ids[:-1]) | new  # a repeated row counts once
        ids, new, vectors = ids[again], new[again], vectors[again]
        self.first = np.flatnonzero(new)
        self.ends = np.append(self.first[1:], len(ids))
        self.ids, (self.x, self.powers) = ids, fractions(vectors[self.first])
        scaled = self.x * np.exp2(self.powers - top)[:, None]
        more = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        self.axes = np.random.default_rng(seed).normal(size=(self.x.shape[1] + 1, projections))
        values = np.hstack([scaled, more[:, None]]) @ self.axes
        self.order = np.ascontiguousarray(values.argsort(axis=0).T)
        self.values = np.ascontiguousarray(np.take_along_axis(values.T, self.order, axis=1))
        self.quick = scaled.astype(np.float32)
        n = len(self.x)
        self.opened, self.scores = np.empty(self.order.size, dtype=self.order.dtype), np.empty(n, dtype=np.float32)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of the windows of queries (fractions): (query, radius, projection); the first are empty, at the query's own place."""
        centres = queries / np.linalg.norm(queries, axis=1, keepdims=True) @ self.axes[:-1]
        steps = np.append(0.0, RADII)
        ends = [[np.searchsorted(v, c[:, None] + side * steps) for v, c in zip(self.values, centres.T, strict=True)] for side in (-1, 1)]
        return tuple(np.stack(e, axis=2) for e in ends)

    def search(self, query_id: int, q: np.ndarray, power: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple]:
        """Rows of FOUND of the k best found for q * 2**power, its own id left out; all of them if there are fewer."""
        n, m = len(self.x), len(self.order)
        quick = (q / np.linalg.norm(q)).astype(np.float32)
        counts, scores = np.zeros(n, dtype=np.int64), self.scores
        scores.fill(-np.inf)  # of those not seen yet
        nearest = np.zeros(0, dtype=np.float32)  # the k + 1 best scores: the query's own row may be the only one of its vector
        for step, radius in enumerate(RADII):
            # What the windows take in beyond those of the step before, on either side.
            parts = [self.order[j, a:b] for j, a, b in zip(range(m), low[step + 1], low[step], strict=True)]
            parts += [self.order[j, a:b] for j, a, b in zip(range(m), high[step], high[step + 1], strict=True)]
            opened = np.concatenate(parts, out=self.opened[: sum(map(len, parts))])
            counts += np.bincount(opened, minlength=n)
            new = np.flatnonzero(counts >= min(THRESHOLD, m))
            counts[new] = -2 * m  # not again
            scores[new] = self.quick[new] @ quick
            nearest = np.append(nearest, scores[new])
            if len(nearest) > k:
                nearest = np.partition(nearest, len(nearest) - k - 1)[len(nearest) - k - 1 :]
                if math.sqrt(max(0.0, 2 - 2 * float(nearest.min()))) <= radius:
                    return self.best(query_id, q, power, k)
        # Beyond the distance of opposite unit vectors there is nothing further to open: the rest is verified.
        new = np.flatnonzero(counts >= 0)
        scores[new] = self.quick[new] @ quick
        return self.best(query_id, q, power, k)

    def best(self, query_id: int, q: np.ndarray, power: int, k: int) -> list[tuple]:
        """The k best of the vectors seen, by their inner products in double precision.

        Those whose scores in single precision are within their error of the k-th best are all compared.
        """
        at = np.flatnonzero(self.scores > -np.inf)
        if len(at) > k + 1:
            edge = np.partition(self.scores[at], len(at) - k - 1)[len(at) - k - 1]
            at = at[self.scores[at] >= edge - 1e-4]
        products, powers = (self.x[at] * q).sum(axis=1), self.powers[at] + power
        with np.errstate(over="ignore", under="ignore"):
            values = np.ldexp(products, powers)
        parts, own = np.frexp(products)
        ranks = (np.sign(products) * (own + powers + ABOVE)).astype(np.int64)
        out = []
        for i, *found in zip(at.tolist(), values.tolist(), ranks.tolist(), parts.tolist(), strict=True):
            members = self.ids[self.first[i] : self.ends[i]][: k + 1].tolist()  # sorted; of equal products the least ids
            out += [(query_id, v, *found) for v in members if v != query_id]
        return sorted(out, key=lambda r: (-r[3], -r[4], r[1]))[:k]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in FOUND.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _vectors(batches: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, all of one length, of batches (dim, asks, vec_id, embedding)."""
    ids = np.concatenate([b.column(2).to_numpy() for b in batches])
    return ids, np.concatenate([b.column(3).flatten().to_numpy() for b in batches]).reshape(len(ids), -1)


def _runs(batches):
    """Batches cut where dim or asks changes: (dim, asks, batch)."""
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield int(keys[a, 0]), bool(keys[a, 1]), batch.slice(a, b - a)


def search_partition(batches, top: float, k: int):
    """Rows (dim, asks, vec_id, embedding) sorted by dim and asks: a block's vectors of a length, then the queries of it."""
    length, held, block = None, [], None
    for dim, asks, batch in _runs(batches):
        if dim != length:
            length, held, block = dim, [], None
        if not asks:
            held.append(batch)
            continue
        if held:
            held, block = [], Block(*_vectors(held), top)
        if block is None:
            continue
        ids, asked = _vectors([batch])
        asked, powers = fractions(asked)
        for at in range(0, len(ids), TOGETHER):
            low, high = block.windows(asked[at : at + TOGETHER])
            found = []
            for i, query_id in enumerate(ids[at : at + TOGETHER].tolist()):
                found += block.search(query_id, asked[at + i], int(powers[at + i]), low[i], high[i], k)
            yield _table(found)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim): rows with an id and a vector that is neither null nor zero, all of it finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    return rows.where(finite).withColumn("dim", F.size("embedding"))


#: log2 of a vector's length, without squares that overflow.
LENGTH = """log2(array_max(transform(embedding, x -> abs(x)))) + 0.5 * log2(
    aggregate(embedding, struct(0D AS s, array_max(transform(embedding, x -> abs(x))) AS g), (a, x) -> struct(a.s + (x / a.g) * (x / a.g) AS s, a.g AS g), a -> a.s))"""


def block_count(n: int, dim: int, cores: int, block: int = BLOCK) -> int:
    """Blocks of n vectors: as many as their bytes ask for, and one a core where there are enough vectors for that."""
    most = max(1, min(block, BLOCK_BYTES // (8 * max(1, dim))))
    return max(1, math.ceil(n / most), min(cores, math.ceil(n / min(most, LEAST_BLOCK))))


def nearest(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each query among all rows but the query's own id.

    vectors: (vec_id, embedding); is_query: a condition on vec_id. Rows with a null id or vector, a zero vector or one
    with null or non-finite components take no part; vectors meet those of their own length only. Vectors of any finite
    size are ranked by their true inner products; a score beyond a double's range is infinite or zero. Ties go to the
    smaller vec_id. A repeated row counts once; an id with several vectors is as many candidates, and as a query the
    least of them. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors)
    n, top, dim = rows.agg(F.count("*"), F.max(F.expr(LENGTH)), F.max("dim")).first()
    blocks = block_count(n, dim or 0, vectors.sparkSession.sparkContext.defaultParallelism, block)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = rows.where(is_query).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns = ["dim", "asks", "vec_id", "embedding"]
    own = rows.select(part.alias("part"), "dim", F.lit(0).alias("asks"), "vec_id", "embedding")
    dealt = own.unionByName(asked.select(every.alias("part"), "dim", F.lit(1).alias("asks"), "vec_id", "embedding"))
    placed = dealt.repartitionById(blocks, F.col("part")).sortWithinPartitions("dim", "asks").select(*columns)
    found = placed.mapInArrow(on_workers(search_partition, float(top or 0.0), k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("power"), F.desc("fraction"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
