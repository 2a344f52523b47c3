import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlsight.llm import neighbours


def table(spark, vectors, ids=None):
    rows = [(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute(vectors, query, k):
    """Ids of the nearest, by inner products of the vectors as single-precision numbers."""
    x = {i: np.float32(v).astype(np.float64) for i, v in vectors.items()}
    order = sorted((-(x[i] * x[query]).sum(), i) for i in x if i != query)
    return [i for _, i in order[:k]]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall(spark):
    """Clusters and noise, not scaled to one length, over several blocks of vectors and of queries."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = np.vstack([centres[rng.integers(20, size=900)] + 0.4 * rng.normal(size=(900, 24)), rng.normal(size=(600, 24))]) * rng.uniform(0.5, 2, size=(1500, 1))
    got = found(neighbours.nearest(table(spark, x), F.col("vec_id") % 20 == 0, block=400))
    vectors = dict(enumerate(x))
    assert set(got) == set(range(0, 1500, 20))
    hits = sum(len({v for _, v, _ in got[q]} & set(brute(vectors, q, 20))) for q in got)
    assert hits / (20 * len(got)) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {v for _, v, _ in rows}
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert s == (np.float32(x[v]).astype(float) * np.float32(x[q]).astype(float)).sum()


def test_ties_and_bad_rows(spark):
    v = [1.0, 0.0, 0.5]
    vectors = [v] * 60 + [None, [0, 0, 0], [1, None, 0], [math.nan, 1, 1], [math.inf, 1, 1], [], [1, 2], [3, 1]]
    df = table(spark, vectors).withColumn("label", F.lit(1)).withColumn("round", F.lit("clash")).withColumn("block", F.lit(2))
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=10))
    assert set(got) == {0, 20, 40}
    assert [x for _, x, _ in got[20]] == [i for i in range(21) if i != 20][:20] and {s for _, _, s in got[20]} == {1.25}
    pairs = found(neighbours.nearest(df, F.col("vec_id").isin(66, 63)))
    assert {q: [x for _, x, _ in r] for q, r in pairs.items()} == {66: [67]}


def test_few_and_repeated(spark):
    got = found(neighbours.nearest(table(spark, [[1, 0], [0, 1], [-1, 0], [1, 0]], [0, 1, 2, 0]), F.col("vec_id") == 0))
    assert [(x, s) for _, x, s in got[0]] == [(1, 0.0), (2, -1.0)]
    assert neighbours.nearest(table(spark, [[1.0]]), F.col("vec_id") == 0).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [[1, 2], [3, 4]], [None, 0]), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("scales", [[1e-200], [1e40], [1e200], [5e-324 * 2**40], [1e300], [1e-200, 1.0], [1e-160, 1e200, 1e-3]])
def test_any_finite_size(spark, scales):
    """Against exact arithmetic, where squares or products leave the doubles' range."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)) * np.array([scales[i % len(scales)] for i in range(400)])[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=150))
    whole = [[Fraction(float(c)) for c in v] for v in x]
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, rows in got.items():
        exact = {i: sum(a * b for a, b in zip(v, whole[q], strict=True)) for i, v in enumerate(whole) if i != q}
        best = sorted(exact, key=lambda i: (-exact[i], i))[:20]
        hits += len({v for _, v, _ in rows} & set(best))
        assert len(rows) == 20 and not any(math.isnan(s) for _, _, s in rows)
        gaps = [exact[a] - exact[b] for (_, a, _), (_, b, _) in itertools.pairwise(rows)]
        assert all(g >= -abs(exact[rows[0][1]]) * Fraction(1, 10**12) for g in gaps)
    assert hits >= 0.9 * 20 * len(got)


def test_blocks(spark):
    """A task a core for some thousand vectors, blocks of bounded bytes beyond; the same results whatever the blocks."""
    count = neighbours.block_count
    assert [count(n, 64, 8) for n in (0, 1, 1024, 5000, 9000, 10**6)] == [1, 1, 1, 5, 8, 31]
    assert count(10**6, 4096, 8) * neighbours.BLOCK_BYTES >= 10**6 * 4096 * 8
    x = np.random.default_rng(5).normal(size=(3000, 4))
    a, b = (found(neighbours.nearest(table(spark, x), F.col("vec_id") % 100 == 0, block=n)) for n in (3000, 500))
    assert set(a) == set(b) == set(range(0, 3000, 100)) and np.mean([a[q] == b[q] for q in a]) > 0.8


def test_collisions_decide():
    """A vector is verified once enough windows hold it: with none at all, the search ends by opening everything."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    block = neighbours.Block(np.arange(300), x, np.log2(np.linalg.norm(x, axis=1).max()))
    low, high = block.windows(x[:1])
    assert (np.diff(low[0], axis=0) <= 0).all() and (np.diff(high[0], axis=0) >= 0).all() and (low[0][0] == high[0][0]).all()
    assert len(block.search(0, x[0], 0, low[0], high[0], 500)) == 299
