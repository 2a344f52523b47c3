import random
import zlib

import numpy as np
import pytest

from crawlsight.llm import quality
from tests.llm.data import WORDS, documents, frame, sentence, with_clashes


def junk(rng, n):
    kind = rng.randint(0, 2)
    words = [rng.choice(WORDS) for _ in range(n)]
    if kind == 0:
        return " | ".join(words)
    if kind == 1:
        return " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in words)
    return " ".join([words[0]] * n)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        good = int(rng.random() < 0.7)
        rows.append((i, "\n".join(sentence(rng, 12).capitalize() + "." for _ in range(4)) if good else junk(rng, 40), "en", "s", 0))
        labels.append((i, good))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out(spark, corpus):
    rows, labels = corpus
    got = quality.classify(with_clashes(frame(spark, rows), "score", "quality", "fold"), labelled(spark, labels)).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = ([r.score for r in held if truth[r.doc_id] == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_teach_nothing(spark, corpus):
    rows, labels = corpus
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = ({r.doc_id: r.score for r in quality.classify(frame(spark, rows), labelled(spark, x)).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_cases(spark, corpus):
    rows, labels = corpus
    odd = documents()
    got = quality.classify(frame(spark, rows + [(1000 + (d[0] or 0), *d[1:]) for d in odd] + [(None, "no id", None, None, None)]), labelled(spark, labels + [(None, 1), (3, None), (4, 7), (9999, 1), (5, 0), (5, 1), (5, 1)]))
    rows_ = got.collect()
    assert len(rows_) == len(rows) + len(odd) + 1 and all(r.score is not None for r in rows_)
    assert [r.held_out for r in rows_ if r.doc_id is None] == [False]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_few_labels(spark, corpus, labels):
    got = quality.classify(frame(spark, corpus[0][:20]), labelled(spark, labels)).collect()
    assert len(got) == 20 and all(0 <= r.score <= 1 for r in got)


def test_empty(spark, corpus):
    assert quality.classify(frame(spark, []), labelled(spark, corpus[1])).count() == 0


def test_keep_good(spark, corpus):
    rows, labels = corpus
    df = with_clashes(frame(spark, rows), "row", "score")
    kept = quality.keep_good(df, labelled(spark, labels))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, q in labels if q} <= ids and len(ids - {i for i, q in labels if q}) <= 3


def test_kernel():
    """The cosines' inner products come near the Gaussian kernel."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.STATISTICS))
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), size=20_000)
    z = model.cosines(x)[:, :-1]
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gaps / (2 * model.width**2))).max() < 0.05


def test_pooled():
    x, y = quality.pooled([(0, 1.0, 10), (1, 0.0, 10), (2, 5.0, 10), (3, 10.0, 10)])
    assert y.tolist() == [0.05, 0.05, 0.5, 0.5, 1.0, 1.0] and (np.diff(x) > 0).all()


def test_sample_is_a_bound(spark, corpus):
    """Copies of a labelled row are one document, and no more documents are fitted than asked for."""
    rows, labels = corpus
    copies = frame(spark, [(1, "one and the same text", None, None, 0)] * 3000 + rows)
    assert quality.labelled(copies, labelled(spark, [(1, 1)]), 10).count() == 2
    assert quality.labelled(copies, labelled(spark, labels), 10).count() == 10
    texts = frame(spark, [(1, f"text {i}", None, None, 0) for i in range(300)])
    assert quality.labelled(texts, labelled(spark, [(1, 1)]), 10).count() == 10


def test_against_a_direct_fit(spark, corpus):
    """Scores of the distributed fit, against a ridge solved on all rows at once and calibrated by hand."""
    rows, labels = corpus
    truth = dict(labels)
    taught = sorted(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    texts = {r[0]: r[1] for r in rows}
    x, y = np.array([quality.statistics(texts[i]) for i in taught]), np.array([float(truth[i]) for i in taught])
    scale = x.std(axis=0)
    model = quality.Model(x.mean(axis=0), np.where(scale > 1e-6, scale, 1.0))
    z = np.hstack([np.sqrt(2 / len(model.b)) * np.cos(np.clip((x - model.mean) / model.scale, -8, 8) @ model.w + model.b), np.ones((len(x), 1))])

    def ridge(chosen):
        """Least squares with the penalty as added rows."""
        n, size = chosen.sum(), z.shape[1]
        penalty = np.append(np.full(size - 1, quality.RIDGE * n / size + 1e-6), 1e-9)
        return np.linalg.lstsq(np.vstack([z[chosen], np.diag(np.sqrt(penalty))]), np.append(y[chosen], np.zeros(size)), rcond=None)[0]

    fold = np.array([zlib.crc32(f"fold{i}".encode()) % quality.FOLDS for i in taught])
    raw = np.zeros(len(x))
    for k in range(quality.FOLDS):
        raw[fold == k] = np.clip(z[fold == k] @ ridge(fold != k), -0.5, 1.5)
    bins = np.floor((raw + 0.5) / 2 * quality.BINS).astype(int)
    used = np.unique(bins)
    sums = np.array([[y[bins == b].sum(), (bins == b).sum()] for b in used])
    # Isotonic by its min-max formula: at each bin the largest, over starts, of the least mean, over ends.
    mean = lambda a, b: sums[a : b + 1, 0].sum() / sums[a : b + 1, 1].sum()
    steps = [max(min(mean(a, b) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    edges, levels = [], []
    for level in sorted(set(np.round(steps, 12))):
        own = [used[i] for i in range(len(used)) if round(steps[i], 12) == level]
        edges += [(own[0] + 0.25) / quality.BINS * 2 - 0.5, (own[-1] + 0.75) / quality.BINS * 2 - 0.5]
        levels += [level, level]
    beta = ridge(np.ones(len(x), dtype=bool))
    got = {r.doc_id: r.score for r in quality.classify(frame(spark, rows), labelled(spark, labels)).collect()}
    stats = np.array([quality.statistics(texts[i]) for i in sorted(texts)])
    own = np.clip(np.hstack([np.sqrt(2 / len(model.b)) * np.cos(np.clip((stats - model.mean) / model.scale, -8, 8) @ model.w + model.b), np.ones((len(stats), 1))]) @ beta, -0.5, 1.5)
    want = (1 - quality.ORDER) * np.interp(own, edges, levels) + quality.ORDER * (own + 0.5) / 2
    gaps = np.abs(np.array([got[i] for i in sorted(texts)]) - np.clip(want, 0, 1))
    assert (gaps < 1e-6).mean() > 0.99 and np.median(gaps) < 1e-9
