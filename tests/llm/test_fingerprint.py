import hashlib
import random
from collections import Counter

import numpy as np

from crawlsight.llm import fingerprint
from tests.llm.data import documents, frame, sentence, with_clashes


def jaccard(a, b):
    """Generalised: least over greatest weights."""
    terms = lambda t: Counter(zip(*(t.lower().split()[i:] for i in range(5)), strict=False))
    x, y = terms(a), terms(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_collision_rate():
    """Over many samples signatures agree as often as the generalised Jaccard similarity says, weights and all."""
    rng = random.Random(7)
    sampler = fingerprint.Sampler(samples=4096)
    base = sentence(rng, 300)
    loop = "one two three four five six "
    pairs = [(base, base[:900] + sentence(rng, 150)), (base, base + " " + base), (loop * 30, loop * 10), (loop * 20 + base, loop * 5 + base), (base, sentence(rng, 300))]
    for a, b in pairs:
        got = fingerprint.likeness(sampler.signature(a), sampler.signature(b))
        assert abs(got - jaccard(a, b)) < 0.03


def test_signature():
    s = fingerprint.Sampler()
    assert (s.signature("a b c d e f") == s.signature("A  b\tc d\ne f")).all() and not s.signature(" ").any() and s.signature("x").any()
    long = "one two three four five six seven " * 3000
    assert len(s.signature(long)) == fingerprint.SAMPLES and (s.signature(long) == fingerprint.Sampler().signature(long)).all()


def expected(docs):
    """(text, edited text, next text) by the order of the table."""
    order = sorted(docs, key=lambda d: (fingerprint.LEAST_ID if d[0] is None else d[0]))
    out = []
    for i, d in enumerate(order):
        text, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        out.append((d[0], text, text[: len(text) - len(text) // 2] + after[: len(text) // 2], after))
    return out


def test_edited(spark):
    docs = [d for i, d in enumerate(documents()) if d not in documents()[:i] and d[1:] != (None,) * 4]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(with_clashes(frame(spark, docs), "bucket", "kind", "did", "fingerprint")).collect()}
    s = fingerprint.Sampler()
    assert len(got) == len(docs)
    for doc_id, text, edited, after in expected(docs):
        r = got[doc_id]
        a, b, c = (s.signature(t) for t in (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r.near_edited, r.near_next) == ((a == b).mean(), (a == c).mean())
    assert fingerprint.edited_fingerprints(frame(spark, docs)).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_ties_and_sizes(spark):
    one = fingerprint.edited_fingerprints(frame(spark, [(5, "a b c d e f g h", None, None, None)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c d a b c d").hexdigest()[:64] or one[0].n_chars == 15
    assert fingerprint.edited_fingerprints(frame(spark, [])).count() == 0
    rows = [(1, "same text here", None, None, None)] * 40 + [(None, None, None, None, None)] * 2 + [(2, "x", None, None, None)]
    assert fingerprint.edited_fingerprints(frame(spark, rows)).count() == len(rows)


def test_plain(spark):
    docs = documents()
    got = fingerprint.fingerprints(frame(spark, docs)).collect()
    s = fingerprint.Sampler()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted(((d[0], s.signature(d[1] or "").tobytes().hex()) for d in docs), key=repr)


def test_buckets(spark):
    """Many buckets, one document in most: each still meets the next one."""
    rows = [(i * 3, f"text number {i} of many", None, None, None) for i in range(500)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    assert got == {d: hashlib.sha256(e.encode()).hexdigest() for d, _, e, _ in expected(rows)}
    assert np.unique(list(got)).size == 500
