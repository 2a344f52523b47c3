import random
import re

import pytest
import xxhash

from crawlsight.llm import simhash
from crawlsight.llm.components import components
from tests.llm.data import documents, frame, with_clashes


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id of each print's component, by all pairs."""
    distinct, parent = sorted({p for _, p in prints}), {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                parent[find(a)] = find(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(doc_id, least.get(find(p), doc_id))
    return [(doc_id, p, least.get(find(p))) for doc_id, p in prints]


def test_near_duplicates(spark):
    docs = documents()
    got = simhash.near_duplicates(with_clashes(frame(spark, docs), "fp", "root", "component_id", "tk"))
    want = brute_components([(d[0], brute_print(d[1])) for d in docs])
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_links_of_clustered_prints(spark):
    """Many prints a few bits apart, and words as texts that make none of them: long chains, crowded segments."""
    rng = random.Random(1)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(120):
            centre_ = rng.choice(sorted(prints))
            for b in rng.sample(range(64), rng.randint(1, 3)):
                centre_ ^= 1 << b
            prints.add(centre_)
    compare(spark, prints, simhash.COMMON)


@pytest.mark.parametrize("common", [0, 3, simhash.COMMON, 10**6])
@pytest.mark.parametrize("low", [True, False])
def test_links_of_a_common_segment(spark, common, low):
    """A third of the prints share one segment, so that its bucket is split; balls of others reach into it."""
    rng = random.Random(2)
    shared = rng.getrandbits(32)
    place = lambda own, other: own << 32 | other if low else other << 32 | own
    others = {rng.getrandbits(32)}
    while len(others) < 150:
        x = rng.choice(sorted(others))
        for b in rng.sample(range(32), rng.randint(1, 4)):
            x ^= 1 << b
        others.add(x)
    prints = {place(x, shared) for x in others}
    prints |= {place(rng.choice(sorted(others)) ^ (1 << rng.randrange(32)) * rng.randint(0, 1), shared ^ 1 << rng.randrange(32)) for _ in range(150)}
    prints |= {place(rng.choice(sorted(others)), shared ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)) for _ in range(100)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    compare(spark, prints, common)


def compare(spark, prints, common):
    """Links connect the same prints as all pairs do."""
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), common)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    want = {p: c for p, _, c in brute_components([(i, p) for i, p in enumerate(sorted(prints))]) for p in [p]}
    groups = {}
    for i, p, c in brute_components([(i, p) for i, p in enumerate(sorted(prints))]):
        groups.setdefault(c, set()).add(p - (1 << 64) if p >> 63 else p)
    assert want
    for group in groups.values():
        if len(group) > 1:
            assert len({roots[p] for p in group}) == 1
    assert len({roots[p] for p in roots}) == sum(len(g) > 1 for g in groups.values())


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(0, n, 1)] + [(1000 + i, 1000) for i in range(1, 200)] + [(7, 7), (5000, 5001), (5001, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and got[5000] == got[5001] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(spark):
    docs = documents()
    want = {c for _, _, c in brute_components([(d[0], brute_print(d[1])) for d in docs])}
    got = simhash.representatives(with_clashes(frame(spark, docs), "row", "did", "place"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "did", "place"]
    rows = got.collect()
    assert len(rows) == len(want) and {r.doc_id for r in rows} == want
    texts = {d[0]: d[1] for d in docs}
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id is not None)


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.representatives(frame(spark, [])).count() == 0


def test_fingerprint():
    for text in ["", "a", "A b", "a b c", "The the THE the the", "ÜBER über Straße x", "\x0bx\x0cy\x1cz w"]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_print(text)
    assert simhash.fingerprint("one two three " * 30_000) & (1 << 64) - 1 == brute_print("one two three " * 30_000)
