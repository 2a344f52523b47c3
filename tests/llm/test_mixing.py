import random
import re

import duckdb
import pandas as pd
import pytest

from crawlsight.llm import mixing
from tests.llm.data import DOCS, documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(budget, caps, weights):
    """Water-filling by hand, in real numbers."""
    given, open_ = dict.fromkeys(caps, 0.0), set(caps)
    left = min(budget, sum(caps.values()))
    while open_:
        share = {k: left * weights[k] / sum(weights[x] for x in open_) for k in open_}
        full = {k for k in open_ if caps[k] <= share[k]}
        if not full:
            return given | share
        for k in full:
            given[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return given




def supply(docs):
    out = {}
    for _, text, lang, source, _ in docs:
        n = re.search(r"([0-9]+)$", source or "")
        domain = {0: "web", 1: "books", 2: "code"}.get(int(n[1]) % 4 if n else -1, "forums")
        key = (domain, lang or "", source or "")
        out[key] = out.get(key, 0) + len(WORD.findall(text or ""))
    return out


def wanted(docs, percent, epochs):
    once = supply(docs)
    caps = {k: v * epochs for k, v in once.items()}
    weight = lambda level, value: mixing.WEIGHTS[level].get(value, 1)
    out = {(): min(sum(once.values()) * percent // 100, sum(caps.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        deeper = {}
        for node, budget in out.items():
            kids = {}
            for k, cap in caps.items():
                if k[:depth] == node:
                    kids[k[: depth + 1]] = kids.get(k[: depth + 1], 0) + cap
            deeper |= fill(budget, kids, {k: weight(level, k[-1]) for k in kids})
        out = deeper
    return out


@pytest.mark.parametrize(("percent", "epochs"), [(50, 4), (90, 2), (100, 1), (300, 2), (0, 4)])
def test_budgets(spark, percent, epochs):
    docs = documents()
    rows = mixing.mix(with_clashes(frame(spark, docs), "domain", "tokens", "copies", "h"), budget_percent=percent, max_epochs=epochs).collect()
    got = {}
    for r in rows:
        got[r.domain, r.lang, r.source] = got.get((r.domain, r.lang, r.source), 0) + r.copies * r.tokens + r.prefix_tokens
    want = wanted(docs, percent, epochs)
    total = sum(supply(docs).values())
    assert sum(got.values()) == min(total * percent // 100, total * epochs)
    assert all(abs(got.get(k, 0) - v) <= 3 for k, v in want.items())
    assert all(r.copies + (r.prefix_tokens > 0) <= epochs for r in rows)


def test_same_as_sql(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", "it"]), f"src{min(rng.randint(0, 9), rng.randint(0, 9))}", 0) for i in range(300)] + documents()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(docs, columns=[x.split()[0] for x in DOCS.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = sorted(map(repr, c.sql(mixing.SQL).fetchall()))
    got = mixing.mix(frame(spark, docs))
    order = [x[0] for x in c.sql(mixing.SQL).description]
    assert sorted(repr(tuple(r[n] for n in order)) for r in got.collect()) == want


def test_texts(spark):
    docs = [d for d in documents() if d[0] is not None and d[0] != 3]
    taken = {r.doc_id: r for r in mixing.mix(frame(spark, docs), budget_percent=90, max_epochs=2).collect()}
    got = mixing.mixed_texts(with_clashes(frame(spark, docs), "tokens", "row", "prefix_tokens"), budget_percent=90, max_epochs=2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "row", "prefix_tokens"]
    texts = {d[0]: d[1] for d in docs}
    held = {}
    for r in got.collect():
        held.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert set(held) == set(taken)
    for i, r in taken.items():
        counts = sorted(len(WORD.findall(t or "")) for t in held[i])
        assert counts == sorted([r.tokens] * r.copies + [r.prefix_tokens] * (r.prefix_tokens > 0))
        assert all(t is None or texts[i].startswith(t) for t in held[i])


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_texts(frame(spark, [])).count() == 0
    blank = [(1, None, None, None, None), (2, " ", "en", "src1", 1)]
    assert mixing.mix(frame(spark, blank)).count() == 0


def test_native(spark):
    plan = mixing.mix(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
