from collections import Counter

import pytest
from tokenizers import Tokenizer

from crawlsight.llm import token_counts
from crawlsight.llm.queries import tokenizer_path
from crawlsight.llm.token_counts import CHANGES, Rollup
from crawlsight.storage import shared_path
from tests.llm.data import documents, frame, with_clashes


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=repr)


@pytest.fixture
def rollup(spark):
    return Rollup(spark, shared_path(spark, "rollup"))


def test_counts(spark):
    docs = documents()
    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = True
    count = lambda t: len(slow.encode(t, add_special_tokens=False).ids)
    got = token_counts.counted(with_clashes(frame(spark, docs), "tokens", "doc"), tokenizer_path()).collect()
    want = [(d[0], d[3], d[2], count(d[1] or ""), count((d[1] or "").strip())) for d in docs]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.counted(frame(spark, []), tokenizer_path()).count() == 0


def test_deltas(spark, rollup):
    assert totals(rollup) == []
    assert rollup.commit("a", changes(spark, ("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, 99), ("insert", None, None, "v1", None, None)))
    assert totals(rollup) == [("s", "en", "v1", 15 and 2, 15), (None, None, "v1", 1, 0)]
    assert rollup.commit("b", changes(spark, ("revise", "s", "en", "v1", 7, 5), ("delete", "s", "en", "v1", 10, None), ("insert", "s", "en", "v2", 11, None), ("delete", None, None, "v1", 0, None)))
    assert totals(rollup) == [("s", "en", "v1", 1, 7), ("s", "en", "v2", 1, 11)]
    assert not rollup.commit("a", changes(spark, ("insert", "s", "en", "v1", 1000, None)))  # a batch counts once, whatever it holds
    assert not rollup.commit("b", changes(spark)) and totals(rollup) == [("s", "en", "v1", 1, 7), ("s", "en", "v2", 1, 11)]
    assert rollup.commit("empty", changes(spark)) and rollup.committed() == ["a", "b", "empty"]


def test_cut_short(spark, rollup):
    """Files without a marker don't count, and are written anew."""
    changes(spark).selectExpr("source", "lang", "tokenizer_version", "1L AS documents", "tokens").write.parquet(f"{rollup.path}/batch-x")
    assert totals(rollup) == [] and rollup.commit("x", changes(spark, ("insert", "s", "en", "v", 3, None)))
    assert totals(rollup) == [("s", "en", "v", 1, 3)]


def test_compaction(spark, rollup):
    for i in range(4):
        rollup.commit(f"n{i}", changes(spark, ("insert", "s", "en", "v", i, None)))
    before = totals(rollup)
    assert rollup.compact() == "base-000000" and totals(rollup) == before
    assert not rollup.commit("n2", changes(spark, ("insert", "s", "en", "v", 50, None)))
    rollup.commit("n4", changes(spark, ("insert", "s", "en", "v", 4, None)))
    assert rollup.compact() == "base-000001" and totals(Rollup(spark, rollup.path)) == [("s", "en", "v", 5, 10)]
    assert rollup.committed() == ["n0", "n1", "n2", "n3", "n4"]


def test_commit_during_compaction(spark, rollup, monkeypatch):
    """A batch that is committed while others are folded counts once."""
    rollup.commit("a", changes(spark, ("insert", "s", "en", "v", 1, None)))
    sums, other = Rollup._sums, Rollup(spark, rollup.path)

    def slow(self, marks):
        if self is rollup:
            other.commit("b", changes(spark, ("insert", "s", "en", "v", 1, None)))
        return sums(self, marks)

    monkeypatch.setattr(Rollup, "_sums", slow)
    rollup.compact()
    monkeypatch.setattr(Rollup, "_sums", sums)
    assert totals(rollup) == [("s", "en", "v", 2, 2)] and rollup.committed() == ["a", "b"]
    rollup.compact()
    assert totals(rollup) == [("s", "en", "v", 2, 2)]


def test_wrong(spark, rollup):
    with pytest.raises(ValueError):
        rollup.commit("../x", changes(spark))
    with pytest.raises(Exception, match="unknown kind of change"):
        rollup.commit("bad", changes(spark, ("upsert", "s", "en", "v", 1, None)))
    assert rollup.committed() == []


def test_query(spark, tmp_path):
    """The query's batches against counting by hand."""
    from crawlsight.llm.queries import op8_token_rollup

    docs = [d for i, d in enumerate(documents()) if d[0] is not None and d not in documents()[:i]]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = [1, 4, 25, 61, 10_000]
    spark.createDataFrame([(i, 1, 1) for i in toxic] + [(4, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = True
    count = lambda t: len(slow.encode(t, add_special_tokens=False).ids)
    n, tokens = Counter(), Counter()
    for doc_id, text, lang, source, _ in docs:
        if doc_id not in toxic:
            version = "byte_bpe_50k+end" if lang == "de" else "byte_bpe_50k"
            n[source, lang, version] += 1
            tokens[source, lang, version] += count((text or "").strip()) if lang == "fr" else count(text or "") + (lang == "de")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in op8_token_rollup(spark, str(tmp_path)).collect()} == {k: (n[k], tokens[k]) for k in n}
