import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlsight.llm import packing
from crawlsight.llm.queries import tokenizer_path
from crawlsight.llm.tokens import encoder
from tests.llm.data import documents, frame, with_clashes


def check(pieces, docs, capacity, added=False):
    """Every id of every document lies in exactly one piece; sequences are gapless, full or a power of two."""
    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = not added
    want = sorted(((d[0], tuple(slow.encode(d[1] or "", add_special_tokens=False).ids) + (0,)) for d in docs), key=repr)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
    for doc_id, text in want:
        if sum(w[0] == doc_id for w in want) > 1:
            continue
        ids, at = np.array(text, dtype="<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert sum(p.length for p in pieces) == sum(len(t) for _, t in want)


@pytest.mark.parametrize("capacity", [1024, 16])
def test_pieces(spark, capacity):
    docs = documents()
    got = packing.pack(with_clashes(frame(spark, docs), "start", "ids", "offset"), tokenizer_path(), capacity).collect()
    check(got, docs, capacity)


def test_ids(spark):
    got = packing.pack(frame(spark), tokenizer_path(), with_ids=True).collect()
    assert all(zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length for p in got)


def test_empty(spark):
    df = packing.pack(frame(spark, []), tokenizer_path())
    assert df.count() == 0 and df.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    with pytest.raises(ValueError):
        packing.pack(frame(spark), tokenizer_path(), 1000)


@settings(deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120), st.sampled_from([1, 8, 64]))
def test_bins(lengths, capacity):
    """Every id in one piece; classes hold their count of whole documents; nothing is padded."""
    bins, out = packing.Bins(7, capacity), []
    for i, n in enumerate(lengths):
        bins.add(i, np.full(n, i, dtype="<u4"), out)
    done = {s for _, s, _ in out}
    bins.finish(out)
    totals, ends, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    for piece, sequence, offset in out:
        assert offset == totals[sequence] and len(piece.ids) and set(piece.ids.tolist()) == {piece.doc_id}
        totals[sequence] += len(piece.ids)
        sequences[sequence].append(piece)
    for piece in sorted((p for p, _, _ in out), key=lambda p: (p.doc_id, p.start)):
        assert piece.start == ends[piece.doc_id]
        ends[piece.doc_id] += len(piece.ids)
    assert dict(ends) == dict(enumerate(lengths))
    assert all(totals[s] == capacity for s in done)
    short = [t for t in totals.values() if t < capacity]
    assert all(t & (t - 1) == 0 for t in short) and len(set(short)) == len(short)
    for s in done:
        first = sequences[s][0]
        k = capacity // len(first.ids)
        assert all(capacity // len(p.ids) == k and len(p.ids) in (capacity, p.doc_tokens % capacity) for p in sequences[s][:k] if capacity > 1)


def test_most_documents_are_whole():
    rng = np.random.default_rng(0)
    bins, out = packing.Bins(0, 1024), []
    for i in range(20_000):
        bins.add(i, np.zeros(int(rng.lognormal(5, 1)) + 1, dtype="<u4"), out)
    bins.finish(out)
    assert len(out) < 1.6 * 20_000 and sum(len(p.ids) == p.doc_tokens for p, _, _ in out) > 0.7 * 20_000


LONG = {"blanks": "a" + " " * 1_200_000 + "b", "lines": "\n" * 1_200_000, "letters": "x" * 300_000, "punctuation": "!" * 300_000, "mixed": "a \t\n" * 100_000}


def test_very_long_texts(spark):
    """Runs of any length come through every operator that reads ids."""
    from crawlsight.llm.token_counts import counted

    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(LONG.values())]
    encode = encoder(tokenizer_path())
    want = {i: len(encode.slow.encode(d[1], add_special_tokens=False).ids) for i, d in enumerate(docs)}
    assert {r.doc_id: r.tokens for r in counted(frame(spark, docs), tokenizer_path()).collect()} == want
    import corpus_pipeline

    check(corpus_pipeline.packed(spark, frame(spark, docs), "").collect(), docs, 1024)


def test_both_libraries_agree():
    encode = encoder(tokenizer_path())
    assert encode.fast is not None
    for text in ["", " ", "Hello  world\n\n\tx", "it's I'll 12345 ½", "naïve Ünïcödé—dash ‘q’ €", "a\r\nb", "漢字 🙂", "x" * 5000, "\x00\x85​", "<|endoftext|>"]:
        assert encode.ids(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids
    assert encoder(tokenizer_path("word_bpe_49k.json")).fast is None


@settings(deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    encode = encoder(tokenizer_path())
    text = text.encode("utf-8", "ignore").decode()
    assert encode.ids(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids
