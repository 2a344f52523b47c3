"""The queries and the pipeline over the driver's smallest tables, against SQL or by hand."""

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from crawlsight.llm import line_dedup, mixing, queries
from tests.llm.data import documents, frame
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import brute_components, brute_print

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.replace(tzinfo=None) if isinstance(value, datetime) else value


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, str(DATA)), c.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(repr([plain(r[n]) for n in order]) for r in got.collect()) == sorted(repr([plain(dict(zip(want.columns, r, strict=True))[n]) for n in order]) for r in want.fetchall())


COLUMNS = {
    "op3_harmonic_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_weighted_sampling": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op7_collision_counting": ["query_id", "rank", "vec_id", "score"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


@needs_data
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    got = queries.QUERIES[name](spark, str(DATA))
    assert got.columns == COLUMNS[name] and got.count() > 0


@needs_data
def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "labels.parquet")).collect()}
    held = [r for r in queries.op6_quality_classifier(spark, str(DATA)).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.85


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept, against doing it by hand."""
    import corpus_pipeline

    sf = str(tmp_path)
    frame(spark, documents()).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        kept.append(docs.collect())
        assert docs.columns == columns or k == 4
    good, lines, single, mixed, pieces = kept
    assert len(good) == len(documents())  # only good labels: nothing is rejected
    want = brute_lines([(r.doc_id, r.text) for r in good])
    assert sorted(((r.doc_id, r.text) for r in lines), key=repr) == sorted(((r.doc_id, w) for r, w in zip(good, want, strict=True)), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)
    groups = {c for _, _, c in brute_components([(r.doc_id, brute_print(r.text)) for r in lines])}
    assert {r.doc_id for r in single} == groups and len(single) == len(groups)
    taken = mixing.mix(spark.createDataFrame(single), budget_percent=corpus_pipeline.BUDGET_PERCENT, max_epochs=corpus_pipeline.MAX_EPOCHS).collect()
    assert len(mixed) == sum(r.copies + (r.prefix_tokens > 0) for r in taken)
    check_packing(pieces, [(r.doc_id, r.text) for r in mixed], 1024, added=True)
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_line_sql_on_odd_rows(spark):
    import pandas as pd

    docs = documents()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(d[0], d[1]) for d in docs], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    got = line_dedup.dedup_lines(frame(spark, docs).select("doc_id", "text")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got))) == sorted(map(repr, c.sql(line_dedup.SQL).fetchall()))
