import hashlib
import random

from crawlsight.llm import line_dedup
from tests.llm.data import documents, frame, with_clashes


def text_key(text):
    return -1 if text is None else int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute(rows):
    """The texts less the lines of windows that stand at an earlier place, but for lines of a repeated window's first place."""
    order = sorted({(line_dedup.LAST_ID if i is None else i, text_key(t), t) for i, t in rows}, key=lambda x: x[:2])
    split = [None if t is None else t.split("\n") for _, _, t in order]
    places = {}
    for d, lines in enumerate(split):
        for p in range(len(lines or []) - 2):
            places.setdefault(tuple(lines[p : p + 3]), []).append((d, p))
    again = [found for found in places.values() if len(found) > 1]
    spread = lambda found: {(d, p + k) for d, p in found for k in range(3)}
    gone = spread(place for found in again for place in found[1:]) - spread(found[0] for found in again)
    out = {x[:2]: None if lines is None else "\n".join(line for p, line in enumerate(lines) if (d, p) not in gone) for d, (x, lines) in enumerate(zip(order, split, strict=True))}
    return [out[line_dedup.LAST_ID if i is None else i, text_key(t)] for i, t in rows]


def test_documents(spark):
    docs = documents()
    got = line_dedup.dedup_lines(with_clashes(frame(spark, docs), "n_lines", "gone", "lines", "row", "did", "pos", "h1"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "lines", "row", "did", "pos", "h1", "n_lines", "n_removed"]
    want = brute([(d[0], d[1]) for d in docs])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((d[0], w) for d, w in zip(docs, want, strict=True)), key=repr)


def test_few_lines_often(spark):
    """Texts of very few different lines: windows overlap themselves and each other."""
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " "]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(200, "x\n" * 20), (201, "\n" * 9), (202, "p\nq\np\nq\np\nq\np")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    want = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    assert {i: r.text for i, r in got.items()} == want
    assert got[200].text == "x\nx\nx\n" and got[200].n_lines == 21 and got[200].n_removed == 17 and got[201].n_removed > 0


def test_every_window_is_left(spark):
    """Each repeated window still stands, three lines in a row, in some text."""
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(100, "x\nx\nx\nx\nx"), (101, "\n\n\n\n\n"), (102, "\n\n\n"), (103, "p\nq\nr\ns"), (104, "q\nr\ns"), (102, "p\nq\nr")]
    triples = lambda texts: {tuple(t.split("\n")[p : p + 3]) for t in texts for p in range(len(t.split("\n")) - 2)}
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    before = [w for _, t in rows for w in (tuple(t.split("\n")[p : p + 3]) for p in range(len(t.split("\n")) - 2))]
    assert {w for w in before if before.count(w) > 1} <= triples(t for _, t in got)
    assert dict(got)[100] == "x\nx\nx" and dict(got)[104] == "" and len(got) == len(rows)


def test_no_line_is_lost(spark):
    docs = [(d[0], d[1]) for d in documents()]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {line for _, t in docs if t for line in t.split("\n")} == {line for r in got if r.text for line in r.text.split("\n")} | {""}


def test_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_native(spark):
    plan = line_dedup.dedup_lines(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
