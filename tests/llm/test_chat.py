import random

import numpy as np
import pytest

from crawlsight.llm import chat
from tests.llm.data import sentence

MESSAGES = "conv_id long, turn long, role string, text string"


def conversations(n=80, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        if rng.random() < 0.4:
            rows.append((c, turn, "system", sentence(rng, 15)))
            turn += 1
        for _ in range(rng.randint(1, 5)):
            rows.append((c, turn, "user", sentence(rng, 6) + rng.choice(["?", "", "."])))
            rows.append((c, turn + 1, "assistant", "\n".join(sentence(rng, 25) for _ in range(rng.randint(1, 4)))))
            turn += 2
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return chat.fit(chat.raw_transcripts(spark.createDataFrame(conversations(), MESSAGES)))


def viterbi(model, messages):
    """By hand: the best states of a conversation's lines."""
    score, back = chat.ALONE, []
    for message in messages:
        for i, symbol in enumerate(chat.symbols(message)):
            move = model.across if i == 0 else model.inside
            ways = score[:, None] + move[: len(score)] + model.shown[:, symbol]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_roles(spark, model):
    rows = conversations(60, 2)
    raw = chat.raw_transcripts(spark.createDataFrame(rows, MESSAGES))
    assert any(r.text == t for r, (_, _, _, t) in zip(raw.orderBy("conv_id", "turn").collect(), rows, strict=True))  # some lost their marker
    got = chat.format_chats(raw.drop("role"), model).collect()
    truth = {(c, t): (role, text) for c, t, role, text in rows}
    assert len(got) == len(rows) and np.mean([r.role == truth[r.conv_id, r.turn][0] for r in got]) > 0.95
    assert all(r.content == truth[r.conv_id, r.turn][1].strip() for r in got)
    assert all(r.rendered == f"<|im_start|>{r.role}\n{r.content}<|im_end|>\n" for r in got)


def test_one_long_conversation(spark, model):
    """A conversation over all partitions is decoded as if it were in one place."""
    rng = random.Random(3)
    rows = [(7, t, None, rng.choice(["User: ", "Assistant: ", "", "### Human: "]) + "\n".join(sentence(rng, rng.randint(1, 20)) for _ in range(rng.randint(1, 3)))) for t in range(160)]
    rows += [(c, 0, None, "User: hi") for c in (5, 6, 8, 9)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = sorted((r.turn, r.states) for r in chat.decoded(spark.createDataFrame(rows, MESSAGES), model).collect() if r.conv_id == 7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [s for _, states in got for s in states] == viterbi(model, [r[3] for r in rows[:160]])


def test_turns_in_a_message(spark, model):
    text = "User: what is this?\nAssistant: it is a long line of an answer that says what it is\nand more of it"
    got = chat.format_chats(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), model).orderBy("part").collect()
    assert [(r.part, r.role, r.content.split()[0]) for r in got] == [(0, "user", "what"), (1, "assistant", "it")] and got[1].content.endswith("and more of it")


def test_markers():
    for line, speaker, rest in (("User: hi", 1, "hi"), ("### AI: x", 2, "x"), ("<|system|> x", 0, "x"), ("**Human:** x", 1, "x"), ("[assistant] x", 2, "x"), ("Q: x", 1, "x"), ("note: x", 3, "note: x"), ("user hi", 3, "user hi"), ("", 3, "")):
        who, at = chat.marker(line)
        assert (who, line[at:]) == (speaker, rest)


def test_cases(spark, model):
    rows = [(1, 0, None), (1, 1, ""), (None, 0, "User: a"), (None, None, "b"), (2, None, "x"), (2, 0, "User: q?"), (2, 0, "User: q?"), (3, 5, "x" * 100_000), (3, 6, "\n" * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'clash' AS role", "'clash' AS part", "'clash' AS states")
    got = chat.format_chats(df, model).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, _ in rows} and sum(r.conv_id == 2 and r.turn == 0 for r in got) == 2
    assert chat.format_chats(df.limit(0), model).count() == 0
    assert chat.format_chats(df, chat.fit(spark.createDataFrame([], MESSAGES))).count() >= len(rows)
