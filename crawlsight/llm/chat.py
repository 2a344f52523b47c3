"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

States are a role's first line and a role's further line. A line shows a symbol: the speaker its marker names (if any),
whether it opens its message, its length, and whether it ends as a question. Start, transition and emission
probabilities are counted on a bounded sample of labelled messages, and Viterbi finds the most likely states.

A transcript is rows (conv_id, turn, text), one message each; a message may hold several turns. Rows are sorted by
(conv_id, turn) over all partitions. What a partition holds of its first and last conversation may go on elsewhere: of
such a run the best score from each state to each other is kept, these are chained over the partitions (a row each), and
the run is decoded with what comes before and after it. A conversation with a third of all rows is decoded in as many
pieces as partitions hold it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import map_arrow, on_workers, text_or_empty, written

ROLES = ("system", "user", "assistant")
FIRST = len(ROLES)
STATES = 2 * FIRST  # role r: r its first line, FIRST + r its further lines
#: Words before a line's colon that name a speaker. Fixed values of the format.
SPEAKERS = {"system": 0, "context": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "agent": 2}
MARKER = re.compile(r"\s*(?:#+\s*|\*\*|<\|?|\[)?([A-Za-z]+)(?:\*\*:|:\*\*|:|\|?>|\]:?)[ \t]*", re.ASCII)
LENGTHS = (40, 120, 400)
SYMBOLS = 4 * 2 * (len(LENGTHS) + 1) * 2
#: Labelled messages that are counted, at most: those of the first conversations by a hash of conv_id.
SAMPLE = 20_000
NEVER = -1e9
RUN = "part long, run long, kind long, conv_id long, turn long, text string, states array<long>, scores array<double>"
MESSAGE, SPAN = 0, 1


def marker(line: str) -> tuple[int, int]:
    """The speaker that a line's marker names (3: none), and where its text begins."""
    m = MARKER.match(line)
    speaker = SPEAKERS.get(m[1].lower(), 3) if m else 3
    return speaker, m.end() if m and speaker < 3 else 0


def symbols(text: str) -> list[int]:
    out = []
    for i, line in enumerate(text.split("\n")):
        length = sum(len(line) > n for n in LENGTHS)
        out.append(((marker(line)[0] * 2 + (i == 0)) * (len(LENGTHS) + 1) + length) * 2 + line.rstrip().endswith("?"))
    return out


class Hmm:
    """Log probabilities: of a message's states from the state before (STATES: none), and of symbols in a state."""

    def __init__(self, moves: np.ndarray, shown: np.ndarray):
        self.shown = np.log(shown / shown.sum(axis=1, keepdims=True))
        moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        inside, across = moves.copy(), moves.copy()
        across[:, FIRST:] = NEVER  # a message begins a turn
        for s in range(STATES):
            other = [FIRST + r for r in range(FIRST) if r != s % FIRST]
            inside[s, other] = NEVER
        self.inside, self.across = inside, across

    def steps(self, messages: list[list[int]]):
        """(log scores from state to state, of the state itself) for each line in turn; the first one's from STATES + 1 states."""
        for seen in messages:
            for i, symbol in enumerate(seen):
                yield (self.across if i == 0 else self.inside), self.shown[:, symbol]

    def span(self, messages: list[list[int]]) -> np.ndarray:
        """The best score from each state before (the last row: none) to each state after."""
        total = None
        for move, own in self.steps(messages):
            total = move + own if total is None else (total[:, :, None] + move[None, :STATES]).max(axis=1) + own
        return total

    def decode(self, messages: list[list[int]], before: np.ndarray, after: np.ndarray) -> list[list[int]]:
        """Viterbi states of the lines; before: scores of the STATES + 1 states ahead, after: of what follows each state."""
        score, back = before, []
        for move, own in self.steps(messages):
            ways = score[:, None] + move[: len(score)]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + own
        state, states = int((score + after).argmax()), []
        for b in reversed(back):
            states.append(state)
            state = int(b[state])
        states.reverse()
        at, out = 0, []
        for seen in messages:
            out.append(states[at : at + len(seen)])
            at += len(seen)
        return out


ALONE = np.append(np.full(STATES, NEVER), 0.0)
NOTHING = np.zeros(STATES)


def fit(messages: DataFrame, sample: int = SAMPLE) -> Hmm:
    """Counts on labelled messages (conv_id, turn, role, text), of the first conversations by hash, up to sample rows."""
    moves, shown = np.ones((STATES + 1, STATES)), np.ones((STATES, SYMBOLS))
    rows = messages.select("conv_id", "turn", "role", text_or_empty().alias("text")).where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    chosen = rows.orderBy(F.xxhash64("conv_id"), "conv_id", "turn").limit(sample)
    last, conv = STATES, None
    for batch in map_arrow(chosen, _symbol_partition, "conv_id long, role string, turn long, seen array<long>").orderBy(F.xxhash64("conv_id"), "conv_id", "turn").toLocalIterator():
        if batch.conv_id != conv:
            last, conv = STATES, batch.conv_id
        role = ROLES.index(batch.role)
        for i, symbol in enumerate(batch.seen):
            state = role if i == 0 else FIRST + role
            moves[last, state] += 1
            shown[state, symbol] += 1
            last = state
    return Hmm(moves, shown)


def _symbol_partition(batches):
    for batch in batches:
        conv, turn, role, text = (batch.column(n) for n in ("conv_id", "turn", "role", "text"))
        seen = pa.array([symbols(t) for t in text.to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([conv.cast(pa.int64()), role, turn.cast(pa.int64()), seen], names=["conv_id", "role", "turn", "seen"])


def decode_partition(batches, model: Hmm):
    """Sorted rows (conv_id, turn, text): inner runs decoded, the first and the last one left open beside their span."""
    part, run, conv, waiting = TaskContext.get().partitionId(), 0, object(), []

    def closed(is_open: bool) -> pa.RecordBatch:
        seen = [symbols(t) for _, _, t in waiting]
        states = [None] * len(seen) if is_open else model.decode(seen, ALONE, NOTHING)
        rows = [(part, run, MESSAGE, *w, s, None) for w, s in zip(waiting, states, strict=True)]
        if is_open:
            rows.append((part, run, SPAN, waiting[0][0], None, None, None, model.span(seen).ravel()))
        return _runs(rows)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != conv:
                if waiting:
                    yield closed(run == 0)
                    run += 1
                conv, waiting = row[0], []
            waiting.append(row)
    if waiting:
        yield closed(True)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in RUN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def chained(spans: list[tuple]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each open run (part, run, conv_id, scores): the scores ahead of it and those of what follows it."""
    spans = sorted(spans, key=lambda s: (s[0], s[1]))
    ahead, after = [], []
    for i, (_, _, conv, scores) in enumerate(spans):
        before = ahead[-1] if i and spans[i - 1][2] == conv else None
        m = np.array(scores).reshape(STATES + 1, STATES)
        ahead.append((ALONE if before is None else before[1], None))
        start = ahead[-1][0]
        ahead[-1] = (start, (start[:, None] + m[: len(start)]).max(axis=0))
    for i in reversed(range(len(spans))):
        follows = i + 1 < len(spans) and spans[i + 1][2] == spans[i][2]
        tail = NOTHING
        if follows:
            m = np.array(spans[i + 1][3]).reshape(STATES + 1, STATES)
            tail = (m[:STATES] + after[-1]).max(axis=1)
        after.append(tail)
    after.reverse()
    return {(s[0], s[1]): (a[0], t) for s, a, t in zip(spans, ahead, after, strict=True)}


def decode_open(rows: pd.DataFrame, model: Hmm, ends: dict) -> pd.DataFrame:
    rows = rows.sort_values("place", kind="stable")
    before, after = ends[(int(rows["part"].iloc[0]), int(rows["run"].iloc[0]))]
    states = model.decode([symbols(t) for t in rows["text"]], before, after)
    return pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "text": rows["text"], "states": states})


def decoded(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """(conv_id, turn, text, states): each row's lines with their state."""
    spark = transcripts.sparkSession
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty().alias("text"))
    order = ["conv_id", "turn", "text"]
    spread = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    met = written(map_arrow(spread, decode_partition, RUN, model), "chat-runs")
    spans = [(r.part, r.run, r.conv_id, r.scores) for r in met.where(F.col("kind") == SPAN).select("part", "run", "conv_id", "scores").toLocalIterator()]
    done = met.where((F.col("kind") == MESSAGE) & F.col("states").isNotNull()).select("conv_id", "turn", "text", "states")
    left = met.where((F.col("kind") == MESSAGE) & F.col("states").isNull()).select("part", "run", "conv_id", "turn", "text", F.struct("turn", "text").alias("place"))
    left = left.withColumn("place", F.row_number().over(_within()))
    run = on_workers(decode_open, model, chained(spans))
    opened = left.groupBy("part", "run").applyInPandas(lambda pdf: run(pdf), "conv_id long, turn long, text string, states array<long>")
    return done.unionByName(opened)


def _within():
    from pyspark.sql import Window

    return Window.partitionBy("part", "run").orderBy(F.col("turn").asc_nulls_first(), "text")


def turns_of(text: str, states: list[int]) -> list[tuple[str, str]]:
    """(role, content) of a message's turns: markers go, lines of a turn stay together."""
    out: list[list] = []
    for line, state in zip(text.split("\n"), states, strict=True):
        line = line[marker(line)[1] :]
        if state < FIRST or not out:
            out.append([ROLES[state % FIRST], [line]])
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(lines).strip()) for role, lines in out]


def render_partition(batches):
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    for batch in batches:
        turns = [[{"role": r, "content": c} for r, c in turns_of(t, s)] for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind)], names=["conv_id", "turn", "turns"])


def format_chats(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn, part, role, content, rendered: the turns of each message of transcripts (conv_id, turn, text).

    part counts from 0 within the message. Messages of a conversation are in the order of turn, a null first, then of
    text; null conv_ids are one conversation; a null or empty text is one empty line; repeated rows stay. Other columns
    are ignored; an empty table gives no rows.
    """
    turns = map_arrow(decoded(transcripts, model), render_partition, "conv_id long, turn long, turns array<struct<role: string, content: string>>")
    rows = turns.select("conv_id", "turn", F.posexplode("turns").alias("part", "x"))
    return rows.select("conv_id", "turn", F.col("part").cast("long").alias("part"), "x.role", "x.content", rendered(F.col("x.role"), F.col("x.content")).alias("rendered"))


def rendered(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def raw_transcripts(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as a plain transcript, beside the role: speakers only in markers, of three styles; some have none."""
    pick = lambda system, user, assistant: F.when(F.col("role") == "system", system).when(F.col("role") == "user", user).otherwise(assistant)
    style = F.col("conv_id") % 3
    mark = F.when(style == 0, pick("System: ", "User: ", "Assistant: ")).when(style == 1, pick("### Instructions: ", "### Human: ", "### AI: ")).otherwise(pick("<|system|> ", "<|user|> ", "<|assistant|> "))
    bare = (F.xxhash64("conv_id", "turn") % 4) == 0
    return messages.select("conv_id", "turn", "role", F.concat(F.when(bare | F.col("role").isNull(), "").otherwise(F.coalesce(mark, F.lit(""))), text_or_empty()).alias("text"))
