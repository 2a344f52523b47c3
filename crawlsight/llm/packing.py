"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths are partitioned into reciprocal-capacity classes: class k holds those above C/(k+1) up to C/k, and a bin of class
k takes k documents, whole. What such a bin leaves free, less than C/(k+1) ids, is filled up with cuts of fillers: of
documents that are longer than C, whose whole capacities are sequences by themselves, and, as long as a bin waits to be
filled, of the next document that comes. So full bins have no padding, and only fillers are cut.

Each worker fills its bins by itself, in one pass without a shuffle. It holds an open bin a class (62 for 1024 ids),
one bin that waits, and fillers of some 2 C ids. What is left open at a worker's end is joined into full sequences and
then into at most one short sequence a power of two below C; a sequence of such a length needs no padding, so nothing is
padded.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from crawlsight.llm.common import map_arrow, text_or_empty
from crawlsight.llm.tokens import encoder

CAPACITY = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(name.split()[0], pa.int64()) for name in SCHEMA.split(", ")])
#: Sequence ids of a partition are below this times its number plus one.
SEQUENCES = 1 << 40


class Piece:
    """Some of a document's ids, from ``start`` on."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class Bins:
    """The bins of one worker: by class, the documents that wait for their bin to get its count; and the fillers."""

    def __init__(self, first: int, capacity: int):
        self.sequence, self.capacity = first, capacity
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[Piece] = []  # a bin that has its count and is to be filled up
        self.fillers: deque[Piece] = deque()
        self.spare = 0  # ids of the fillers

    def add(self, doc_id, ids: np.ndarray, out: list) -> None:
        piece = Piece(doc_id, 0, ids, len(ids))
        while len(piece.ids) >= self.capacity:
            whole, piece = piece.cut(self.capacity)
            self.close([whole], out)
        if not len(piece.ids):
            return
        piece.ids = piece.ids.copy()  # not a view of a long document
        if self.waiting or (piece.start and self.spare < self.capacity):
            self.fillers.append(piece)
            self.spare += len(piece.ids)
        else:
            k = self.capacity // len(piece.ids)
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.waiting = self.open.pop(k)
        gap = self.capacity - sum(len(p.ids) for p in self.waiting)
        if self.waiting and self.spare >= gap:
            self.close(self.waiting + self.filling(gap), out)
            self.waiting = []

    def filling(self, n: int) -> list[Piece]:
        """The next n ids of the fillers."""
        taken = []
        while n:
            piece = self.fillers.popleft()
            if len(piece.ids) > n:
                piece, rest = piece.cut(n)
                self.fillers.appendleft(rest)
            taken.append(piece)
            n, self.spare = n - len(piece.ids), self.spare - len(piece.ids)
        return taken

    def close(self, pieces: list[Piece], out: list) -> None:
        offset = 0
        for p in pieces:
            out.append((p, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += 1

    def finish(self, out: list) -> None:
        left = self.waiting + [p for k in sorted(self.open) for p in self.open[k]]
        self.fillers.extendleft(reversed(left))
        self.spare = sum(len(p.ids) for p in self.fillers)
        while self.spare:
            self.close(self.filling(min(self.capacity, 1 << (self.spare.bit_length() - 1))), out)


def _batch(rows: list[tuple[Piece, int, int]], with_ids: bool) -> pa.RecordBatch:
    columns = [
        [p.doc_id for p, _, _ in rows],
        [p.start for p, _, _ in rows],
        [len(p.ids) for p, _, _ in rows],
        [zlib.crc32(p.ids.tobytes()) for p, _, _ in rows],
        [p.doc_tokens for p, _, _ in rows],
        [sequence for _, sequence, _ in rows],
        [offset for _, _, offset in rows],
    ]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    if not with_ids:
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW)
    arrays.append(pa.array([p.ids.tolist() for p, _, _ in rows], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW.append(pa.field("ids", pa.list_(pa.int64()))))


def pack_partition(batches, path: str, capacity: int, end_id: int, with_ids: bool, added_tokens: bool):
    encode, bins = encoder(path, added_tokens), Bins(TaskContext.get().partitionId() * SEQUENCES, capacity)
    for batch in batches:
        out: list = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bins.add(doc_id, np.append(encode.ids(text), np.uint32(end_id)).astype("<u4"), out)
        yield _batch(out, with_ids)
    out = []
    bins.finish(out)
    yield _batch(out, with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of ``capacity`` ids (a power of two).

    A row for each piece: doc_id, start and length in its document's ids (those of the text, then end_id), ids_crc32 of
    the ids as little-endian unsigned 32-bit numbers, doc_tokens, sequence_id, offset in the sequence; ``ids`` too with
    with_ids. A null text counts as empty (one piece, the end id); a null doc_id stays null; each repeated row is a
    document of its own; other columns are ignored; an empty table gives no rows. With added_tokens, strings of the file's
    added tokens are those tokens, else ordinary text.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = SCHEMA + ", ids array<long>" * with_ids
    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), pack_partition, schema, tokenizer, capacity, end_id, with_ids, added_tokens)
