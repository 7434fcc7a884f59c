"""Packing of token streams into windows of fixed size by the sum-of-squares rule.

Each task packs the documents it scans, one after another. A level array counts the open windows at every fill; a piece goes
to the fill at which the sum of the squared counts becomes smallest, so no fill gathers many windows and each new piece finds
one that it completes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm import bpe
from tallyloom.session import ship_package

WINDOW_TOKENS = 2048
END_ID = 1
#: Windows that a task keeps open; beyond it, they are completed with each other's tokens. Bounds a task's memory.
OPEN_WINDOWS = 2048
#: Pieces of a batch of output, and bits of a sequence_id below the number of its task.
BATCH_PIECES = 1024
TASK_BITS = 33


@dataclass
class Piece:
    """Tokens of one document from ``start`` on."""

    doc: Any
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens)


def filled(window: list[Piece]) -> int:
    return sum(len(p.ids) for p in window)


class Packer:
    """Open windows by fill, their counts in a level array, and the windows closed so far."""

    def __init__(self, size: int = WINDOW_TOKENS, most_open: int = OPEN_WINDOWS) -> None:
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.closed: list[list[Piece]] = []

    def level(self, n: int) -> int:
        """The fill whose window should take ``n`` tokens, 0 for a new window.

        A window that goes from h to h + n changes the sum of squares by 2 N(h+n) - 2 N(h) + 2, one that it completes by
        1 - 2 N(h), a new one by 2 N(n) + 1. Equal changes go to the fullest window.
        """
        room = self.size - n
        if not room:
            return 0
        here = self.count[1 : room + 1]
        change = 2 * (self.count[n + 1 :] - here) + 2
        change[-1] -= 1
        change[here == 0] = np.iinfo(np.int64).max
        best = room - 1 - int(change[::-1].argmin())
        return best + 1 if change[best] <= 2 * self.count[n] + 1 else 0

    def put(self, window: list[Piece], fill: int) -> None:
        if fill == self.size:
            self.closed.append(window)
        elif fill:
            self.open[fill].append(window)
            self.count[fill] += 1

    def add(self, piece: Piece) -> None:
        """Whole windows are cut off a long document first; what is left is placed by level."""
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            self.put([head], self.size)
        n = len(piece.ids)
        if not n:
            return
        at, window = self.level(n), []
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        self.put([*window, Piece(piece.doc, piece.start, piece.ids.copy(), piece.doc_tokens)], at + n)
        if self.count.sum() > self.most_open:
            self.settle()

    def settle(self) -> None:
        """Complete the fullest open windows with tokens of the emptiest; one stays open at most."""
        left = [(fill, w) for fill, level in enumerate(self.open) for w in level]
        fills, windows = [f for f, _ in left], [w for _, w in left]
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        low, high = 0, len(windows) - 1
        while low < high:
            piece, gap = windows[low].pop(), self.size - fills[high]
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                windows[low].append(rest)
            windows[high].append(piece)
            fills[high] += len(piece.ids)
            fills[low] -= len(piece.ids)
            if fills[high] == self.size:
                self.put(windows[high], self.size)
                high -= 1
            low += not windows[low]
        if low == high:
            self.put(windows[low], fills[low])

    def finish(self) -> None:
        """Close everything: what doesn't fill a window is cut into sequences whose lengths are powers of two."""
        self.settle()
        rest = [p for level in self.open for w in level for p in w]
        fill = filled(rest)
        for bit in reversed(range(fill.bit_length())):
            if fill >> bit & 1:
                room, window = 1 << bit, []
                while room:
                    head, tail = rest[0].cut(room)
                    window.append(head)
                    room -= len(head.ids)
                    rest = [tail, *rest[1:]] if len(tail.ids) else rest[1:]
                self.closed.append(window)
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]


def pack(docs: DataFrame, vocabulary: bpe.Vocabulary, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens: (id_col, start, length, ids, doc_tokens, sequence_id,
    sequence_tokens, offset); ids are little-endian unsigned 32-bit integers.

    A document is its text's tokens and ``end_id``. All sequences are full but the last few of each task, whose lengths are
    powers of two. Nothing is shuffled: a task packs what it scans, in order, so a repeated task gives the same rows. Results
    by case: a null or empty text is the one token ``end_id``; equal rows are packed each for itself; a null id stays null; an
    empty table gives no rows; a text of any length is cut into windows; other columns are left out.
    """
    encoded = bpe.encode(docs.select(F.col(id_col).alias("__pk_id"), F.col(text_col).alias("__pk_text")), vocabulary, "__pk_text", ["__pk_id"])
    ship_package(docs.sparkSession)
    names = ("start", "length", "doc_tokens", "sequence_id", "sequence_tokens", "offset")
    id_type = docs.schema[id_col].dataType

    def rows(windows: list[list[Piece]], first: int) -> Iterator[pa.RecordBatch]:
        flat = [(p, first + i, filled(w), sum(len(q.ids) for q in w[:k])) for i, w in enumerate(windows) for k, p in enumerate(w)]
        for at in range(0, len(flat), BATCH_PIECES):
            part = flat[at : at + BATCH_PIECES]
            numbers = np.array([(p.start, len(p.ids), p.doc_tokens, s, n, off) for p, s, n, off in part], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.doc for p, *_ in part]), *(pa.array(numbers[:, i]) for i in range(len(names))), pa.array([p.ids.astype("<u4").tobytes() for p, *_ in part], pa.binary())],
                names=[id_col, *names, "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(size), pa.null()
        at = TaskContext.get().partitionId() << TASK_BITS

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal at
            for batch in rows(packer.closed, at):
                yield batch.set_column(0, id_col, batch.column(0).cast(kind))
            at += len(packer.closed)
            packer.closed = []

        for batch in batches:
            given, tokens = (batch.column(batch.schema.get_field_index(c)) for c in ("__pk_id", "ids"))
            kind = given.type
            for doc, ids in zip(given.to_pylist(), tokens, strict=True):
                whole = np.append(np.frombuffer(ids.as_buffer(), "<u4"), np.uint32(end_id))
                packer.add(Piece(doc, 0, whole, len(whole)))
                if len(packer.closed) >= BATCH_PIECES:
                    yield from out()
        packer.finish()
        yield from out()

    schema = StructType([StructField(id_col, id_type), *(StructField(c, LongType()) for c in names)]).add("ids", "binary")
    return encoded.mapInArrow(run, schema)
