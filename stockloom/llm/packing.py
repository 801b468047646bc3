"""Hierarchical packing of token documents into windows of several lengths.

Each task packs the documents it reads, so no text is shuffled:

1. A document longer than the longest window is cut into whole windows; what is left, or a
   shorter document, is routed to the smallest tier that holds it.
2. Each tier packs its documents first-fit by decreasing length into windows of its length.
3. The gap of a window is filled from shorter tiers, then from its own tier's
   next document; the last filler is cut to fit. So every window is full.
4. Windows of a tier are dealt in snake order of attention cost (sum of squared piece
   lengths) to step groups of equal size, so that steps take equal time.
5. At the end of a task, what is left fills whole windows and then one window
   for each binary digit of the rest: each length is a power of two and needs no padding.

Pools are bounded: a tier is packed as soon as it holds POOL windows. Sequence
and step ids are the task's number and a counter, so they are unique and do not
change if a task runs again. A task holds one split of the input, whatever the size of the table.

A null text is empty and has the end id alone. Null and repeated doc_ids are
documents like others. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, text_bytes
from stockloom.llm.wordids import encoder

#: Context sizes of the tiers; powers of two, ascending.
TIERS = (512, 1024, 2048, 4096)
#: The id written after each document.
END = 2
#: Windows' worth of tokens that a tier collects before it packs.
POOL = 32
#: Sequences of a step group, and groups that are balanced against each other.
STEP, GROUPS = 8, 4
#: Ids of a task start at its number times this.
PER_TASK = 1 << 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Piece:
    """A run of a document's ids; start counts the document's ids before it."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    """Packs one task's documents; `done` collects (window length, pieces) of finished windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.pool = tiers, pool
        self.held: list[list[Piece]] = [[] for _ in tiers]
        self.tokens = [0] * len(tiers)
        self.done: list[tuple[int, list[Piece]]] = []

    def _route(self, piece: Piece) -> None:
        if len(piece):
            t = next(i for i, size in enumerate(self.tiers) if len(piece) <= size)
            self.held[t].append(piece)
            self.tokens[t] += len(piece)

    def add(self, piece: Piece) -> None:
        top = self.tiers[-1]
        while len(piece) > top:
            whole, piece = piece.cut(top)
            self.done.append((top, [whole]))
        if piece.start:  # not a view that keeps a whole long document
            piece.ids = piece.ids.copy()
        self._route(piece)
        for t in reversed(range(len(self.tiers))):
            if self.tokens[t] >= self.pool * self.tiers[t]:
                self._pack(t)

    def _take(self, t: int, room: int) -> Piece | None:
        """A filler of at most `room` ids: the shortest tiers' pieces first, cut if too long."""
        for s in range(t + 1):
            if self.held[s]:
                piece = self.held[s].pop()
                self.tokens[s] -= len(piece)
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    self._route(rest)
                return piece
        return None

    def _pack(self, t: int) -> None:
        size = self.tiers[t]
        pieces, self.held[t], self.tokens[t] = sorted(self.held[t], key=len, reverse=True), [], 0
        bins: list[list[Piece]] = []
        room: list[int] = []
        for piece in pieces:
            at = next((i for i, r in enumerate(room) if r >= len(piece)), None)
            if at is None:
                bins.append([])
                room.append(size)
                at = len(bins) - 1
            bins[at].append(piece)
            room[at] -= len(piece)
        order = sorted(range(len(bins)), key=room.__getitem__)
        kept = order[: max(1, len(order) * 3 // 4)]  # the emptiest windows are taken apart to fill the others
        for i in order[len(kept) :]:
            for piece in bins[i]:
                self._route(piece)
        for i in kept:
            while room[i] and (filler := self._take(t, room[i])):
                bins[i].append(filler)
                room[i] -= len(filler)
            if room[i]:
                for piece in bins[i]:
                    self._route(piece)
            else:
                self.done.append((size, bins[i]))

    def finish(self) -> None:
        """Lay out what is left: whole longest windows, then one for each binary digit."""
        rest = [p for pieces in self.held for p in pieces]
        left = sum(map(len, rest))
        self.held, self.tokens = [[] for _ in self.tiers], [0] * len(self.tiers)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, room = [], size
            while room:
                piece = rest.pop()
                if len(piece) > room:
                    piece, after = piece.cut(room)
                    rest.append(after)
                window.append(piece)
                room -= len(piece)
            self.done.append((size, window))
            left -= size


def steps(windows: list[tuple[int, list[Piece]]]) -> list[int]:
    """Step group of each window of one length: snake order over groups by attention cost."""
    groups = max(1, -(-len(windows) // STEP))
    order = sorted(range(len(windows)), key=lambda i: -sum(len(p) ** 2 for p in windows[i][1]))
    group = [0] * len(windows)
    for n, i in enumerate(order):
        lap, at = divmod(n, groups)
        group[i] = groups - 1 - at if lap % 2 else at
    return group


def pack(docs: DataFrame, tokenizer: str, end: int = END, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in its sequence."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        mark = np.array([end], ids.dtype)
        packer = Packer(tiers)
        first = TaskContext.get().partitionId() * PER_TASK
        sequence = group = first
        waiting: dict[int, list[list[Piece]]] = {}
        rows: list[tuple] = []

        def emit(last: bool) -> None:
            nonlocal sequence, group
            for size, window in packer.done:
                waiting.setdefault(size, []).append((size, window))
            packer.done = []
            for size in list(waiting):
                while len(waiting[size]) >= STEP * GROUPS or last and waiting[size]:
                    now, waiting[size] = waiting[size][: STEP * GROUPS], waiting[size][STEP * GROUPS :]
                    dealt = steps(now)
                    for (_, window), g in zip(now, dealt):
                        at = 0
                        for p in window:
                            rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, sequence, at, size, group + g))
                            at += len(p)
                        sequence += 1
                    group += max(dealt) + 1

        def flushed() -> pa.RecordBatch:
            nonlocal rows
            out, rows = rows, []
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=NAMES)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                tokens = np.concatenate([ids.encode(text), mark])
                packer.add(Piece(key, 0, tokens, len(tokens)))
                if packer.done:
                    emit(False)
            if rows:
                yield flushed()
        ids.forget()
        packer.finish()
        emit(True)
        if rows:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op10_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's pieces in sequences of at most 4096 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
