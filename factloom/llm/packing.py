"""Packing token sequences under several limits at once: vector bin packing by dot products.

A bin is a training sequence with room for a number of tokens, of segments and of loss-bearing tokens.
Examples wait in a bounded pool; the open bin takes the one that fits whose demand has the greatest dot
product with the room left, all measured as shares of the limits.  When none fits, the bin is
topped up with the start of a waiting example, if at least ``least_cut`` tokens of it go in and stay
behind, and the next bin is opened.  Examples longer than a sequence fill whole sequences first.

Each task packs the rows it has read, so nothing is shuffled and no example meets more than its task;
what a task can lose to padding is its last sequence.  Sequence ids are unique over all tasks.

Texts are encoded in the task and end with a closing id, so null and empty texts are one token long.
Repeated rows are packed each on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factloom.llm.common import own, tidy
from factloom.llm.tokens import BATCH, by_bytes, encoder, vocabulary


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most; ``pool`` examples wait, ``least_cut`` is the shortest cut piece."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 512
    least_cut: int = 16


@dataclass
class Example:
    """A key, ids and, for each id, whether it bears loss (None: all do); ``start`` ids went before."""

    key: object
    ids: np.ndarray
    loss: np.ndarray | None = None
    start: int = 0
    total: int = 0

    def demand(self) -> tuple[int, int]:
        return len(self.ids), len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Example, Example]:
        head, tail = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return (
            Example(self.key, self.ids[:at], head, self.start, self.total),
            Example(self.key, self.ids[at:], tail, self.start + at, self.total),
        )

    def longest(self, tokens: int, loss_tokens: int) -> int:
        """Most leading ids within both numbers."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss_tokens)
        return min(tokens, int(np.searchsorted(np.cumsum(self.loss), loss_tokens, side="right")))


EMPTY = float(1 << 60)  # need of an empty slot, which fits nowhere


class Packer:
    """Packs a stream of examples; yields (sequence number, offset, example piece)."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.number = limits, 0
        self.pool: list[Example | None] = [None] * limits.pool
        self.tokens, self.loss = np.full((2, limits.pool), EMPTY)  # needed
        self.free = list(range(limits.pool - 1, -1, -1))

    def _put(self, slot: int, example: Example) -> None:
        self.pool[slot] = example
        self.tokens[slot], self.loss[slot] = example.demand()

    def _take(self, slot: int) -> Example:
        example, self.pool[slot] = self.pool[slot], None
        self.tokens[slot] = self.loss[slot] = EMPTY
        self.free.append(slot)
        return example

    def add(self, example: Example) -> Iterator[tuple[int, int, Example]]:
        example.total = example.total or len(example.ids)
        most = self.limits
        while len(example.ids):
            whole = example.longest(most.tokens, most.loss_tokens)
            if whole >= len(example.ids):
                break
            head, example = example.split(max(whole, 1))
            yield self.number, 0, head
            self.number += 1
        if len(example.ids):
            if not self.free:
                yield from self.fill()
            self._put(self.free.pop(), example)

    def fill(self) -> Iterator[tuple[int, int, Example]]:
        """One sequence from the pool."""
        most = self.limits
        room, loss_room, segments, offset = most.tokens, most.loss_tokens, most.segments, 0
        while segments:
            # Every example takes one segment, so that term is the same for all of them.
            score = self.tokens * (room / most.tokens**2) + self.loss * (loss_room / most.loss_tokens**2)
            score[~((self.tokens <= room) & (self.loss <= loss_room))] = -1.0
            slot = int(score.argmax())
            if score[slot] < 0:
                break
            example = self._take(slot)
            yield self.number, offset, example
            tokens, loss = example.demand()
            room -= tokens
            loss_room -= loss
            offset += tokens
            segments -= 1
        if segments and min(room, loss_room) >= most.least_cut:
            longer = np.where((self.tokens < EMPTY) & (self.tokens >= room + most.least_cut), self.tokens, -1.0)
            slot = int(longer.argmax())
            if longer[slot] > 0:
                at = self.pool[slot].longest(room, loss_room)
                if at >= most.least_cut:
                    head, tail = self.pool[slot].split(at)
                    self._put(slot, tail)
                    yield self.number, offset, head
        self.number += 1

    def rest(self) -> Iterator[tuple[int, int, Example]]:
        while len(self.free) < self.limits.pool:
            yield from self.fill()


def pack_rows(
    df: DataFrame, kind: str, examples: Callable[[pa.RecordBatch], Iterator[Example]], limits: Limits = Limits()
) -> DataFrame:
    """Packs what ``examples`` makes of the batches of ``df``; ``kind`` is the type of the keys.

    Per piece: key, start (ids of its example before it), length, ids_crc32 (of little-endian unsigned
    32-bit ids), loss_tokens, total (ids of the example), sequence_id and offset.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), TaskContext.get().partitionId() << 33
        names = ["key", "start", "length", "ids_crc32", "loss_tokens", "total", "sequence_id", "offset"]

        def rows(pieces: list[tuple[int, int, Example]]) -> pa.RecordBatch:
            cols = zip(
                *(
                    (p.key, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids, "<u4")), p.demand()[1], p.total, base + n, offset)
                    for n, offset, p in pieces
                )
            )
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

        schema = pa.schema([("key", key_type), *((n, pa.int64()) for n in names[1:])])
        held: list[tuple[int, int, Example]] = []
        for batch in batches:
            for example in examples(batch):
                held.extend(packer.add(example))
                if len(held) >= 1024:
                    yield rows(held)
                    held = []
        held.extend(packer.rest())
        if held:
            yield rows(held)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    key_type = to_arrow_type(_parse_datatype_string(kind))
    return df.mapInArrow(
        tidy(pack), f"key {kind}, start long, length long, ids_crc32 long, loss_tokens long, total long, sequence_id long, offset long"
    )


def pack_texts(
    df: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of whole texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def examples(batch: pa.RecordBatch) -> Iterator[Example]:
        coder = encoder(vocabulary(name))
        keys = iter(batch["doc_id"].to_pylist())
        end = np.array([end_id], np.uint32).tobytes()
        for portion in by_bytes((t or "" for t in batch["text"].to_pylist()), BATCH):
            coded = coder.encode_all(portion) if len(portion) > 1 else [b"".join(coder.encode(portion[0]))]
            for ids in coded:
                yield Example(next(keys), np.frombuffer(ids + end, np.uint32))

    rows = own(df, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return pack_rows(rows, kind, examples, limits).selectExpr(
        "key as doc_id", "start", "length", "ids_crc32", "total as doc_tokens", "sequence_id", "offset"
    )
