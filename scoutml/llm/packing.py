"""Operator 2: harmonic packing of tokenised documents into fixed-length sequences.

A document's ids (with the end id) are cut by a rule that looks at nothing but
their number: whole sequences first, then pieces of capacity/2, /4, ... down to
``smallest``, and one short rest.  A piece of length n belongs to class
j = capacity // n (the reciprocal-capacity interval (capacity/(j+1), capacity/j])
and every sequence of class j holds exactly j pieces.  Each task fills its own
sequences as rows stream by; it holds at most j - 1 open pieces of a class, so
its memory is bounded whatever the input.  At its end the open pieces are strung
together and cut at the capacity, and the very last run is cut into powers of
two, which need no padding.

Nothing is shuffled.  A task that is run again gives the same sequences as long
as its rows come in the same order, which holds for a written table; sequence
ids carry the task's partition number.

Edge cases: a null or empty text is one piece holding only the end id; texts of
any length are streamed into whole sequences; repeated rows are packed each on
its own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scoutml.llm.common import keyed_text, list_array, map_batches
from scoutml.llm.words_bpe import VOCABULARY, WordEncoder

SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def cut_points(n: int, capacity: int, smallest: int) -> list[tuple[int, int]]:
    """(start, length) pieces of n ids."""
    pieces, start = [], 0
    while n - start >= capacity:
        pieces.append((start, capacity))
        start += capacity
    size = capacity // 2
    while size >= smallest:
        if n - start >= size:
            pieces.append((start, size))
            start += size
        size //= 2
    if start < n:
        pieces.append((start, n - start))
    return pieces


class _Packer:
    """Open pieces by class of one task."""

    def __init__(self, capacity: int, smallest: int, end_id: int, vocabulary: str):
        self.capacity, self.smallest, self.end = capacity, smallest, np.array([end_id], np.uint32)
        self.encoder = WordEncoder(vocabulary)
        self.open: dict[int, list] = {}
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows))
        self.rows = []
        ids = list_array([x.astype("<u4").tobytes() for x in cols[3]], "<i4", pa.int32())
        long = lambda c: pa.array(c, type=pa.int64())
        return pa.RecordBatch.from_arrays(
            [long(cols[0]), long(cols[1]), long(cols[2]), ids, long(cols[4]), long(cols[5]), long(cols[6])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def __call__(self, batch: pa.RecordBatch):
        docs = batch.column(0).to_pylist()
        for low in range(0, len(docs), 512):
            texts = batch.column(1).slice(low, 512).to_pylist()
            for doc, body in zip(docs[low : low + 512], self.encoder.encode(texts)):
                ids = np.concatenate([body, self.end])
                for start, size in cut_points(len(ids), self.capacity, self.smallest):
                    count = self.capacity // size
                    pile = self.open.setdefault(count, [])
                    pile.append((doc, start, ids[start : start + size], len(ids)))
                    if len(pile) == count:
                        self._emit(pile)
                        self.open[count] = []
            if self.rows:
                yield self._batch()

    def finish(self):
        """The open pieces, strung together: full sequences, then powers of two."""
        left = sum(len(p[2]) for pile in self.open.values() for p in pile)
        targets = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        targets += [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
        room, run = (targets.pop(0) if targets else 0), []
        for _, pile in sorted(self.open.items()):
            for doc, start, ids, total in pile:
                while len(ids):
                    take = min(room, len(ids))
                    run.append((doc, start, ids[:take], total))
                    start, ids, room = start + take, ids[take:], room - take
                    if not room:
                        self._emit(run)
                        room, run = (targets.pop(0) if targets else 0), []
        if self.rows:
            yield self._batch()


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, smallest: int = 64,
    end_id: int = 1, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pieces with their ids and places.  ``capacity`` is a power of two; padding is what a sequence lacks of it."""
    if capacity & (capacity - 1) or smallest < 1:
        raise ValueError("capacity must be a power of two and smallest at least 1")
    return map_batches(
        keyed_text(docs, key, text), lambda: _Packer(capacity, smallest, end_id, vocabulary), SCHEMA
    )


def piece_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` (unsigned, over little-endian unsigned 32-bit ids) in place of the ids."""

    def step(batch: pa.RecordBatch):
        lists = batch.column(batch.schema.get_field_index("ids"))
        ends = lists.offsets.to_numpy()
        data = lists.values.to_numpy().astype("<i4", copy=False).tobytes()
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        cols = [pa.array(sums, type=pa.int64()) if n == "ids" else batch.column(i) for i, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(cols, names=["ids_crc32" if n == "ids" else n for n in batch.schema.names])

    return map_batches(pieces, lambda: step, SCHEMA.replace("ids array<int>", "ids_crc32 long"))
