"""Operator 7: encoding by content-defined chunk reuse, and decoding.

A rolling hash over the last 16 characters cuts each text where its top bits
are zero, so equal passages are cut alike wherever they stand.  Each distinct
chunk is encoded once per task; its stretch from the first to the last white
space keeps its ids whatever its neighbours are.  What lies outside that
stretch is a join: the end of one chunk and the beginning of the next are put
together and encoded anew, and the join grows over further chunks until white
space closes it on both sides, where the new ids and those of the chunks agree
exactly with the ids of the whole text.  Chunks remembered are bounded by
``limit`` characters per task; nothing is shuffled.

Edge cases: null and empty texts have no ids and decode to the empty text; a
text without white space is one join and is encoded whole; special tokens
written in a text are taken as the library takes them; repeated rows are encoded
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scoutml.llm.common import keyed_text, list_array, load_tokenizer, map_batches
from scoutml.llm.words_bpe import VOCABULARY, WordEncoder

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_GAP = re.compile("[ \t\n\r]")


def chunk_limits(text: str, bits: int) -> list[int]:
    """Ends of the content-defined chunks of a text; about 2**bits characters apart."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = _GEAR[code & 255]
    for shift in (1, 2, 4, 8):  # sums of the last 2, 4, 8, 16 characters' values
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    ends = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


class _ChunkEncoder:
    def __init__(self, vocabulary: str, bits: int, limit: int):
        self.encoder = WordEncoder(vocabulary)
        self.bits, self.limit = bits, limit
        self.bodies: dict[str, np.ndarray] = {}
        self.chars = 0

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is a chunk's body, characters) in order; what is not a body is a join."""
        out, join, low = [], "", 0
        for high in chunk_limits(text, self.bits) if text else []:
            chunk = text[low:high]
            low = high
            gap = _GAP.search(chunk)
            if gap is None:  # no white space: the join goes on
                join += chunk
                continue
            first, last = gap.start(), max(chunk.rfind(c) for c in " \t\n\r")
            out.append((False, join + chunk[:first]))
            out.append((True, chunk[first : last + 1]))
            join = chunk[last + 1 :]
        out.append((False, join))
        return [p for p in out if p[1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chars > self.limit:
            self.bodies, self.chars = {}, 0
        split = [self.parts(t) for t in texts]
        new = list({p for parts in split for body, p in parts if body and p not in self.bodies})
        joins = [p for parts in split for body, p in parts if not body]
        done = self.encoder.encode(new + joins)
        self.bodies.update(zip(new, (x.copy() for x in done)))
        self.chars += sum(map(len, new))
        fresh = iter(done[len(new) :])
        return [b"".join([(self.bodies[p] if body else next(fresh)).tobytes() for body, p in parts]) for parts in split]

    def __call__(self, batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, 512):
            ids = self.encode(batch.column(1).slice(low, 512).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, 512), list_array(ids, "<i4", pa.int32())], names=["doc_id", "ids"]
            )


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, bits: int = 7,
    limit: int = 20_000_000,
) -> DataFrame:
    """(doc_id, ids) with the ids of every whole text."""
    return map_batches(
        keyed_text(docs, key, text), lambda: _ChunkEncoder(vocabulary, bits, limit), "doc_id long, ids array<int>"
    )


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): the library's text for the ids, special tokens kept.

    The vocabulary has no decoder of its own, so the text is its tokens joined by one space.
    """

    def make():
        tok = load_tokenizer(vocabulary)
        if tok.decoder is not None:
            raise ValueError("this decoder joins plain tokens only")
        names = np.array([tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))], dtype=object)

        def step(batch: pa.RecordBatch):
            for low in range(0, batch.num_rows, 512):
                lists = batch.column(1).slice(low, 512)
                ends = lists.offsets.to_numpy()
                words = names[lists.values.to_numpy()[ends[0] : ends[-1]]]
                ends = (ends - ends[0]).tolist()
                text = [" ".join(words[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, 512), lists, pa.array(text, type=pa.string())], names=["doc_id", "ids", "decoded"]
                )

        return step

    return map_batches(encoded, make, "doc_id long, ids array<int>, decoded string")
