"""Operator 11: alignment of two tokenizers' tokens, by skipping along diagonals.

A text with a space before it is coded by a byte-level vocabulary (A) and a
piece vocabulary (B); both cut the same bytes.  Their end arrays are compared at
the current index shift: windows that double in width jump over one-to-one
stretches, halve again where they fail, and at the first unequal end the two
sides are stepped until they meet.  That is an irregular group; the shift is
what they then differ by.  A group is the tokens between two common ends.

Neither vocabulary has a token that goes on past a space after another
character, so texts are cut there into units, and a task codes and aligns each
distinct unit once (at most ``UNITS`` are remembered), many units laid end to end
at a time.  A document is its units' groups in order.

Pairs of ids are counted over documents: each block of documents (about ``BLOCK``
characters) gives its distinct linked pairs, Spark adds them up and sends each
block the counts of its own pairs, so nothing is counted on the driver and a pair
that stands in all documents is one row a block.

Edge cases: null and empty texts, and texts that either vocabulary does not give
back byte for byte, have no tokens, no groups and no links; special tokens'
strings are plain text; a text of any length is coded whole; repeated rows are
documents each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import keyed_text, load_tokenizer, map_batches, stored, tokenizer_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: units remembered in a task, and their characters; characters coded at once; characters of a block of documents
UNITS, UNIT_CHARS, SLICE, BLOCK = 500_000, 16_000_000, 1_000_000, 4_000_000
#: a pair's code is its A id times this plus its B id
WIDTH = 1 << 15
_MARK = "▁"
_CUT = re.compile(r"(?<=\S) ")
_BLANKS = re.compile(r"\s ")
_WIDE = re.compile("[^\x00-\xff]")


def align_ends(a: list[int], b: list[int]) -> np.ndarray:
    """Groups of two ascending end arrays with the same last end: rows (A tokens, B tokens up to the group's end)."""
    groups = []  # rows (i, j, length): ``length`` groups that end with one token each from i and j on
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            start, width = i, 1
            while width:  # windows double while they agree, then halve
                if i < n and a[i : i + width] == b[j : j + width]:
                    step = min(width, n - i)
                    i += step
                    j += step
                    width *= 2
                    continue
                width //= 2
                while width:
                    if i < n and a[i : i + width] == b[j : j + width]:
                        step = min(width, n - i)
                        i += step
                        j += step
                    width //= 2
            groups.append((start, j - i + start, i - start))
            continue
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        groups.append((i, j, 1))
        i += 1
        j += 1
    return _spread(groups) + 1


def links_of(a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Rows (A index, B index) of tokens that overlap: one for each end inside a group and one for its common end."""
    inner_a, inner_b = np.ones(len(a), bool), np.ones(len(b), bool)
    inner_a[groups[:, 0] - 1], inner_b[groups[:, 1] - 1] = False, False
    own, other = np.flatnonzero(inner_a), np.flatnonzero(inner_b)
    rows = np.concatenate([
        groups - 1,
        np.stack([own, np.searchsorted(b, a[own])], axis=1),
        np.stack([np.searchsorted(a, b[other]), other], axis=1),
    ])
    return rows[np.argsort(rows.sum(axis=1))]


def _spread(runs: list[tuple[int, int, int]]) -> np.ndarray:
    runs = np.array(runs, dtype=np.int64).reshape(-1, 3)
    size = runs[:, 2]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(runs[:, :2], size, axis=0) + inside[:, None]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 256 and c != 173]
    rest = [c for c in range(256) if c not in set(plain)]
    return {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(rest)}


def _ranks(name: str, entries: list[bytes]):
    """A faster coder with the same entries, for Latin-1 text, whose classes of characters all coders share; None if there is none."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = tokenizer_path(name.replace(".json", ".tiktoken"))
    if not os.path.exists(path):
        return None
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    if any(entries[i] != t for t, i in ranks.items()):
        return None
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Units to tokens, groups and links; one a task."""

    def __init__(self, a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY, limit: int = UNITS):
        import sentencepiece

        self.a = load_tokenizer(a_name)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b_name))
        letters = byte_alphabet()
        entry = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [b""] * (entry[-1][0] + 1)
        for i, t in entry:
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
        self.ranks = _ranks(a_name, self.a_bytes)
        if len(self.b_bytes) > WIDTH or len(self.a_bytes) * WIDTH >= 1 << 31:
            raise ValueError("the vocabularies are too large for 31-bit pair codes")
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.blank = self.b.piece_to_id(_MARK)
        na, nb = len(self.a_bytes), len(self.b_bytes)
        text = [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)] + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]
        self.text = np.array(text, dtype=object)
        self.text_size = np.array([len(x) for x in text], dtype=np.int64)
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((1024, 4), dtype=np.int64)  # A tokens, B tokens, groups, fits
        self.first, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0
        self.chars = 0

    def units_of(self, text: str) -> list[str]:
        """``text`` cut at every space that follows another character; each unit's own first space is left out."""
        if "  " in text or text[0] == " " or _BLANKS.search(text):
            units = _CUT.split(" " + text)
            units[0] = units[0][1:]
            return units
        return text.split(" ")

    def rows_of(self, units: list[list[str]]) -> np.ndarray:
        """Pool rows of the units of all documents, in order."""
        flat = list(chain.from_iterable(units))
        try:
            return np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            new = list(set(flat).difference(self.place))
        if self.place and (len(self.place) + len(new) > self.limit or self.chars > UNIT_CHARS):
            self.forget()
            new = list(set(flat))
        self.learn(new)
        return np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))

    def learn(self, units: list[str]) -> None:
        part, size = [], 0
        units.sort(key=lambda u: _WIDE.search(u) is not None)  # Latin-1 first
        for u in units:
            if not u or u[-1].isspace() or len(u) > 50_000:
                self._together([u])
                continue
            part.append(u)
            size += len(u)
            if size > 100_000:
                self._together(part)
                part, size = [], 0
        if part:
            self._together(part)

    def _together(self, units: list[str]) -> None:
        """Codes and aligns the units laid end to end; halves the list where the bytes or limits do not fit."""
        joined = " ".join(units)
        raw = (" " + joined).encode("utf-8")
        a = self._encode_a(" " + joined)
        b = self.b.encode(joined) if joined else [self.blank]
        fits = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
        size = list(map(len, units)) if len(raw) == len(joined) + 1 else [len(u.encode("utf-8")) for u in units]
        limit = np.cumsum(np.array(size) + 1)
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        if fits:
            ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            at_a, at_b = np.searchsorted(ends_a, limit), np.searchsorted(ends_b, limit)
            fits = bool((ends_a[at_a] == limit).all() and (ends_b[at_b] == limit).all())
        if not fits:
            if len(units) > 1:
                half = len(units) // 2
                self._together(units[:half])
                self._together(units[half:])
            else:
                self._keep(units, np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))
            return
        groups = align_ends(ends_a.tolist(), ends_b.tolist())
        links = links_of(ends_a, ends_b, groups)
        last = np.searchsorted(groups[:, 0], at_a + 1)
        counts = np.stack([np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1), np.diff(last, prepend=-1), np.ones(len(units), np.int64)], axis=1)
        cuts = np.concatenate([[0], np.cumsum(self.text_size[order := self._order(a, b, groups)])])[at_a + at_b + 2]
        text = "".join(self.text[order].tolist())
        texts = [text[x:y] for x, y in zip([0, *cuts.tolist()], cuts.tolist())]
        self._keep(units, counts, texts, a[links[:, 0]] * WIDTH + b[links[:, 1]], counts[:, 0] + counts[:, 1] - counts[:, 2])

    def _encode_a(self, text: str) -> list[int]:
        if self.ranks and not _WIDE.search(text):
            return self.ranks.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _order(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Rows of ``text`` of all tokens, group by group, A before B."""
        size = np.diff(groups, axis=0, prepend=0)
        ends = np.zeros(len(a) + len(b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(groups)), size[:, 0]), np.repeat(np.arange(len(groups)), size[:, 1])
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[groups[:, 0] - 1], last_b[groups[:, 1] - 1] = True, True
        na, nb = len(self.a_bytes), len(self.b_bytes)
        before = groups[:, 1] - size[:, 1]
        ends[np.arange(len(a)) + before[of_a]] = a + na * last_a
        ends[np.arange(len(b)) + groups[of_b, 0]] = b + 2 * na + nb * last_b
        return ends

    def _keep(self, units, counts, texts, codes, n_codes) -> None:
        base, n = len(self.groups), len(units)
        while base + n > len(self.first):
            self.counts, self.first = np.concatenate([self.counts] * 2), np.concatenate([self.first] * 2)
        while self.used + len(codes) > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.place.update(zip(units, range(base, base + n)))
        self.chars += sum(map(len, units))
        self.groups += texts
        self.counts[base : base + n] = counts
        self.first[base : base + n] = self.used + np.cumsum(n_codes) - n_codes
        self.pool[self.used : self.used + len(codes)] = codes
        self.used += len(codes)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[bytes], list[bytes]]:
        """Of each text: counts (A tokens, B tokens, groups, links), groups as ``a1,a2|b1;a3|b2,b3``, its distinct pair codes, and how often each is linked."""
        full = [i for i, t in enumerate(texts) if t]
        counts, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        codes, uses = [b""] * len(texts), [b""] * len(texts)
        if not full:
            return counts, groups, codes, uses
        units = [self.units_of(texts[i]) for i in full]
        rows = self.rows_of(units)
        size = np.array([len(u) for u in units])
        start = np.cumsum(size) - size
        per = self.counts[rows]
        total = np.add.reduceat(per, start, axis=0)
        fits = total[:, 3] == size
        total[:, 3] = total[:, 0] + total[:, 1] - total[:, 2]
        n = (per[:, 0] + per[:, 1] - per[:, 2]) * np.repeat(fits, size)
        doc = np.repeat(np.arange(len(full)), size)
        ends = np.cumsum(n)
        found = self.pool[np.repeat(self.first[rows] - ends + n, n) + np.arange(ends[-1])]
        key, use = np.unique((np.repeat(doc, n) << 31) | found, return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(full) + 1) << 31)
        key, use = (key & ((1 << 31) - 1)).astype(np.int32), use.astype(np.int32)
        rows = rows.tolist()
        for k, i in enumerate(full):
            if fits[k]:
                counts[i] = total[k]
                groups[i] = "".join([self.groups[r] for r in rows[start[k] : start[k] + size[k]]])[:-1]
                codes[i], uses[i] = key[cuts[k] : cuts[k + 1]].tobytes(), use[cuts[k] : cuts[k + 1]].tobytes()
        return counts, groups, codes, uses


class _Align:
    """Batches of (doc_id, text) to aligned documents with the block they belong to."""

    def __init__(self, a_name: str, b_name: str):
        self.aligner = Aligner(a_name, b_name)
        self.block, self.chars = TaskContext.get().partitionId() << 32, 0

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), batch.column(1)
        low, size = 0, 0
        lengths = pc.utf8_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= SLICE or i == len(lengths) - 1:
                yield self._slice(ids.slice(low, i + 1 - low), texts.slice(low, i + 1 - low).to_pylist())
                self.chars += size
                low, size = i + 1, 0
                if self.chars >= BLOCK:
                    self.block, self.chars = self.block + 1, 0

    def _slice(self, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        counts, groups, codes, uses = self.aligner.align(texts)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(len(ids), self.block), pa.int64()), *[pa.array(counts[:, k], pa.int64()) for k in range(4)],
             pa.array(groups, pa.string()), pa.array(codes, pa.binary()), pa.array(uses, pa.binary())],
            names=["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "uses"],
        )


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY) -> DataFrame:
    """(doc_id, block, n_a, n_b, n_groups, n_links, groups, codes, uses) of every row.

    ``groups`` is the alignment as text; ``codes`` packs the distinct linked id
    pairs (32-bit, A id * WIDTH + B id, ascending), ``uses`` how often each is linked.
    """
    return map_batches(
        keyed_text(docs, key, text), lambda: _Align(a_name, b_name),
        "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, uses binary",
    )


class _BlockPairs:
    """The distinct pair codes of each block and the number of its documents that hold them."""

    def __init__(self):
        self.block, self.codes, self.size = None, [], 0

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != self.block or self.size > 4 * BLOCK:
                yield from self.finish()
                self.block = block
            self.codes.append(np.frombuffer(codes, np.int32))
            self.size += len(self.codes[-1])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            code, docs = np.unique(np.concatenate(self.codes), return_counts=True)
            block = np.full(len(code), self.block)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(code, pa.int32()), pa.array(docs, pa.int64())], names=["block", "code", "docs"])
        self.codes, self.size = [], 0


def _weigh(aligned: pa.Table, weights: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block, given the counts of the block's pairs."""
    code, first = np.unique(weights["code"].to_numpy(), return_index=True)
    docs, best = weights["docs"].to_numpy()[first], weights["best"].to_numpy(zero_copy_only=False)[first]
    sums, highs = [], []
    for codes, uses in zip(aligned["codes"].to_pylist(), aligned["uses"].to_pylist()):
        at, n = np.searchsorted(code, np.frombuffer(codes, np.int32)), np.frombuffer(uses, np.int32).astype(np.int64)
        sums.append(int((docs[at] * n).sum()))
        highs.append(int(n[best[at]].sum()))
    out = aligned.drop_columns(["block", "codes", "uses"])
    return out.append_column("n_best", pa.array(highs, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, docs, best): documents that hold each pair, and whether that is its A id's highest count."""
    counts = pairs.groupBy("code").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("code", 15))
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("code", "docs", (F.col("docs") == F.col("top")).alias("best"))


def weigh_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (a written table with block, codes and uses) with n_best and count_sum in place of these three."""
    pairs = stored(map_batches(aligned.select("block", "codes"), _BlockPairs, "block long, code int, docs long"))
    weights = pairs.select("block", "code").join(pair_counts(pairs), "code")
    kept = [f for f in aligned.schema.fields if f.name not in ("block", "codes", "uses")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return aligned.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(_weigh, schema)
