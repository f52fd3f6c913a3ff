"""Batch encoding with a lower-casing word BPE vocabulary, equal to encoding each text whole.

Such a vocabulary never joins tokens across pre-token limits, so each distinct
pre-token is encoded once per task by the tokenizers library and looked up
afterwards.  Pre-tokens are found, hashed (64 bits) and looked up by numpy over
a slice of texts.  Only texts of Latin-1 characters are split here, where lower
case, normal form and character classes are plain; texts with other characters,
or with ``<|`` (special tokens), go through the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

from scoutml.llm.common import load_tokenizer
from scoutml.llm.shingles import mix

VOCABULARY = "word_bpe_49k.json"
_WIDE = re.compile("[^\x00-\xff]")
_SLICE = 2_000_000  # characters worked on at once

# Classes of the vocabulary's own pre-tokenizer, over lower-cased Latin-1:
# 0 space, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
_CLASS[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def _starts(b: np.ndarray) -> np.ndarray:
    """Flags of the first byte of each pre-token."""
    kind = _CLASS[b]
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero((b == 39) & start)
    if len(quotes):
        padded = np.concatenate([b, np.zeros(3, dtype=np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [115, 116, 109, 100])  # 's 't 'm 'd
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # 're 've 'll
        start[quotes[short | pair] + 1] = False
        after = np.concatenate([quotes[short] + 2, quotes[pair & ~short] + 3])
        after = after[after < len(b)]
        start[after] |= kind[after] == 1
    return start


class WordEncoder:
    """Texts to ids; ``limit`` bounds the distinct pre-tokens remembered per task."""

    def __init__(self, name: str = VOCABULARY, limit: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = load_tokenizer(name)
        self.words = Tokenizer(self.tok.model)  # the same merges, for words that are split and lower-cased already
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.mask = (1 << (2 * self.limit).bit_length()) - 1
        self.table, self.row = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _find(self, keys: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Rows of the keys (-1: unknown) by linear probing; with ``rows``, unknown distinct keys are put there."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        spot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            here = spot[todo]
            free = self.row[here] < 0
            if rows is not None and free.any():
                self.table[here[free]], self.row[here[free]] = keys[todo[free]], rows[todo[free]]
                free[:] = False  # of keys that meet in one place the last stays; the others go on
            hit = ~free & (self.table[here] == keys[todo])
            found[todo[hit]] = self.row[here[hit]]
            todo = todo[~free & ~hit]
            spot[todo] = (spot[todo] + 1) & self.mask
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        part, chars = [], 0
        for i, text in enumerate(texts):
            if "<|" in text or _WIDE.search(text):
                out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            part.append(i)
            chars += len(text) + 1
            if chars >= _SLICE:
                self._plain(texts, part, out)
                part, chars = [], 0
        if part:
            self._plain(texts, part, out)
        return out

    def _plain(self, texts: list[str], part: list[int], out: list[np.ndarray]) -> None:
        raw = [texts[i].lower().encode("latin-1") for i in part]
        joined = b"\n".join(raw)
        b = np.frombuffer(joined, dtype=np.uint8)
        start = np.flatnonzero(_starts(b)) if len(b) else np.zeros(0, np.int64)
        lengths = np.array([len(r) + 1 for r in raw])
        ends = np.cumsum(lengths)
        if not len(start):
            for i in part:
                out[i] = np.zeros(0, np.uint32)
            return
        place = np.arange(len(b))
        place[start[0] :] -= np.repeat(start, np.diff(start, append=len(b)))
        value = _BYTE[b] * _PLACE[place & 4095]
        far = np.flatnonzero(place > 4095)
        if len(far):  # each stretch of 4,096 bytes has factors of its own
            value[far] *= mix((place[far] >> 12).astype(np.uint64), 2) | np.uint64(1)
        value[_CLASS[b] == 0] = 0
        code = np.add.reduceat(value, start)
        code ^= code >> np.uint64(29)
        back, uniq = pd.factorize(code)
        at = np.empty(len(uniq), np.int64)
        at[back[::-1]] = np.arange(len(back))[::-1]
        slots = self._slots(uniq, joined, start, at, b)
        word = slots[back]
        n = self.size[word]
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[word] - total + n, n) + np.arange(total[-1])]
        cuts = np.concatenate([[0], total])[np.searchsorted(start, ends)]
        low = 0
        for i, high in zip(part, cuts.tolist()):
            out[i] = ids[low:high]
            low = high

    def _slots(self, uniq, joined, start, at, b) -> np.ndarray:
        if self.known + len(uniq) > self.limit:
            self._forget()
        slots = self._find(uniq)
        new = np.flatnonzero(slots < 0)
        if len(new):
            stop = np.append(start[1:], len(b))
            words = [joined[s:e].decode("latin-1").rstrip("\t\n\x0b\x0c\r \x85\xa0")
                     for s, e in zip(start[at[new]].tolist(), stop[at[new]].tolist())]
            slots[new] = np.arange(self.known, self.known + len(new))
            for lo in range(0, len(words), 2000):
                self._learn(words[lo : lo + 2000])
            self._find(uniq[new], slots[new])
        return slots

    def _learn(self, words: list[str]) -> None:
        e = self.words.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.uint32)
        size = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(words))
        base, n = self.known, len(words)
        while base + n > len(self.first):
            self.first, self.size = np.concatenate([self.first] * 2), np.concatenate([self.size] * 2)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.first[base : base + n] = self.used + np.cumsum(size) - size
        self.size[base : base + n] = size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known += n
