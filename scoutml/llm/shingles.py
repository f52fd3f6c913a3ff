"""Word shingles of whole texts as 64-bit codes, by numpy over slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(99)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
SLICE = 500_000


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; each salt gives another order of the codes."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[bytes], size: int) -> list[np.ndarray]:
    joined = b" ".join(texts)
    b = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    word = ~_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    place = np.arange(len(b))
    place[start[0] :] -= np.repeat(start, np.diff(start, append=len(b)))
    value = _BYTE[b] * _PLACE[place & 4095]
    far = np.flatnonzero(place > 4095)
    if len(far):  # each stretch of 4,096 bytes has factors of its own
        value[far] *= mix((place[far] >> 12).astype(np.uint64), 2) | np.uint64(1)
    value[~word] = 0
    code = mix(np.add.reduceat(value, start))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = [0, *np.searchsorted(start, ends).tolist()]
    window = np.zeros(max(len(code) - size + 1, 0), np.uint64)
    for k in range(size):
        window += code[k : k + len(window)] * _STEP[k]
    window = mix(window)
    out = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z - a >= size:
            out.append(np.unique(window[a : z - size + 1]))
        elif z > a:
            out.append(mix((code[a:z] * _STEP[: z - a]).sum(keepdims=True) + np.uint64(z - a), 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str], size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle codes, ascending; fewer words than ``size`` are one shingle, none are none."""
    for _, sets in shingle_slices(texts, size):
        yield from sets


def shingle_slices(texts: list[str], size: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, sets) of slices of the texts, each of about SLICE bytes."""
    part, chars, low = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        part.append(raw)
        chars += len(raw)
        if chars >= SLICE:
            yield low, _codes(part, size)
            part, chars, low = [], 0, i + 1
    if part:
        yield low, _codes(part, size)


class Flat:
    """Sets laid end to end: codes, the sets' sizes, and each code's set and rank in it."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.code = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.of = np.repeat(np.arange(len(sets)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.rank = np.arange(len(self.code)) - self.first[self.of]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by set (wrapping)."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[self.first + self.size] - total[self.first]

    def keys(self, salt: int) -> np.ndarray:
        """A 64-bit code of each set."""
        return mix(self.sums(mix(self.code, salt)) + self.size.astype(np.uint64), salt + 1).view(np.int64)
