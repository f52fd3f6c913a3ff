"""Operator 4: language identification with Viterbi over words.

Training counts character trigrams (with word ends) of words by language over at
most ``TRAIN_DOCS`` documents of a language (a hash sample; all of them where
there are fewer) and the share of each script in its words.  A word's scores are
the log probabilities of its trigrams under every language whose training words
use the word's script (script ranges narrow the candidates; if none does, all
stay), with other languages at ``FLOOR`` below.  Viterbi finds the best labels of
the words of a text when each change of language costs ``SWITCH``; runs of one
label are spans.  The table is skipped where the best language of the whole text
is the exact optimum for all its words: no stretch gains more than ``SWITCH`` by
another language, so k stretches beside words of the best one do not pay their k
changes; and no beginning and end together gain more than ``SWITCH``, so neither
do k stretches that fill the text, which cost one change less.

A document's language has the most letters in its spans; its score is their share.

Edge cases: null texts and texts without letters are ``und`` with score 0 and no
spans; so is everything when no labelled rows exist; a text of any length is
read whole; ties go to the first language in order of names; repeated rows are
labelled each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import keyed_text, map_batches

TRAIN_DOCS, GRAMS = 500, 20_000
MAX_LANGUAGES = 400
SWITCH, FLOOR, CLIP = 12.0, 12.0, 12.0
SCRIPT_SHARE = 0.01
_RUNS = re.compile(r"[^\W\d_]+")


def _numerals() -> str:
    """Characters of the runs that are no letters: numbers without being decimal digits, such as 2 raised or Roman 4."""
    return "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())


_LETTERS = re.compile(f"[^\\W\\d_{re.escape(_numerals())}]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text."""
    words = _RUNS.findall(text)
    return words if "".join(words).isalpha() or not words else _LETTERS.findall(text)

#: First code points of script ranges, ascending, with the script from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
_SCRIPT_STARTS = [s for s, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_SCRIPT_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % parts == part


class Model:
    """Trigram log probabilities and scripts by language; a plain object of bounded size."""

    def __init__(self, counts: dict[str, Counter], scripts: dict[str, Counter]):
        self.names = sorted(counts)
        n = len(self.names)
        rows: dict[str, np.ndarray] = {}
        vocabulary = len({g for c in counts.values() for g in c}) + 1
        total = [sum(counts[x].values()) + vocabulary for x in self.names]
        self.unknown = np.array([-math.log(t) for t in total], dtype=np.float64)
        for k, name in enumerate(self.names):
            for g, c in counts[name].items():
                rows.setdefault(g, self.unknown.copy())[k] = math.log((c + 1) / total[k])
        self.place = {g: i for i, g in enumerate(rows)}
        self.table = np.array([*rows.values(), self.unknown]).reshape(len(rows) + 1, n)
        self.scripts = {}
        for s in {s for c in scripts.values() for s in c}:
            used = np.array([scripts[x][s] >= SCRIPT_SHARE * max(1, sum(scripts[x].values())) for x in self.names])
            if used.any():
                self.scripts[s] = used
        self.all = np.ones(n, dtype=bool)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        get, unknown = self.place.get, len(self.place)
        low = [w.lower() for w in words]
        found = [get(g, unknown) for w in low for g in grams(w)]
        size = np.array([len(w) for w in low])
        s = np.add.reduceat(self.table[found], np.cumsum(size) - size, axis=0)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -CLIP)
        candidates = np.array([self.scripts.get(script_of(w), self.all) for w in low])
        return np.where(candidates, s, -CLIP - FLOOR)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows with a language that are not held out (crc32 of the key mod 4 is not 2)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key), 4, 2), F.lit(False)))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model({}, {})
    share = F.element_at(
        F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, min(1.0, TRAIN_DOCS / c))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        found: dict[tuple, int] = Counter()
        for pdf in batches:
            for language, body in zip(pdf["lang"], pdf["text"]):
                words = Counter(w.lower() for w in words_of(body))
                for w, c in words.items():
                    found[language, "script", script_of(w)] += c
                    for g in grams(w):
                        found[language, "gram", g] += c
            if len(found) > 200_000:
                yield pd.DataFrame([(*k, c) for k, c in found.items()], columns=["lang", "kind", "item", "c"])
                found = Counter()
        if found:
            yield pd.DataFrame([(*k, c) for k, c in found.items()], columns=["lang", "kind", "item", "c"])

    counted = sample.mapInPandas(count, "lang string, kind string, item string, c long")
    counted = counted.groupBy("lang", "kind", "item").agg(F.sum("c").alias("c"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("c"), "item"))
    kept = counted.withColumn("r", rank).where(F.col("r") <= GRAMS).select("lang", "kind", "item", "c").collect()
    tables: dict[str, dict[str, Counter]] = {"gram": {k: Counter() for k in sizes}, "script": {k: Counter() for k in sizes}}
    for r in kept:
        tables[r.kind][r.lang][r.item] = r.c
    return Model(tables["gram"], tables["script"])


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the words that maximise the sum of scores less ``switch`` a change."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    stretch = (gain - np.vstack([np.zeros(gain.shape[1]), floor[:-1]])).max()
    if stretch <= switch and gain.max() + (gain[-1] - floor[-1]).max() <= switch:
        return np.full(len(scores), best)
    value = scores[0].copy()
    stays, tops = np.ones(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int64)
    for t in range(1, len(scores)):
        top = int(value.argmax())
        moved = value[top] - switch
        stay = value >= moved
        value = np.where(stay, value, moved) + scores[t]
        stays[t], tops[t] = stay, top
    path = np.empty(len(scores), dtype=np.int64)
    label = int(value.argmax())
    for t in range(len(scores) - 1, -1, -1):
        path[t] = label
        if not stays[t, label]:
            label = int(tops[t])
    return path


class _Labeller:
    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.model.names)))

    def scores(self, words: list[str]) -> np.ndarray:
        place = self.place
        try:
            return self.table[list(map(place.__getitem__, words))]
        except KeyError:
            pass
        new = [w for w in set(words) if w not in place]
        if len(place) + len(new) > self.limit:
            self.forget()
            place, new = self.place, list(set(words))
        while len(place) + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[len(place) : len(place) + len(new)] = self.model.scores(new)
        place.update(zip(new, range(len(place), len(place) + len(new))))
        return self.table[list(map(place.__getitem__, words))]

    def label(self, text: str) -> tuple[str, float, list[dict]]:
        words = words_of(text) if self.model.names else []
        if not words:
            return "und", 0.0, []
        path = best_path(self.scores(words), SWITCH)
        names = self.model.names
        if (path == path[0]).all():
            return names[path[0]], 1.0, [{"start": 0, "end": len(text), "lang": names[path[0]]}]
        weight = np.bincount(path, weights=[len(w) for w in words], minlength=len(names))
        starts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        at = [m.start() for m in _LETTERS.finditer(text)]
        edges = [0, *[at[i] for i in starts[1:]], len(text)]
        spans = [{"start": a, "end": b, "lang": names[path[i]]} for a, b, i in zip(edges[:-1], edges[1:], starts)]
        top = int(weight.argmax())
        return names[top], float(weight[top] / weight.sum()), spans

    def __call__(self, batch: pa.RecordBatch):
        found = [self.label(t) for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
             pa.array([f[2] for f in found], kind)],
            names=["doc_id", "lang_pred", "score", "spans"],
        )


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans in code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(
        keyed_text(docs, key, text), lambda: _Labeller(shared.value),
        "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>",
    )
