"""Operator 13: phrase collocations from sorted count streams.

Texts are coded once into chunks of one language each (about ``CHUNK``
characters): the chunk's distinct words, their counts and the word numbers of
its text, written to the shared folder.  Words, pairs and triples that occur
``LEAST`` times or more are counted in three rounds; a pair is counted only
where both words may be that frequent and a triple only where both pairs may.
That test is a bitmap of fixed size (``BITS``): it may let too much pass, never
too little, so the counts are exact whatever the size of the data.

The three count streams are then kept in prefix order (language, first word,
second, third) and suffix order (last word first), and merge-joined in lockstep:
Spark sorts both sides and reads them once, without hash tables, and splits
partitions that one word makes large.  The prefix joins give the left parts'
counts and the extensions to the right, the suffix joins the right parts' counts
and the extensions to the left.

Edge cases: null and empty texts have no words; a null language is ``und``, as
is the language of that name; a text of any length is read whole; repeated rows
count each; phrases never cross the limits of pieces or documents; an empty
table gives no rows; other columns are ignored; ties in score and count are
ranked by the phrase.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutml.llm.common import map_batches, stored, tidy_shuffles

LEAST, COVER, TOP = 10, 50, 2000
#: parts of a language that are ranked by themselves first
PARTS = 8
#: characters of a chunk; bits of the bitmaps (16 MiB)
CHUNK, BITS = 1_000_000, 1 << 27
#: bytes of a text split at once
_PART = 2_000_000
_BREAK = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes(
    255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256)
)


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _parts(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut after blanks or breaks, so that no word is cut."""
    low = 0
    while len(raw) - low > _PART:
        at = max(raw.rfind(b" ", low, low + _PART), raw.rfind(_BREAK, low, low + _PART))
        if at < low:
            at = min(x for x in (raw.find(b" ", low), raw.find(_BREAK, low), len(raw) - 1) if x >= 0)
        yield raw[low : at + 1]
        low = at + 1
    yield raw[low:]


class _Chunk:
    """Words and word numbers of texts of one language; number 0 is a break."""

    def __init__(self):
        self.numbers = _Numbers({_BREAK: 0})
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        raw = text.encode("utf-8").translate(_TABLE)
        self.size += len(raw) + 1
        for part in _parts(raw):
            words = part.replace(_BREAK, b" " + _BREAK + b" ").split()
            self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.codes.append(np.zeros(1, np.int32))


class _Code:
    """Batches of (lang, text) to chunks."""

    def __init__(self):
        self.chunks: dict[str, _Chunk] = {}

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunk = self.chunks.setdefault(lang, _Chunk())
            chunk.add(text)
            if chunk.size >= CHUNK:
                yield self._row(lang, self.chunks.pop(lang))
            elif sum(c.size for c in self.chunks.values()) >= 4 * CHUNK:
                yield from self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        while self.chunks:
            lang, chunk = self.chunks.popitem()
            yield self._row(lang, chunk)

    def _row(self, lang: str, chunk: _Chunk) -> pa.RecordBatch:
        codes = np.concatenate(chunk.codes)
        count = np.bincount(codes, minlength=len(chunk.numbers))
        words = pa.array(list(chunk.numbers)[1:], pa.binary()).cast(pa.string())
        ends = pa.array([0, len(words)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(count[1:], pa.int64())),
             pa.array([codes.astype(np.int32).tobytes()], pa.binary())],
            names=["lang", "words", "counts", "codes"],
        )


def code_texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The chunks of all texts: (lang, words, counts, codes), written to the shared folder."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    return stored(map_batches(rows, _Code, "lang string, words array<string>, counts array<long>, codes binary"))


def _spots(key: Column) -> Column:
    """The two bits of a 64-bit key."""
    return F.array(key.bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(BITS - 1)))


def _pair_key(first, second):
    """The key of a pair from its words' keys: works on columns and on arrays."""
    if isinstance(first, Column):
        return first.bitwiseXOR(F.shiftleft(second, 17)).bitwiseXOR(F.shiftrightunsigned(second, 47))
    first, second = first.view(np.uint64), second.view(np.uint64)
    return first ^ (second << np.uint64(17)) ^ (second >> np.uint64(47))


def _word_key(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


class Bitmap:
    """Bits of a set of keys, gathered by Spark in slots of 32,768 bits; its size does not depend on the data."""

    def __init__(self, keys: DataFrame):
        spot = keys.select(F.explode(_spots(F.col("key"))).alias("spot"))
        slots = spot.groupBy(F.bitmap_bucket_number("spot").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        self.bits = np.zeros(BITS // 8 + 4096, np.uint8)
        for row in slots.collect():
            # a spot s > 0 is bit (s - 1) % 32768 of slot 1 + (s - 1) / 32768; spot 0 is bit 0 of slot 0
            self.bits[row.slot * 4096 : (row.slot + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        key = key.view(np.uint64)
        found = np.ones(len(key), bool)
        for spot in (key & np.uint64(BITS - 1), (key >> np.uint64(32)) & np.uint64(BITS - 1)):
            place = np.where(spot > 0, spot.astype(np.int64) - 1 + 32768, 0)
            found &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return found


class _Phrases:
    """Counts the pairs, or the triples, of each chunk that may be frequent."""

    def __init__(self, words: Bitmap, pairs: Bitmap | None):
        self.words, self.pairs = words, pairs

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            words, keys = (batch.column(k).slice(i, 1).flatten() for k in (1, 2))
            yield from self._chunk(batch.column(0)[i].as_py(), words, keys.to_numpy(), np.frombuffer(batch.column(3)[i].as_py(), np.int32))

    def _chunk(self, lang: str, words: pa.Array, keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        often = np.concatenate([[False], self.words.has(keys)])
        at = np.flatnonzero(often[codes[:-1]] & often[codes[1:]])
        first, second = codes[at].astype(np.int64) - 1, codes[at + 1].astype(np.int64) - 1
        if self.pairs is None:
            key, n = np.unique((first << 32) | second, return_counts=True)
            parts = [key >> 32, key & 0xFFFFFFFF]
        else:
            fits = self.pairs.has(_pair_key(keys[first], keys[second]))
            at, pair = at[fits], ((first << 32) | second)[fits]
            both = np.flatnonzero(np.diff(at) == 1)
            pair, number = np.unique(pair, return_inverse=True)
            key, n = np.unique((number[both].astype(np.int64) << 32) | number[both + 1], return_counts=True)
            one, two = pair[key >> 32], pair[key & 0xFFFFFFFF]
            parts = [one >> 32, one & 0xFFFFFFFF, two & 0xFFFFFFFF]
        for low in range(0, len(n), 50_000):
            some = [words.take(pa.array(p[low : low + 50_000])) for p in parts]
            key = pc.binary_join_element_wise(lang, pc.binary_join_element_wise(*some, " "), "\n")
            yield pa.RecordBatch.from_arrays([key, pa.array(n[low : low + len(key)], pa.int64())], names=["key", "f"])


@contextlib.contextmanager
def _single_rows(spark):
    """Chunks go to Python one at a time, whatever number of rows the session sends at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _frequent(parts: DataFrame, n: int, least: int) -> DataFrame:
    """The stream (lang, w1.., f) of the counts by key that add up to ``least``; a key is the language, a line end and the words."""
    often = parts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrase = F.substring_index("key", "\n", -1)  # words hold no line ends
    lang = F.substring(F.col("key"), F.lit(1), F.char_length("key") - F.char_length(phrase) - 1)
    words = [F.split(phrase, " ")[k].alias(f"w{k + 1}") for k in range(n)]
    with _single_rows(parts.sparkSession):
        return stored(often.select(lang.alias("lang"), *words, "f"))


def count_phrases(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams (lang, w1, f), (lang, w1, w2, f), (lang, w1, w2, w3, f) of all phrases found ``least`` times or more."""
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    ones = _frequent(each.select(F.concat_ws("\n", "lang", "x.words").alias("key"), F.col("x.counts").alias("f")), 1, least)
    keyed = chunks.select("lang", "words", F.transform("words", lambda w: _word_key(F.col("lang"), w)).alias("keys"), "codes")
    share = chunks.sparkSession.sparkContext.broadcast
    word_bits = share(Bitmap(ones.select(_word_key(F.col("lang"), F.col("w1")).alias("key"))))
    twos = _frequent(map_batches(keyed, lambda: _Phrases(word_bits.value, None), "key string, f long"), 2, least)
    key = _pair_key(_word_key(F.col("lang"), F.col("w1")), _word_key(F.col("lang"), F.col("w2")))
    pair_bits = share(Bitmap(twos.select(key.alias("key"))))
    threes = _frequent(map_batches(keyed, lambda: _Phrases(word_bits.value, pair_bits.value), "key string, f long"), 3, least)
    return ones, twos, threes


def _merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Lockstep join of two streams that are sorted by the keys."""
    return left.join(right.hint("merge"), ["lang", *keys], how)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact in 38 digits; at most 1000000, since neither part is rarer than the whole."""
    wide = lambda c: c.cast("decimal(38,0)")
    top, low = F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a), wide(left) * wide(right)
    return F.call_function("div", top, low)


@tidy_shuffles
def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score): every phrase of two or three words that stays, unranked.

    ``cover``: phrases go whose count is covered to this percentage by a longer candidate.
    """
    chunks = code_texts(docs, text, lang)
    ones, twos, threes = count_phrases(chunks, least)
    total = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    # prefix order: the word before its pairs, the pair before its triples
    twos = _merge(twos.withColumnRenamed("f", "a"), ones.select("lang", "w1", F.col("f").alias("l")), ["w1"])
    right = threes.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer_right"))
    twos = _merge(twos, right, ["w1", "w2"], "left")
    # suffix order: the last word first
    twos = _merge(twos, ones.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r")), ["w2"])
    left = threes.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("longer_left"))
    twos = stored(_merge(twos, left, ["w2", "w1"], "left"))
    threes = _merge(threes.withColumnRenamed("f", "a"), twos.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2")), ["w1", "w2"])
    threes = _merge(threes, twos.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2")), ["w3", "w2"])

    longer = F.greatest(F.coalesce("longer_right", F.lit(0)), F.coalesce("longer_left", F.lit(0)))
    pairs = twos.where(100 * longer < cover * F.col("a")).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    cuts = threes.withColumns({f"s{k}": _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2)})
    later = F.col("s2") < F.col("s1")
    triples = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        *[F.when(later, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(name) for c, name in (("l", "l"), ("r", "r"), ("s", "score"))])
    # one row a language
    return pairs.unionByName(triples).join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, with their rank from 1."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = found.withColumn("part", part).withColumn("rank", first).where(F.col("rank") <= top).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cuts.c], ' ') AND x.k = cuts.c
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cuts.c+1:cuts.k], ' ') AND y.k = cuts.k - cuts.c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, c) = 1),
longer AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3),
covered AS (SELECT lang, phrase, max(a) AS m FROM longer GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN n USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE best.k = 2 AND v.lang = best.lang AND v.phrase = best.phrase AND 100 * v.m >= 50 * best.a)
QUALIFY rank <= 2000
"""
