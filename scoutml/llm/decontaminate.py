"""Operator 12: benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``WINDOW`` words (one shorter window if it has
fewer); a window's set is its shingles of ``SHINGLE`` words (of its own length,
if shorter).  A text that holds a window holds all of its shingles, so the
necessary prefix is one shingle: shingles are ordered by how rarely they occur
in the documents, over all of them, and each window is looked for by its rarest
alone; windows whose rarest shingle occurs nowhere are done.  An occurrence of a
prefix shingle at a place fixes where the window would start; starts that fall
before or behind the text fail by position and length, and the words from there
on are compared whole with the window.

Documents are cut to words once and written to the shared folder with a row
number; the two passes over them shuffle no text, since windows and shingles are
broadcast in blocks of at most about ``BLOCK`` rows, one pass a block.  A passage that stands
in all documents is one row for each document and window.

Edge cases: a null text or one without words has 0 words, no hits and the digest
of no items; items that are null or without words are no windows; items under
one id are one item, items without id mark words but are not counted; repeated
rows are judged each; texts of any length are read whole; an empty table, of
documents or of items, gives no hits; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import stored

WINDOW, SHINGLE = 10, 5
#: rows that are broadcast at once
BLOCK = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: a character that lower() may change, besides A-Z
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}\x{10000}-\x{10FFFF}&&[^A-Z]]"


def plain_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space between them."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~F.rlike(text, F.lit(_OTHER_UPPER))
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _split(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(hashes: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(hashes), at + k) for k in range(size)])


def _blocks(rows: DataFrame, key: str) -> list[DataFrame]:
    """``rows`` in parts of about BLOCK rows, by a hash of the key, marked for broadcast."""
    n = -(-rows.count() // BLOCK)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(max(n, 1)))
    return [F.broadcast(rows.where(part == k)) for k in range(n)]


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, window, size) and their items (wid, item), written to the shared folder."""
    words = items.select(F.col(item).cast("string").alias("item"), _split(plain_words(F.col(text))).alias("w")).where(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))).alias("s"))
    found = stored(starts.select("item", F.array_join(F.slice("w", F.col("s"), WINDOW), " ").alias("window")).distinct())
    windows = stored(found.select("window").distinct().select(
        F.monotonically_increasing_id().alias("wid"), "window", F.size(F.split("window", " ")).alias("size")))
    return windows, stored(found.where("item is not null").join(windows.select("wid", "window"), "window").select("wid", "item"))


def _shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(wid, size, n, code, offset): the shingles of ``n`` words of each window."""
    words = windows.select("wid", "size", F.split("window", " ").alias("w"))
    h = words.select("wid", "size", _hashes("w").alias("h"))
    parts = []
    for n in sizes:
        fit = F.col("size") >= SHINGLE if n == SHINGLE else F.col("size") == n
        each = h.where(fit).select("wid", "size", "h", F.explode(F.sequence(F.lit(0), F.col("size") - n)).alias("offset"))
        parts.append(each.select("wid", "size", F.lit(n).alias("n"), _shingle("h", F.col("offset"), n).alias("code"), "offset"))
    return _all(parts)


def _places(texts: DataFrame, n: int, *more: str) -> DataFrame:
    """Every place (row, i, code, *more) of a shingle of ``n`` words."""
    words = texts.where(F.col("n_words") >= n).select("row", "n_words", F.split("words", " ").alias("w"))
    each = words.select("row", "n_words", "w", _hashes("w").alias("h"))
    each = each.select("row", "n_words", "w", "h", F.explode(F.sequence(F.lit(0), F.col("n_words") - n)).alias("i"))
    return each.select("row", "i", _shingle("h", F.col("i"), n).alias("code"), *more)


def rarest_shingles(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(wid, window, size, n, code, offset): each window's rarest shingle, for windows whose shingles all occur."""
    shingles = stored(_shingles(windows, sizes))
    counts = []
    for n in sizes:
        for block in _blocks(shingles.where(F.col("n") == n).select("code").distinct(), "code"):
            counts.append(_places(texts, n).join(block, "code").groupBy("code").agg(F.count(F.lit(1)).alias("found")).withColumn("n", F.lit(n)))
    # a window with a shingle that occurs nowhere has that one as its rarest, and occurs nowhere itself
    ranked = shingles.join(_all(counts), ["n", "code"], "left").select(
        "wid", F.struct(F.coalesce("found", F.lit(0)).alias("found"), "code", "offset", "n").alias("rank"))
    first = ranked.groupBy("wid").agg(F.min("rank").alias("rank")).where(F.col("rank.found") > 0)
    return stored(first.join(windows, "wid").select("wid", "window", "size", "rank.n", "rank.code", "rank.offset"))


def find_windows(texts: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame | None:
    """(row, start, size, wid): every occurrence of a window in ``texts``; None if none can be."""
    parts = []
    for n in sizes:
        for block in _blocks(prefixes.where(F.col("n") == n), "window"):
            ways = block.groupBy("code").agg(F.collect_set(F.struct("offset", "size")).alias("ways"))
            near = _places(texts, n, "n_words", "w").join(F.broadcast(ways), "code")
            near = near.select("row", "n_words", "w", "code", "i", F.explode("ways").alias("way"))
            start, size = F.col("i") - F.col("way.offset"), F.col("way.size")
            near = near.where((start >= 0) & (start + size <= F.col("n_words"))).select(
                "row", start.alias("start"), "code", F.col("way.offset").alias("offset"), F.array_join(F.slice("w", start + 1, size), " ").alias("window"))
            same = block.select("wid", "window", "size", "code", "offset")
            parts.append(near.join(F.broadcast(same), ["window", "code", "offset"]).select("row", "start", "size", "wid"))
    return _all(parts) if parts else None


def _covered(spans: Column) -> Column:
    """Places in ascending spans (start, size), each counted once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contaminated_words(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, spans, n_hit, items): per document its windows' places (start, size), the words they cover and the items they are from."""
    words = plain_words(F.coalesce(F.col(text), F.lit("")))
    texts = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words")).select(
        "row", "key", "words", F.size(_split(F.col("words"))).alias("n_words")))
    windows, owners = item_windows(items, text="text")
    sizes = sorted({min(r[0], SHINGLE) for r in windows.select("size").distinct().collect()})  # at most WINDOW rows
    prefixes = rarest_shingles(texts, windows, sizes) if sizes else None
    found = find_windows(texts, prefixes, sizes) if sizes else None
    each = texts.select("row", "key", "n_words")
    spans, names = "array<struct<start:int,size:int>>", "array<string>"
    if found is None:
        each = each.withColumns({"spans": F.array().cast(spans), "items": F.array().cast(names)})
    else:
        found = stored(found)
        places = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
        held = found.select("row", "wid").distinct()
        blocks = _blocks(owners, "item")
        of = _all([held.join(block, "wid").select("row", "item") for block in blocks]) if blocks else None
        each = each.join(places, "row", "left")
        if of is None:
            each = each.withColumn("items", F.lit(None).cast(names))
        else:
            each = each.join(of.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")), "row", "left")
        each = each.withColumns({"spans": F.coalesce("spans", F.array().cast(spans)), "items": F.coalesce("items", F.array().cast(names))})
    return each.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "spans", _covered(F.col("spans")).cast("long").alias("n_hit"), "items")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest([array_to_string(w[k:k+9], ' ') FOR k IN range(1, greatest(len(w) - 9, 1) + 1)]) AS window
  FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, size, unnest(range(1, len(w) - size + 2)) AS s, unnest([array_to_string(w[k:k+size-1], ' ') FOR k IN range(1, len(w) - size + 2)]) AS window
  FROM d, sizes WHERE len(w) >= size),
found AS (SELECT p.row, p.s, p.size, v.item_id FROM places p JOIN windows v ON v.window = p.window AND v.size = p.size),
hits AS (SELECT row, count(DISTINCT x) AS n FROM (SELECT row, unnest(range(s, s + size)) AS x FROM (SELECT DISTINCT row, s, size FROM found)) GROUP BY row),
ids AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN ids USING (row)
"""
