"""Operator 3: exact n-gram Jaccard join by prefix filters under several token orders.

Sets of equal shingles are one class.  If two sets have a Jaccard similarity of
t or more, then under every common order of the tokens their prefixes (the first
n - ceil(t n) + 1 tokens) share one.

* Order 1 puts frequent tokens last: the ``FREQUENT`` tokens that are counted
  most (a bounded list; it changes only the order, so never the result), then by
  hash.  Passages that many documents share thus drop
  out of the prefixes of all documents that have enough words of their own.
* Classes that share a prefix token of order 1 are candidates.  Lists of one
  token are not expanded into pairs: a list is compared with one pivot of its
  own, the classes that are found linked become one component, and lists whose
  classes are in one component are done.  The first pivot is the class with the
  smallest share of rare tokens (an original among its edited copies).  Each
  further round draws ``MORE`` times more pivots for the lists that are still
  mixed and compares them with the list's classes of other components, if sizes
  and the places of the shared token leave room for the threshold (the first
  shared token of two similar sets always does).  A list no longer than its
  number of pivots is thereby compared in full and done, so the rounds end and no
  link between components is lost.
* A pair must also share a prefix token under orders 2 and 3 (other hash
  orders); only pairs that pass all filters are verified on their whole sets.

Postings travel as one row a part, a part being a stretch of tokens and a salt.
Lists of frequent tokens are split by a salt: in the first round with a pivot for
each part and a pivot of pivots, later with the pivots copied to every part.  Codes are 64-bit hashes of whole shingles; classes are told
apart by a 64-bit code, checked by a second one (a clash raises).

A row is found again by its seat, a hash of its id and text, so ids may be null
or stand for several texts.

Edge cases: a null, empty or blank text has no shingles and is linked with
nothing; equal texts, and rows that repeat, are one class; a null id is a value of
its own, after all others, so a component's id is null only if all its ids are; an
id that stands for several texts is in the component of each; a text of any length
is read whole; an empty table gives no rows; other columns are ignored by the
join and kept by ``one_of_each``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoutml.llm.common import keyed_text, map_batches, packed, stored, tidy_shuffles
from scoutml.llm.components import connected_components
from scoutml.llm.shingles import Flat, mix, shingle_sets, shingle_slices
from scoutml.session import shuffle_partitions

#: linked if PERCENT * union <= 100 * intersection
PERCENT = 80
#: tokens put last in order 1, and the least number of prefixes they stand in
FREQUENT, LEAST_LIST = 200_000, 3
SALTS = 16
#: counts from here on are one when the most frequent tokens are looked for
MANY = 10_000
#: bits of a token in a list, fewer than a hash has, so that lists take less room; tokens that
#: fall together only bring candidates; the first ones name the part that a token is sent to,
#: the others (32 at most) travel with each posting
TOKEN_BITS, PART_BITS = 44, 12
#: postings that a task gathers before it sends them by part
GATHERED = 1 << 18
#: places from here on are one: a smaller place only brings candidates
FAR_PLACE = 32_767
#: how many times more pivots a list gets in each further round
MORE = 64


def prefix_length(n):
    """Also of an array."""
    return n - -(-PERCENT * n // 100) + 1


def _long(values) -> pa.Array:
    return pa.array(values, type=pa.int64())


def _unpacked(packed: bytes) -> str:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass")


def _slices(batch: pa.RecordBatch):
    for low, sets in shingle_slices(batch.column(1).to_pylist()):
        yield low, sets, Flat(sets)


def _seat(key: str = "doc_id", text: str = "text"):
    """64 bits of a row's id and text; a null id leaves those of the text."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def _per_document(rows: DataFrame) -> DataFrame:
    """(doc_id, seat, n, code, code2) of each row."""

    def step(batch: pa.RecordBatch):
        for low, sets, flat in _slices(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(low, len(sets)) for i in (0, 2)] + [_long(flat.size), _long(flat.keys(5)), _long(flat.keys(7))],
                names=["doc_id", "seat", "n", "code", "code2"],
            )

    return map_batches(rows.withColumn("seat", _seat()), lambda: step, "doc_id long, seat long, n long, code long, code2 long")


def _short(code: np.ndarray) -> np.ndarray:
    """32 bits of a token, enough for a list that only changes the order."""
    return (code >> np.uint64(7)).astype(np.uint32).view(np.int32)


def _frequent_tokens(rows: DataFrame) -> np.ndarray:
    """The most frequent tokens (32 bits of them), bounded and sorted.

    Counted are the prefixes of the plain order, and beyond them what stands in
    several sets of one batch: once frequent tokens are put last, the prefix
    reaches further into a set.
    """

    def step(batch: pa.RecordBatch):
        heads, tails = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for _, _, f in _slices(batch):
            head = f.rank < prefix_length(f.size)[f.of]
            heads.append(_short(f.code[head]))
            tails.append(_short(f.code[~head]))
        token, count = np.unique(np.concatenate(heads), return_counts=True)
        other, more = np.unique(np.concatenate(tails), return_counts=True)
        token, count = np.concatenate([token, other[more > 1]]), np.concatenate([count, more[more > 1]])
        yield pa.RecordBatch.from_arrays([pa.array(token), _long(count)], names=["token", "c"])

    counts = map_batches(rows, lambda: step, "token int, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counts = stored(counts.where(F.col("c") >= LEAST_LIST))
    # how many tokens have each count, up to a bound in which all high counts are one; tokens of the last count that
    # still has room are taken from one stretch of their values, as many as fit if they lie evenly
    capped = F.least(F.col("c"), F.lit(MANY))
    spread = sorted(((r.c, r.k) for r in counts.groupBy(capped.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    room, take = FREQUENT, F.lit(False)
    for c, k in spread:  # at most MANY rows
        share = min(1.0, room / k)
        end = -(2**31) + int(share * 2**32)
        take = (capped > c) | ((capped == c) & (F.col("token") < end))
        room -= k
        if room <= 0:
            break
    return np.sort(counts.where(take).select("token").toArrow().column("token").to_numpy().astype(np.int32))


class _ByPart:
    """Gathers the postings of a task up to GATHERED and gives them back as one row a part, which takes less room than a row a posting."""

    def __init__(self, often: np.ndarray):
        self.often = often
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def __call__(self, batch: pa.RecordBatch):
        for _, _, f in _slices(batch):
            self.parts.append(self.prefixes(f))
            self.size += len(self.parts[-1][0])
            if self.size >= GATHERED:
                yield from self.finish()

    def prefixes(self, f: Flat) -> tuple[np.ndarray, ...]:
        key = f.keys(5)
        once = np.zeros(len(key), bool)
        once[np.unique(key, return_index=True)[1]] = True
        last = np.zeros(len(f.code), bool)
        if len(self.often):
            short = _short(f.code)
            last = self.often[np.minimum(np.searchsorted(self.often, short), len(self.often) - 1)] == short
        behind = np.cumsum(last) - last  # frequent tokens before, over all sets
        behind = behind - behind[np.minimum(f.first, max(len(behind) - 1, 0))][f.of] if len(behind) else behind
        own = f.size - f.sums(last.astype(np.int64))
        place = np.where(last, own[f.of] + behind, f.rank - behind)
        chosen = (place < prefix_length(f.size)[f.of]) & once[f.of]
        of = f.of[chosen]
        salt = np.where(last[chosen], 1 + key[of] % SALTS, 0)
        token = f.code[chosen] >> np.uint64(64 - TOKEN_BITS)
        part = (token >> np.uint64(TOKEN_BITS - PART_BITS)).astype(np.int32) * (SALTS + 1) + salt
        tail = (token & np.uint64((1 << (TOKEN_BITS - PART_BITS)) - 1)).astype(np.uint32).view(np.int32)
        return part.astype(np.int32), tail, np.minimum(place[chosen], FAR_PLACE).astype(np.int16), key[of]

    def finish(self):
        if self.size:
            part, *columns = (np.concatenate(c) for c in zip(*self.parts))
            self.parts, self.size = [], 0
            order = np.argsort(part, kind="stable")
            of, first = np.unique(part[order], return_index=True)
            ends = pa.array(np.append(first, len(part)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(of), *lists], names=["part", "tail", "pos", "key"])


def _postings(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(part, tail, pos, key) of the prefixes under order 1, once for each class and slice, dealt by part.

    ``part`` holds the first bits of the token and the salt, ``tail`` the token's other bits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    sent = map_batches(rows, lambda: _ByPart(shared.value), "part int, tail array<int>, pos array<smallint>, key array<bigint>")
    return sent.repartition("part").select("part", F.inline(F.arrays_zip("tail", "pos", "key")))


def _lists(posts: DataFrame) -> DataFrame:
    """(token, salt, key, pos) of tokens that stand in several classes; lists that are split by a salt are all kept.

    Everything is grouped by ``part`` first, so the postings are shuffled once.
    """
    salt = F.pmod("part", F.lit(SALTS + 1))
    one = W.partitionBy("part", "tail")
    ends = posts.withColumns({"low": F.min("key").over(one), "high": F.max("key").over(one)}).where((F.col("low") < F.col("high")) | (salt > 0))
    # of tokens of one set that fall together the first place is kept
    lists = ends.groupBy("part", "tail", "key").agg(F.min("pos").cast("long").alias("pos"))
    head = F.shiftleft(F.floor(F.col("part") / (SALTS + 1)).cast("long"), TOKEN_BITS - PART_BITS)
    tail = F.col("tail").cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    return lists.select((head + tail).alias("token"), salt.cast("int").alias("salt"), "key", "pos")


def _candidate_sets(rows: DataFrame, wanted: DataFrame) -> str:
    """Name of a table (seat, key, packed) of the wanted classes (seat of one member, key), from the whole texts again.

    Texts travel packed to the partition of their seat; repeated rows are taken
    once.  The table is bucketed by that seat in the shared warehouse, so that no
    later join moves it again.  It holds the packed texts, a quarter of the size
    of their sets.
    """

    def pack(batch: pa.RecordBatch):
        once = pa.array(np.sort(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))  # of rows that repeat in a batch
        seats, texts = batch.column(0).take(once), batch.column(1).take(once)
        small = pa.array([zstandard.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([seats, small], names=["seat", "packed"])

    def step(batch: pa.RecordBatch):
        for low, sets in shingle_slices([_unpacked(t) for t in batch.column(0).to_pylist()]):
            packed, wanted, seat = (batch.column(i).slice(low, len(sets)) for i in range(3))
            yield pa.RecordBatch.from_arrays([_long(Flat(sets).keys(5)), wanted, seat, packed], names=["key", "wanted", "seat", "packed"])

    sent = map_batches(rows.select(_seat().alias("seat"), "text"), lambda: pack, "seat long, packed binary")
    found = sent.join(wanted.select("seat", F.col("key").alias("wanted")), "seat")
    first = W.partitionBy("seat", "h").orderBy("wanted")
    found = found.withColumn("h", F.xxhash64("packed")).withColumn("r", F.row_number().over(first)).where("r = 1")
    made = map_batches(found.select("packed", "wanted", "seat"), lambda: step, "key long, wanted long, seat long, packed binary")
    name = f"shingle_sets_{uuid.uuid4().hex}"
    good = made.where("key = wanted").select("seat", "key", "packed")
    good.write.bucketBy(shuffle_partitions(rows.sparkSession), "seat").saveAsTable(name, format="parquet")
    return name


def _verified(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of ``pairs`` that pass the filters of orders 2 and 3 and are similar."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        for order in (2, 3):
            heads = []
            for s in (x, y):
                p = prefix_length(len(s))
                h = mix(s, 100 + order)
                heads.append(np.partition(h, p - 1)[:p])
            if not len(np.intersect1d(*heads)):
                return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= PERCENT * (len(x) + len(y) - both)

    def step(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            texts = list(dict.fromkeys(x + y))
            found = dict(zip(texts, shingle_sets([_unpacked(t) for t in texts])))
            good = np.array([linked(found[s], found[t]) for s, t in zip(x, y)], dtype=bool)
            yield pa.RecordBatch.from_arrays([_long(a[good]), _long(b[good])], names=["a", "b"])

    side = lambda i, t: sets.select(F.col("seat").alias(i), F.col("packed").alias(t))
    ids = lambda k, i: classes.select(F.col("key").alias(k), F.col("seat").alias(i))
    named = pairs.join(ids("a", "ia"), "a").join(ids("b", "ib"), "b")
    both = named.join(side("ia", "ta"), "ia").join(side("ib", "tb"), "ib")
    return map_batches(both.select("a", "b", "ta", "tb"), lambda: step, "a long, b long")


def _alike(x: str, y: str):
    """Sizes near enough, and enough tokens from the shared one on: the first shared token of similar sets passes."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * rest >= PERCENT * (n + m))


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("x.key"), F.col("y.key")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _mixed(state: DataFrame, comps: DataFrame, done: int) -> DataFrame:
    """The lists of ``state`` that now hold several components and are longer than ``done``, with their length (all).

    Components only grow, so a list that goes here is done for good and later rounds need not read it.
    """
    now = state.select("token", "salt", "key", "n", "pos").join(comps.withColumnRenamed("node", "key"), "key")
    of = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("all"))
    return now.join(of.where((F.col("low") < F.col("high")) & (F.col("all") > done)).select("token", "all"), "token")


def _links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): enough links of classes that their components are those of all links."""
    lists = _lists(_postings(rows, _frequent_tokens(rows)))
    # rows that can have no similar partner in their list, by sizes and places, go
    lists = stored(lists).join(classes.select("key", "n"), "key")
    all_of = W.partitionBy("token")
    rest = F.col("n") - F.col("pos")
    edge = {"c": F.count(F.lit(1)).over(all_of), "n0": F.min("n").over(all_of), "n1": F.max("n").over(all_of),
            "r0": F.min(rest).over(all_of), "r1": F.max(rest).over(all_of)}
    partner = F.greatest(F.col("n0"), F.ceil(F.col("n") * PERCENT / 100))
    some = (100 + PERCENT) * F.least(rest, F.col("r1")) >= PERCENT * (F.col("n") + partner)
    two = (100 * F.col("n0") >= PERCENT * F.col("n1")) & ((100 + PERCENT) * F.col("r0") >= PERCENT * (F.col("n0") + F.col("n1")))
    lists = lists.withColumns(edge).where((F.col("c") > 1) & some & ((F.col("c") > 2) | two))
    lists = stored(lists.select("token", "salt", "key", "n", "pos"))
    wanted = stored(lists.select("key").distinct().join(classes, "key").select("key", "seat"))
    if wanted.groupBy("seat").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different rows have one 64-bit seat")
    name = _candidate_sets(rows, wanted)
    sets = rows.sparkSession.table(name)
    comps = wanted.select(F.col("key").alias("node"), F.col("key").alias("comp"))
    links = tried = None
    pivots = 1  # pivots of a list in this round
    state = lists.withColumn("comp", F.col("key"))
    while not state.isEmpty():
        row = F.struct("key", "n", "pos", "comp")
        if pivots == 1:
            # the class with the fewest rare tokens before the shared one stands nearest to the others of its list
            seat = F.min(F.struct((F.col("pos") / F.col("n")).alias("r"), F.xxhash64("key").alias("h"), row.alias("v")))
            heads = state.groupBy("token", "salt").agg(seat.alias("p"))
            far = state.select("token", "salt", row.alias("x")).join(
                heads.select("token", "salt", F.col("p.v").alias("y")), ["token", "salt"]).where("x.comp <> y.comp")
            top = heads.groupBy("token").agg(F.min("p").alias("q")).select("token", F.col("q.v").alias("y"))
            high = heads.where("salt > 0").select("token", F.col("p.v").alias("x")).join(top, "token").where("x.comp <> y.comp")
            pairs = _pairs(far.where(_alike("x", "y"))).unionByName(_pairs(high.where(_alike("x", "y"))))
            done = 2  # lists up to this length have been compared in full
        else:
            # a class that is drawn is a pivot in all its lists that are long enough for the draw
            draw = F.pmod(F.xxhash64("key", F.lit(pivots)), F.lit(1 << 30))
            state = state.withColumn("pivot", (F.col("all") <= pivots) | (draw * F.col("all") < pivots * (1 << 30)))
            parts = F.when(F.col("salt") > 0, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
            x = state.select("token", "salt", "pivot", row.alias("x"))
            y = state.where("pivot").select("token", F.explode(parts).alias("salt"), row.alias("y"))
            once = F.expr("x.comp <> y.comp and (not pivot or x.key < y.key)")
            pairs = _pairs(x.join(y, ["token", "salt"]).where(once & _alike("x", "y")))
            done = pivots
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _verified(pairs, sets, classes)
        links = stored(found if links is None else links.unionByName(found))
        comps = wanted.select(F.col("key").alias("node")).join(connected_components(links), "node", "left")
        comps = stored(comps.select("node", F.coalesce("comp", "node").alias("comp")))
        pivots *= MORE
        state = stored(_mixed(state, comps, done))
    rows.sparkSession.sql(f"DROP TABLE {name}")
    return comps


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row (doc_id, seat, n, code, code2), and each class (key, size, comp, first): first has the least (none, doc_id, seat) of it."""
    each = stored(_per_document(rows))
    full = each.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "seat"))
    classes = full.groupBy(F.col("code").alias("key")).agg(
        least.alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min("code2").alias("x"), F.max("code2").alias("y"))
    classes = stored(classes.withColumn("seat", F.col("first.seat")))
    if classes.where("x <> y").limit(1).count():
        raise RuntimeError("two different shingle sets have one 64-bit code")
    comps = _links(rows, classes)
    named = classes.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    return each, named.select("key", "size", "comp", "first")


@tidy_shuffles
def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    each, classes = _classes(keyed_text(docs, key, text))
    lowest = classes.groupBy("comp").agg(F.min("first").alias("low"))
    named = stored(classes.join(lowest, "comp").select("key", "size", F.col("low.doc_id").alias("component_id")))
    # Classes with a thousandth of all rows number at most 1,000: these are joined by broadcast, the rest by their key.
    total = each.count()
    big = named.where(F.col("size") * 1000 >= total).select("key", F.col("component_id").alias("big_id"), F.lit(True).alias("big"))
    rest = named.where(F.col("size") * 1000 < total).select("key", "component_id")
    seen = each.withColumn("key", F.when(F.col("n") > 0, F.col("code"))).join(F.broadcast(big), "key", "left")
    hot = seen.where("big").select("doc_id", "n", F.col("big_id").alias("component_id"))
    none = seen.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    cold = seen.where((F.col("n") > 0) & F.col("big").isNull()).join(rest, "key").select("doc_id", "n", "component_id")
    out = hot.unionByName(none).unionByName(cold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


@tidy_shuffles
def _survivors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, seat) of the first row of each component, and of each text without shingles."""
    each, classes = _classes(keyed_text(docs, key, text))
    first = classes.groupBy("comp").agg(F.min("first").alias("low")).select("low.doc_id", "low.seat")
    return first.unionByName(each.where("n = 0").select("doc_id", "seat").distinct())


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the smallest id (null last), and every row without shingles; repeated rows
    (equal id and text) once; all columns are kept."""
    keep = _survivors(docs, key, text).select(F.col("doc_id").alias("__keep"), F.col("seat").alias("__seat"))
    rows = packed(docs).withColumn("__seat", _seat(f"__row.{key}", f"__row.{text}"))
    stay = rows.join(keep, "__seat").where(F.col(f"__row.{key}").eqNullSafe(F.col("__keep")))
    return stay.dropDuplicates(["__seat"]).select("__row.*")
