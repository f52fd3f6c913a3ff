"""Operator 8: quality rules with robust multivariate outliers, with DataFrame functions only.

Every text gets counts (words, word characters, symbols, repeated lines, words
in repeated five-word windows) and a vector of transformed rates.  For each
(language, source) the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps: from the marginal medians and absolute
deviations, take the ``SUPPORT`` share of rows that lie nearest, estimate centre
and scatter from them, and again ``STEPS`` times.  Rows whose squared Mahalanobis
distance from their group's estimate passes ``CUTOFF`` are rejected, as are those
that fail the base rules.

A group has an estimate of its own if it holds at least ``MIN_ROWS`` rows that
pass the base rules, however large the table is; rows of smaller groups take
their language's estimate by the same rule, and else that of all rows.  Groups
with one in ``HOT`` of the rows (at most ``HOT`` a level) are joined by
broadcast, the rates of the others by a shuffle on the group.  ``keep_good``
judges texts of hot groups where they lie; of the others it drops those whose
group and rates were rejected, by a join that leaves the texts in place as long
as Spark broadcasts the rejected rates, and else moves them once.  Rates are
whole numbers (thousandths) and their sums decimals, medians and the support's bound are taken
over whole numbers of small range (exact, and a group's state is bounded): the
result does not depend on partitions or their order.  ``FLOOR`` is added to the
scatter's diagonal, since a rate may be 0 nearly everywhere.

Edge cases: a null or empty text has no words and fails; null language or source
are values of their own; a text of any length is read whole; repeated rows are
judged each; empty tables give no rows; other columns are ignored by the query
and kept by ``keep_good``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import packed, stored
from scoutml.session import cut

WINDOW = 5
#: transformed statistics, in thousandths
RATES = ("r_length", "r_symbols", "r_lines", "r_repeats", "r_capitals")
#: words of five characters added to a text's own for its mean word length, which is noise in short texts
SHRINK = 20
#: least standard deviation of each, in thousandths
FLOOR = (80.0, 60.0, 110.0, 160.0, 90.0)
SUPPORT, STEPS, CUTOFF = 0.75, 3, 25.0
MIN_ROWS = 100
#: groups with one row in so many are joined by broadcast
HOT = 1000
_BINS_PER_OCTAVE = 32


def let(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that stand in a five-word window found twice or more in the array, first ones included."""

    def covered(windows: Column) -> Column:
        def flags(s: Column) -> Column:
            return F.transform(
                s,
                lambda x, i: F.when(
                    F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]), x["i"]
                ),
            )

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(F.array_sort(F.filter(let(ordered, flags), lambda i: i.isNotNull())), spread)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), count))


def text_counts(text: Column) -> Column:
    """Struct of the counts of a text."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))
    return F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def with_counts(docs: DataFrame, text: str = "text", out: str = "__q") -> DataFrame:
    """``docs`` with a struct of counts, base verdict, rates and group keys."""
    raw = docs.withColumn(out, text_counts(F.col(text)))
    c = lambda n: F.col(f"{out}.{n}")
    n, chars = F.greatest(c("w.n_words"), F.lit(1)), F.greatest(c("w.word_chars"), F.lit(1))
    mille = lambda x: F.round(x * 1000).cast("long")
    rates = (
        F.log((chars + 5 * SHRINK) / (n + SHRINK)), F.sqrt(c("n_symbols") / chars), F.sqrt(c("l.n_dup_lines") / F.greatest(c("l.n_lines"), F.lit(1))),
        F.sqrt(c("w.n_repeat_words") / n), F.sqrt(c("n_capitals") / chars),
    )
    failed = (c("w.n_words") < 10) | (100 * c("w.n_repeat_words") > 20 * c("w.n_words"))
    return raw.withColumn(out, F.struct(
        c("w.n_words").alias("n_words"), c("w.word_chars").alias("word_chars"), c("n_symbols").alias("n_symbols"),
        c("l.n_dup_lines").alias("n_dup_lines"), c("w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
        *[mille(r).alias(name) for name, r in zip(RATES, rates)],
    ))


def _group(col: Column) -> Column:
    """A null is a value of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def _solve(rates: list[Column], centre: list[Column], scatter: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by an unrolled Cholesky factor; the factor is in ``scatter``."""
    y: list[Column] = []
    for i in range(len(rates)):
        rest = functools.reduce(lambda a, j: a - scatter[i, j] * y[j], range(i), rates[i] - centre[i])
        y.append(rest / scatter[i, i])
    return functools.reduce(lambda a, b: a + b, [v * v for v in y])


def _factor(est: DataFrame) -> DataFrame:
    """Columns L_i_j of the Cholesky factor of C_i_j, one column at a time."""
    d = len(RATES)
    for j in range(d):
        diagonal = functools.reduce(lambda a, k: a - F.col(f"L_{j}_{k}") * F.col(f"L_{j}_{k}"), range(j), F.col(f"C_{j}_{j}"))
        est = est.withColumn(f"L_{j}_{j}", F.sqrt(F.greatest(diagonal, F.lit(FLOOR[j] ** 2 * 1e-3))))
        below = {
            f"L_{i}_{j}": functools.reduce(
                lambda a, k, i=i: a - F.col(f"L_{i}_{k}") * F.col(f"L_{j}_{k}"), range(j), F.col(f"C_{i}_{j}")
            ) / F.col(f"L_{j}_{j}")
            for i in range(j + 1, d)
        }
        est = est.withColumns(below) if below else est
    return est.select("grp", "hot", *[f"m_{i}" for i in range(d)], *[f"L_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _distance(est: str = "__e", rates: list[Column] | None = None) -> Column:
    d = len(RATES)
    rates = rates or [F.col(r) for r in RATES]
    return _solve(
        [r.cast("double") for r in rates], [F.col(f"{est}.m_{i}") for i in range(d)],
        {(i, j): F.col(f"{est}.L_{i}_{j}") for i in range(d) for j in range(i + 1)},
    )


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.lit(1.0) + distance) * _BINS_PER_OCTAVE).cast("int")


def _large(sizes: DataFrame, total: int) -> DataFrame:
    """``sizes`` with a flag ``hot`` for its count ``n``."""
    return sizes.withColumn("hot", F.col("n") * HOT >= total).drop("n")


def _tag(rows: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the flag ``hot`` of their keys in ``side``."""
    hot = F.broadcast(side.where("hot").select(*keys, "hot"))
    return rows.join(hot, list(keys), "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def _any_cold(side: DataFrame) -> bool:
    return not side.where(~F.col("hot")).isEmpty()


def _meet(rows: DataFrame, side: DataFrame, *keys: str, cold: bool = True) -> DataFrame:
    """Inner join on the keys, unique in ``side``; both have ``hot``: those by broadcast, the others (``cold``: there are any) by a shuffle."""
    on = [*keys, "hot"]
    hot = rows.where("hot").join(F.broadcast(side.where("hot")), on)
    return hot if not cold else hot.unionByName(rows.where(~F.col("hot")).join(side.where(~F.col("hot")), on))


def fit(counted: DataFrame, lang: str = "lang", source: str = "source", counts: str = "__q") -> DataFrame:
    """Estimates (grp, hot, m_i, L_i_j) of all groups large enough, written to the shared folder."""
    d = len(RATES)
    stats = counted.where(~F.col(f"{counts}.base_failed")).select(
        _group(F.col(lang)).alias("lang"), _group(F.col(source)).alias("source"), *[F.col(f"{counts}.{r}").alias(r) for r in RATES]
    )
    stats = cut(stats)
    levels = F.array(F.lit("*"), F.concat(F.lit("l"), "lang"), F.concat(F.lit("s"), "lang", F.lit("|"), "source"))
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("n", F.explode(levels).alias("grp")).groupBy("grp").agg(F.sum("n").alias("n"))
    large = cut(_large(sizes.where((F.col("grp") == "*") | (F.col("n") >= MIN_ROWS)), stats.count()))
    each = stats.select(*RATES, F.explode(levels).alias("grp"))
    rows = each.join(F.broadcast(large.where("hot").select("grp")), "grp").withColumn("hot", F.lit(True))
    cold = _any_cold(large)
    if cold:
        others = cut(_meet(_tag(each, large, "grp").where(~F.col("hot")), large, "grp").drop("hot"))
        rows = rows.unionByName(others.withColumn("hot", F.lit(False)))
    medians = rows.groupBy("grp", "hot").agg(*[F.percentile(r, 0.5).alias(f"m_{i}") for i, r in enumerate(RATES)])
    spread = _meet(rows, medians, "grp", cold=cold).groupBy("grp", "hot").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(d)],
        *[(F.percentile(F.round(F.abs(F.col(r) - F.col(f"m_{i}"))).cast("long"), 0.5) * 1.4826).alias(f"s_{i}") for i, r in enumerate(RATES)],
    )
    start = {f"C_{i}_{j}": (F.col(f"s_{i}") * F.col(f"s_{i}") + FLOOR[i] ** 2 if i == j else F.lit(0.0)) for i in range(d) for j in range(i + 1)}
    est = cut(_factor(spread.withColumns(start)))
    for _ in range(STEPS):
        est = cut(_concentrate(rows, est, cold))
    return est


def _numbers(est: DataFrame) -> Column:
    return F.struct(*[c for c in est.columns if c not in ("grp", "hot")])


def _concentrate(rows: DataFrame, est: DataFrame, cold: bool) -> DataFrame:
    """One step: the nearest rows of each group, their centre and scatter."""
    d = len(RATES)
    near = _meet(rows, est.select("grp", "hot", _numbers(est).alias("__e")), "grp", cold=cold)
    near = near.select("grp", "hot", *RATES, _bin(_distance()).alias("bin"))
    bound = near.groupBy("grp", "hot").agg(F.ceil(F.percentile("bin", SUPPORT)).alias("top"))
    kept = _meet(near, bound, "grp", cold=cold).where(F.col("bin") <= F.col("top"))
    exact = lambda x: F.sum(x.cast("decimal(20,0)"))
    sums = kept.groupBy("grp", "hot").agg(
        F.count(F.lit(1)).alias("n"), *[exact(F.col(r)).alias(f"t_{i}") for i, r in enumerate(RATES)],
        *[exact(F.col(RATES[i]) * F.col(RATES[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    mean = {f"m_{i}": F.col(f"t_{i}").cast("double") / F.col("n") for i in range(d)}
    # the nearest rows alone show too little scatter; the factor makes it that of all rows of a normal law
    wide = 1.0 / 0.65
    scatter = {
        f"C_{i}_{j}": (F.col(f"p_{i}_{j}").cast("double") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * wide
        + (FLOOR[i] ** 2 if i == j else 0.0)
        for i in range(d) for j in range(i + 1)
    }
    return _factor(sums.withColumns(mean).withColumns(scatter))


def _keyed(rows: DataFrame, lang: str, source: str) -> DataFrame:
    return rows.withColumns({"__l": _group(F.col(lang)), "__s": _group(F.col(source))})


def estimates_of(counted: DataFrame, est: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(__l, __s, hot, __e): the estimate that holds for each language and source of ``counted``, failed rows included."""
    pairs = _keyed(counted, lang, source).groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("n"))
    pairs = _large(pairs, counted.count())
    keys = {"__e2": F.concat(F.lit("s"), "__l", F.lit("|"), "__s"), "__e1": F.concat(F.lit("l"), "__l")}
    for name, key in keys.items():
        side = est.select(F.col("grp").alias("__g"), _numbers(est).alias(name))
        pairs = pairs.join(side, key == F.col("__g"), "left").drop("__g")
    pairs = pairs.join(F.broadcast(est.where("grp = '*'").select(_numbers(est).alias("__e0"))), F.lit(True), "left")
    return cut(pairs.select("__l", "__s", "hot", F.coalesce("__e2", "__e1", "__e0").alias("__e")))


def _verdict(rows: DataFrame, out: str = "__q") -> DataFrame:
    distance = _distance("__e", [F.col(f"{out}.{r}") for r in RATES])
    far = F.coalesce(distance > CUTOFF, F.lit(False))
    failed = F.col(f"{out}.base_failed")
    return rows.withColumn(out, F.col(out).withField("distance", distance).withField("kept", ~failed & ~far)).drop("__e")


def judge(counted: DataFrame, pairs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with ``distance`` and ``kept`` added to its struct of counts; ``pairs`` as of ``estimates_of``."""
    keyed, cold = _keyed(counted, lang, source), _any_cold(pairs)
    keyed = _tag(keyed, pairs, "__l", "__s") if cold else keyed.withColumn("hot", F.lit(True))
    return _verdict(_meet(keyed, pairs, "__l", "__s", cold=cold)).drop("__l", "__s", "hot")


def quality(docs: DataFrame) -> DataFrame:
    """One row a document: counts, verdicts and distance.  The texts are read once."""
    counted = cut(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    judged = judge(counted, estimates_of(counted, fit(counted)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judged.select("doc_id", *[F.col(f"__q.{n}").alias(n) for n in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.  The texts are read and counted once, and written with their counts."""
    lang, source = "__row.lang", "__row.source"
    rows = stored(with_counts(packed(docs), text="__row.text"))
    counted = rows.select(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")).alias("__row"), "__q")
    pairs = estimates_of(counted, fit(counted, lang, source), lang, source)
    hot = F.broadcast(pairs.where("hot").drop("hot"))
    good = _verdict(_keyed(rows, lang, source).join(hot, ["__l", "__s"])).where("__q.kept").select("__row.*")
    if not _any_cold(pairs):
        return good
    rates = [F.col(f"__q.{r}").alias(f"__{r}") for r in RATES]
    others = _keyed(rows.where("not __q.base_failed"), lang, source).join(hot, ["__l", "__s"], "left_anti")
    cold = others.select("__l", "__s", "__q").join(pairs.where(~F.col("hot")).drop("hot"), ["__l", "__s"])
    gone = stored(_verdict(cold).where("not __q.kept").select("__l", "__s", *rates).distinct())
    rest = others.withColumns({f"__{r}": F.col(f"__q.{r}") for r in RATES}).join(gone, gone.columns, "left_anti")
    return good.unionByName(rest.select("__row.*"))
