"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows that are not held out (crc32 of the key mod 5 is not 0) are taken
up to ``TRAIN_ROWS`` (a hash sample; all of them where there are fewer) and dealt
by another hash: half teach the lexicon, 3 in 10 the trees, 2 in 10 the
calibration, so neither trees nor calibration see rows the lexicon was made of.
Of sampled rows with the same smallest shingle code (copies) one is used.

* Lexicon: words whose odds in toxic documents are above ``ODDS`` (log) and
  significant (``Z``); those above ``STRONG`` are strong.  At most ``TERMS`` words.
  Uses with the same two neighbour words count once, so a passage that is copied
  does not make its words terms.
* Features of a whole text, found by one Aho-Corasick pass and a byte histogram:
  densities and numbers of strong and mild terms, different strong terms, strong
  terms near a second-person word, shares of capitals, exclamation marks, other
  punctuation and digits, rate of words with symbols or digits inside, and terms
  that appear only once such disguise is undone.
* Spark's boosted trees give a raw probability, an isotonic regression on the
  calibration rows turns it into the score.

Edge cases: null and empty texts have features of 0 and are scored like any;
without labels of both classes the score is the share of toxic rows (0 without
any); labels of one document that differ count as toxic if any does, null labels
are not used; a text of any length is read whole; repeated rows are scored each;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoutml.llm.langid import held_out
from scoutml.llm.shingles import shingle_sets
from scoutml.session import cut

TRAIN_ROWS = 12_000
ODDS, STRONG, Z, TERMS = 2.5, 3.5, 3.4, 400
TREES, DEPTH, STEP = 12, 3, 0.3
NEAR = 40
FEATURES = (
    "strong_density", "strong_log", "strong_kinds", "mild_density", "mild_log", "second_person", "second_person_log",
    "capitals", "exclamations", "punctuation", "digits", "obfuscated", "hidden_log",
)
_WORD = re.compile(r"[^\W\d_]+")
#: second-person words of some languages
_YOU = re.compile(
    r"\b(you|your|yours|yourself|u|ur|ya|tu|te|toi|ton|ta|tes|vous|votre|du|dich|dir|dein|deine|euch|ihr|tú|ti|tus|usted|vosotros)\b", re.I)
_OBFUSCATED = re.compile(r"[^\W\d_][^\W_]*(?:[*@$!#0-9]+[^\W\d_]+)+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "#": None})
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]


class Lexicon:
    """Terms with their tier, and the features of a text."""

    def __init__(self, strong: list[str], mild: list[str]):
        self.tier = {**{w: 1 for w in mild}, **{w: 2 for w in strong}}
        self._automaton = None

    def __getstate__(self):
        return {"tier": self.tier, "_automaton": None}

    def hits(self, low: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of the terms that stand as whole words in a lower-cased text."""
        if not self.tier:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for w in self.tier:
                self._automaton.add_word(w, w)
            self._automaton.make_automaton()
        out = []
        for last, w in self._automaton.iter(low):
            a, b = last - len(w) + 1, last + 1
            if (a == 0 or not low[a - 1].isalpha()) and (b == len(low) or not low[b].isalpha()):
                out.append((a, b, w))
        return out

    def features(self, text: str) -> list[float]:
        low = text.lower()
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        words = max(1, int(raw[32] + raw[10] + raw[9]) + (1 if text else 0))
        chars = max(1, len(text))
        hits = self.hits(low)
        strong = [h for h in hits if self.tier[h[2]] == 2]
        mild = len(hits) - len(strong)
        near = sum(1 for a, b, _ in strong if _YOU.search(low[max(0, a - NEAR) : b + NEAR]))
        odd = _OBFUSCATED.findall(text)
        hidden = sum(1 for w in odd if w.lower() not in self.tier and self.tier.get(w.lower().translate(_LEET)) == 2)
        return [
            100.0 * len(strong) / words, math.log1p(len(strong)), float(len({h[2] for h in strong})), 100.0 * mild / words,
            math.log1p(mild), 100.0 * near / words, math.log1p(near), float(raw[65:91].sum()) / chars, float(raw[33]) / chars,
            float(raw[_PUNCT].sum()) / chars, float(raw[48:58].sum()) / chars, float(len(odd)) / words, math.log1p(hidden),
        ]


def _features(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lexicon.features)

    return run(F.coalesce(text, F.lit("")))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, label, deal) of at most about TRAIN_ROWS rows; the labels taken are broadcast, as they number no more."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("__label"))
    share = min(1.0, TRAIN_ROWS / max(1, usable.count()))
    draw = lambda k, salt: F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    taken = cut(usable.where(draw(F.col("doc_id").cast("long"), "tox") < share).withColumnRenamed("doc_id", "__id"))
    some = docs.where(draw(F.col(key).cast("long"), "tox") < share)
    rows = some.join(F.broadcast(taken), F.col(key) == F.col("__id"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("__label").alias("label"),
                       draw(F.col(key).cast("long"), "deal").alias("deal"))

    @F.pandas_udf("long")
    def smallest(column: pd.Series) -> pd.Series:
        sets = shingle_sets(column.tolist())
        return pd.Series([int(x[0]) >> 1 if len(x) else -1 for x in sets], dtype="int64")

    first = W.partitionBy("code").orderBy("id", "text")
    return rows.withColumn("code", smallest("text")).withColumn("r", F.row_number().over(first)).where("r = 1").drop("code", "r")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words over-represented in the toxic rows of (text, label)."""
    def words(batches):
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"]):
                found = _WORD.findall(t.lower())
                around = dict(zip(found, zip(["", *found], [*found[1:], ""])))
                yield pd.DataFrame([(w, y, f"{a} {b}") for w, (a, b) in around.items()], columns=["word", "label", "around"])

    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not toxic or not clean:
        return Lexicon([], [])
    counts = rows.select("text", "label").mapInPandas(words, "word string, label double, around string").distinct()
    counts = counts.groupBy("word").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("k"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    counts = counts.withColumns({"k": F.least("k", F.lit(toxic)), "n": F.least("n", F.lit(clean))})
    k, n = F.col("k") + 0.5, F.col("n") + 0.5
    odds = F.log(k / (toxic + 1 - k)) - F.log(n / (clean + 1 - n))
    scored = counts.where("k > 1").withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / k + 1 / n))
    top = scored.where((F.col("odds") >= ODDS) & (F.col("z") >= Z)).orderBy(F.desc("z"), "word").limit(TERMS).collect()
    return Lexicon([r.word for r in top if r.odds >= STRONG], [r.word for r in top if r.odds < STRONG])


class Scorer:
    """Lexicon, trees and calibration; or a constant."""

    def __init__(self, lexicon: Lexicon, trees, curve, constant: float):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with the calibrated score of each row; nothing is shuffled."""
        if self.trees is None:
            return docs.withColumn(out, F.lit(float(self.constant)))
        rows = docs.withColumn("__x", array_to_vector(_features(self.lexicon, F.col(text))))
        rows = self.trees.transform(rows).withColumn("__raw", vector_to_array("__p")[1]).drop("__x", "__r", "__p", "__y")
        if self.curve is None:
            return rows.withColumnRenamed("__raw", out)
        rows = self.curve.transform(rows)
        return rows.withColumn(out, F.least(F.greatest(F.col("__c"), F.lit(0.0)), F.lit(1.0))).drop("__raw", "__c")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Fit lexicon, trees and calibration on separate parts of the labelled sample."""
    rows = cut(labelled(docs, labels, key, text, label))
    lexicon = learn_lexicon(rows.where("deal < 0.5"))
    # ordered by id in one small partition: the same rows give the same trees whatever the cluster
    made = cut(rows.where("deal >= 0.5").select("id", "deal", "label", _features(lexicon, F.col("text")).alias("x")))
    made = made.coalesce(1).sortWithinPartitions("id", "deal").withColumn("__x", array_to_vector("x"))
    counts = {r.label: r["count"] for r in made.where("deal < 0.8").groupBy("label").count().collect()}
    seen = rows.agg(F.avg("label")).first()[0]
    if len(counts) < 2:
        return Scorer(lexicon, None, None, seen or 0.0)
    trees = GBTClassifier(
        featuresCol="__x", labelCol="label", predictionCol="__y",
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=5,
    ).fit(made.where("deal < 0.8"))
    trees = trees.setRawPredictionCol("__r").setProbabilityCol("__p")
    raw = trees.transform(made.where("deal >= 0.8")).select("label", vector_to_array("__p")[1].alias("__raw"))
    curve = None
    if raw.select("label").distinct().count() == 2:
        curve = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__c").fit(raw)
    return Scorer(lexicon, trees, curve, seen)
