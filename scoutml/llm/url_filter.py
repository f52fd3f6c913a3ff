"""Operator 6: URL filters by host rules and a weighted vocabulary.

Host rules come first: a rule fits its host and all subdomains when the url's
path starts with the rule's path; the longest rule that fits decides.  For other
urls an Aho-Corasick automaton finds every vocabulary term in the lower-cased
url; a hit counts only if no letter or digit (A-Z, 0-9) touches it on either
side.  Strict terms weigh ``LIMIT``, soft terms 1; a url is blocked when its
distinct hits weigh ``LIMIT`` or more: one strict term, or ``LIMIT`` different
soft ones.

Edge cases: a null url, or one without ``://``, has empty host and path and is
judged by its text alone (a null by the empty text); urls of any length are read
whole; repeated rows are judged each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2
STRICT = ("casino", "escort", "hardcore", "porn", "pornhub", "spam-farm", "torrent", "viagra", "warez", "xxx", "xvideos")
SOFT = (
    "adult", "ads", "banner", "bet", "betting", "bonus", "click", "crack", "dating", "farm", "free", "gambling", "girls",
    "hack", "keygen", "loan", "nude", "poker", "popup", "sex", "spam", "sponsor", "track", "tracker", "win",
)
#: (host, path, verdict), fixed.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        hit = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def vocabulary_weight(url: Column, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> Column:
    """Weight of the distinct terms that stand free in the url."""

    @F.pandas_udf("int")
    def weigh(urls):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for terms, weight in ((soft, 1), (strict, limit)):
            for t in terms:
                automaton.add_word(t, (t, weight))
        automaton.make_automaton()
        edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def one(u: str) -> int:
            seen = {}
            for end, (term, weight) in automaton.iter(u):
                start = end - len(term) + 1
                if (start == 0 or u[start - 1] not in edge) and (end + 1 == len(u) or u[end + 1] not in edge):
                    seen[term] = weight
            return sum(seen.values())

        return urls.map(one)

    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return weigh(low)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, weight, verdict) of every row."""
    u = F.col(url)
    parts = pages.select(
        F.col(key).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"),
        vocabulary_weight(u).alias("weight"),
    )
    ruled = parts.withColumn("hit", rule_of(F.col("host"), F.col("path")))
    own = F.when(F.col("weight") >= LIMIT, "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "weight",
    )


def _oracle() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = " + ".join(
        f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END"
        for terms, w in ((SOFT, 1), (STRICT, LIMIT)) for t in terms
    )
    cases = lambda out: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(h, p, v)}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"""
WITH parts AS (
  SELECT page_id, {low} AS low,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, low,
    translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
weighed AS (SELECT *, CAST({terms} AS INTEGER) AS weight FROM split)
SELECT page_id, host, path,
  CASE {cases(lambda h, p, v: h + p)} ELSE NULL END AS rule,
  CASE {cases(lambda h, p, v: v)} ELSE CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
  weight
FROM weighed"""


ORACLE_SQL = _oracle()
