"""Operator 1: secret scans over whole texts.

Base patterns give spans of kinds ``assign``, ``access`` and ``hex``.  The
entropy scan adds spans of kind ``entropy``: candidate strings are runs of key
characters; for each character class (decimal, hexadecimal, base64) a window of
its length slides over every maximal stretch of the class in a run.  A stretch of
``LEAST`` characters or more that is shorter than the window is one window, whose
bound shrinks as the logarithm of its length.  The
window's Shannon entropy is kept by counts: when a character enters or leaves,
only that character's term changes, so a candidate of any length costs one step
a character.  Terms are whole numbers (count * log2(count) scaled by 2**32), so
no rounding builds up.  Windows at or above the class's entropy bound that mix
enough character groups are joined into spans, over all classes.  A span is suppressed when the
allow list knows its text (well-known digests, placeholders) or its shape
(identifiers such as UUIDs, words joined by separators, paths).  Base spans are
never suppressed.

Positions are code points, ends exclusive.  Edge cases: null and empty texts
have no spans; texts of any length are read whole; repeated rows are scanned
each; an empty table gives no rows; other columns are ignored by ``scan`` and
kept by ``redact``.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import keyed_text, map_batches

KINDS = ("assign", "access", "hex", "entropy")

# Fixed base patterns.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: class -> (window, least bits per character in a window, least number of character groups)
CLASSES = {"decimal": (32, 3.1, 1), "hexadecimal": (24, 3.0, 2), "base64": (24, 3.9, 2)}
#: least length of a run, and of a class's stretch in it
LEAST = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_STRETCHES = {
    "decimal": re.compile(rf"[0-9]{{{LEAST},}}"), "hexadecimal": re.compile(rf"[0-9a-fA-F]{{{LEAST},}}"), "base64": _RUN,
}

#: Digests of the empty text and usual placeholders.
ALLOWED_TEXTS = frozenset({
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    "0123456789abcdef0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
})
#: Shapes that are not secrets: UUIDs, words or numbers joined by separators, file paths.
ALLOWED_SHAPES = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]{0,15}([-_/=+.][A-Za-z]{0,15})+"),
    re.compile(r"[0-9]{1,8}([-_/=+.][0-9]{1,8})+"),
)

_SCALE = 1 << 32
_MAX_WINDOW = max(w for w, _, _ in CLASSES.values())
_TERM = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, _MAX_WINDOW + 1)]


def _group(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def entropy_windows(s: str, window: int, bits: float, groups: int) -> list[tuple[int, int]]:
    """Joined (start, end) of the windows of ``s`` whose entropy is at least ``bits``.

    A shorter text is one window, its bound the same share of the most its length can hold.
    """
    w = min(window, len(s))
    if w < 2:
        return []
    least = round((math.log2(w) - bits * (math.log2(w) / math.log2(window))) * w * _SCALE)
    counts: dict[str, int] = {}
    kinds = [0, 0, 0, 0]
    total, out = 0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        kinds[_group(c)] += 1
        if i >= w:
            old = s[i - w]
            n = counts[old]
            total += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
            kinds[_group(old)] -= 1
        # entropy = log2(w) - total / w
        if i >= w - 1 and total <= least and sum(k > 0 for k in kinds[:3]) >= groups:
            start = i - w + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _allowed(s: str) -> bool:
    return s in ALLOWED_TEXTS or any(p.fullmatch(s) for p in ALLOWED_SHAPES)


def _entropy_spans(run: str) -> list[tuple[int, int]]:
    """Spans of the windows of all classes in a run, joined where they meet."""
    if _allowed(run):
        return []
    found = []
    for name, stretches in _STRETCHES.items():
        for x in stretches.finditer(run):
            s, at = x.group(), x.start()
            if not _allowed(s):
                found += [(at + a, at + b) for a, b in entropy_windows(s, *CLASSES[name]) if not _allowed(s[a:b])]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    for m in _CANDIDATE.finditer(text):
        run, at = m.group(), m.start()
        if "AKIA" in run:
            spans += [("access", at + x.start(), at + x.end()) for x in _ACCESS.finditer(run) if len(x.group()) >= 16]
        if len(run) >= 32:
            spans += [("hex", at + x.start(), at + x.end()) for x in _HEX.finditer(run) if len(x.group()) >= 32]
        for x in _RUN.finditer(run):
            spans += [("entropy", at + x.start() + a, at + x.start() + b) for a, b in _entropy_spans(x.group())]
    return sorted(spans, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))


def redacted(text: str, mark: str) -> str:
    """The text with every stretch covered by spans replaced by ``mark``."""
    out, done = [], 0
    cover: list[list[int]] = []
    for _, a, b in find_secrets(text):
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    for a, b in cover:
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every document with its spans (kind, start, end, found)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))

    def step(batch: pa.RecordBatch):
        rows = [
            [{"kind": k, "start": a, "end": b, "found": t[a:b]} for k, a, b in find_secrets(t)]
            for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=kind)], names=["doc_id", "spans"])

    return map_batches(
        keyed_text(docs, key, text), lambda: step,
        "doc_id long, spans array<struct<kind:string,start:long,end:long,found:string>>",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced by ``mark`` (a null text stays null)."""

    @F.pandas_udf("string")
    def clean(column):  # one Arrow batch of texts
        return column.map(lambda t: redacted(t, mark), na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
