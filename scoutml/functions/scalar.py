"""Scalar column functions (F1–F12): all built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 -------------------------------------------------------------------------
def normalize(c: str | Column) -> Column:
    """lower + strip, the name normalisation used by every resolver."""
    return F.lower(strip_ws(_c(c)))


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` drops only spaces)."""
    return F.regexp_replace(_c(c), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")


def split_trimmed(c: str | Column, sep: str = ",") -> Column:
    """Split on ``sep``, strip each piece, drop empty pieces."""
    return F.filter(F.transform(F.split(_c(c), sep), lambda s: strip_ws(s)), lambda s: s != F.lit(""))


# F2 -------------------------------------------------------------------------
def truncate_text(c: str | Column, n: int = 60, suffix: str = "...") -> Column:
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


# F3 -------------------------------------------------------------------------
def k_rule(width: Column | int, frac: float = 0.3) -> Column:
    """max(1, min(int(frac*d), d))."""
    d = F.lit(width) if isinstance(width, int) else width
    return F.greatest(F.lit(1), F.least(F.floor(F.lit(frac) * d).cast("int"), d.cast("int")))


# F4 -------------------------------------------------------------------------
def fmt_fixed(c: str | Column, digits: int = 4, missing: str = "N/A") -> Column:
    """``f"{x:.4f}"``; non-numeric or null gives ``missing``."""
    as_double = _c(c).try_cast("double")
    # format_string renders null as the text "null", so test first
    return F.when(as_double.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", as_double))


# F5 -------------------------------------------------------------------------
def pad_right(c: str | Column, width: int = 25) -> Column:
    """``f"{s:25s}"``: pads, never truncates (``rpad`` alone would)."""
    col = _c(c)
    return F.when(F.length(col) < width, F.rpad(col, width, " ")).otherwise(col)


# F6 -------------------------------------------------------------------------
def latin1_safe(c: str | Column) -> Column:
    """Replace every character outside Latin-1 by ``?``."""
    return F.regexp_replace(_c(c), "[^\\x{0000}-\\x{00FF}]", "?")


# F7 -------------------------------------------------------------------------
def fmt_timestamp(c: str | Column) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


# F8 -------------------------------------------------------------------------
def json_or_default(c: str | Column, schema, default: Column) -> Column:
    """Tolerant decode: empty, null or malformed text gives ``default``."""
    col = _c(c)
    parsed = F.from_json(col, schema, {"mode": "PERMISSIVE"})
    return F.when(col.isNull() | (F.trim(col) == ""), default).otherwise(F.coalesce(parsed, default))


# F9 -------------------------------------------------------------------------
def drop_keys(m: str | Column, keys: Sequence[str]) -> Column:
    banned = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(_c(m), lambda k, v: ~F.array_contains(banned, k))


# F11 ------------------------------------------------------------------------
def flip_inlier(raw: str | Column) -> Column:
    """``np.where(raw == 1, 0, 1)``: library +1/-1 -> anomaly flag 0/1."""
    return F.when(_c(raw) == 1, F.lit(0)).otherwise(F.lit(1))


# F12 ------------------------------------------------------------------------
def default_if_null(c: str | Column, default) -> Column:
    """Null-only default (D5: 0.0 is a value, not missing)."""
    return F.coalesce(_c(c), F.lit(default))
