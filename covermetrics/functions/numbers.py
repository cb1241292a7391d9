"""Numeric expressions whose results must not depend on row order or engine.

Money is summed as decimal; ratios are taken in double, fixed to six decimals and
only then rounded half-up, so a value such as 1.005 rounds the same everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
FIXED = "decimal(38,6)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Double to cents; the detour over six decimals makes ties round half-up."""
    return as_col(c).cast(FIXED).cast(MONEY)


def rounded(c: Column | str, digits: int) -> Column:
    return F.round(as_col(c).cast(FIXED), digits).cast("double")


def rounded_score(c: Column | str, digits: int = 5) -> Column:
    """``rounded`` for small non-negative scores, in long arithmetic; for many rows."""
    step = 10 ** (6 - digits)
    micro = F.floor(as_col(c) * 1e6 + 0.5)
    return F.floor((micro + step // 2) / F.lit(float(step))) / F.lit(float(10 ** digits))


def ratio(num: Column | str, den: Column | str, digits: int = 4, scale: float = 1.0) -> Column:
    """``num / den``, NULL (not an error) when the denominator is zero."""
    den = F.nullif(as_col(den).cast("double"), F.lit(0.0))
    return rounded(as_col(num).cast("double") / den * F.lit(float(scale)), digits)


def percent(num: Column | str, den: Column | str, digits: int = 1) -> Column:
    return ratio(num, den, digits, 100.0)


def mean(c: Column | str, digits: int = 2) -> Column:
    """Average from an exact sum: the same bits whatever the row order."""
    c = as_col(c)
    return ratio(F.sum(c), F.count(c), digits)


def band(c: Column | str, edges: Sequence[tuple[float, str]], last: str,
         unknown: str | None = "unknown", inclusive: bool = False) -> Column:
    """Label by upper edge. NULL gets ``unknown``; pass ``unknown=None`` for the
    as-written form in which NULL falls through to the last band."""
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(unknown)) if unknown is not None else None
    for edge, label in edges:
        cond = c <= F.lit(edge) if inclusive else c < F.lit(edge)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(last))


def strict_least(*cols: Column | str) -> Column:
    """NULL if any argument is NULL (the built-in skips NULLs)."""
    return _strict(F.least, cols)


def strict_greatest(*cols: Column | str) -> Column:
    return _strict(F.greatest, cols)


def _strict(fn, cols) -> Column:
    cols = [as_col(c) for c in cols]
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, fn(*cols))


def hash_bucket(key: Column | str, n: int, salt: str = "") -> Column:
    """Stable bucket in [0, n) from md5, equal in any engine that has md5."""
    text = F.concat(as_col(key).cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(n)


def array_position0(arr: Column | str, value) -> Column:
    """0-based position, NULL when absent."""
    return F.nullif(F.array_position(as_col(arr), value), F.lit(0)) - F.lit(1)


def money_text_to_number(c: Column | str) -> Column:
    """'$1,234.50' or '12%' to double; unreadable text gives NULL."""
    return F.regexp_replace(F.trim(as_col(c)), r"[$,%]", "").try_cast("double")


def short_currency(c: Column | str) -> Column:
    """Compact amount: 1.2M, 3.4K, otherwise whole units."""
    c = as_col(c).cast("double")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.abs(c) >= 1e6, F.concat(F.lit("$"), rounded(c / 1e6, 1).cast("decimal(38,1)").cast("string"), F.lit("M")))
        .when(F.abs(c) >= 1e3, F.concat(F.lit("$"), rounded(c / 1e3, 1).cast("decimal(38,1)").cast("string"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), rounded(c, 0).cast("long").cast("string")))
    )


def percent_text(c: Column | str) -> Column:
    return F.concat(rounded(c, 1).cast("decimal(38,1)").cast("string"), F.lit("%"))
