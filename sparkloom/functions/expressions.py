"""Expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Categories of feature names, each with a pattern for the lower-cased name; the first match wins.
NAME_CATEGORIES = [
    ("TQWT", "tqwt"),
    ("Wavelet", "wavelet|_lt_|ed_|ed2_|entropy"),
    ("Jitter", "jitter"),
    ("Shimmer", "shimmer|shim_|apq"),
    ("HNR / Harmonicity", "hnr|harmonicity|harmtonoise"),
    ("Intensity", "intensity"),
    ("Formant / Bandwidth", "^[fb][0-9]$"),
    ("MFCC", "mfcc"),
    ("Delta / Delta-delta", "delta"),
    ("Nonlinear", "rpde|dfa|ppe|gne"),
]


def clean(x: Column) -> Column:
    """NaN as null, which aggregates skip."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def first_match(name: Column, categories: list[tuple[str, str]] = NAME_CATEGORIES, default: str = "Other") -> Column:
    """The first category whose pattern the lower-cased name matches."""
    out = F.lit(default)
    for category, pattern in reversed(categories):
        out = F.when(F.lower(name).rlike(pattern), category).otherwise(out)
    return out


def warnings(*checks: tuple[Column, str]) -> Column:
    """The messages whose condition holds, joined by '; '."""
    return F.concat_ws("; ", *[F.when(cond, F.lit(text)) for cond, text in checks])


def direction(x: Column, above: str = "higher", below: str = "lower", equal: str = "equal") -> Column:
    return F.when(x > 0, above).when(x < 0, below).otherwise(equal)


def minmax(x: Column, over: WindowSpec | None = None, *, higher_is_better: bool = True, within: Column | None = None) -> Column:
    """x scaled to 0..1 over a window, reversed if lower is better. A constant column gives 0.5; null, NaN and infinite give 0.
    With within, only its rows set the range and others give null."""
    over = over or Window.partitionBy()
    own = finite(x) if within is None else F.when(within, finite(x))
    lo, hi = F.min(own).over(over), F.max(own).over(over)
    scaled = (own - lo) / F.nullif(hi - lo, F.lit(0.0))
    scaled = scaled if higher_is_better else 1 - scaled
    out = F.when(lo == hi, 0.5).otherwise(F.coalesce(scaled, F.lit(0.0)))
    out = F.when(own.isNull() & (lo != hi), 0.0).otherwise(out)
    return out if within is None else F.when(within, out)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return part / F.nullif(whole.cast("double"), F.lit(0.0))


def close(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Equal within a tolerance, or both missing."""
    a, b = clean(a), clean(b)
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def minus_log10(q: Column, over: WindowSpec) -> Column:
    """-log10(q), zero replaced by the least positive value."""
    least = F.min(F.when(q > 0, q)).over(over)
    return -F.log10(F.when(q == 0, least).otherwise(q))


def verdict(x: Column, high: float = 0.6, low: float = 0.3) -> Column:
    return F.when(x >= high, "strong").when(x >= low, "moderate").otherwise("weak")
