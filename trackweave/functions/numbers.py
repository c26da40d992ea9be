"""Guarded arithmetic and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, least: float = 1e-6) -> Column:
    return a / F.greatest(b, F.lit(float(least)))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between two bounds; null stays null, which greatest and least alone would skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def linear_score(value: Column, low: float, high: float) -> Column:
    """0 to 100 between two bounds; null or an empty range scores 0."""
    if high <= low:
        return F.lit(0.0)
    return F.coalesce(clip(F.lit(100.0) * (value - low) / float(high - low), 0, 100), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def log_size_score(share: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.ln(F.greatest(F.lit(0.05), share))))


def strength(score: Column, strong: float = 0.75, moderate: float = 0.45) -> Column:
    return F.when(score >= strong, "strong").when(score >= moderate, "moderate").when(score > 0, "weak").otherwise("missing")


def zscore_class(z: Column, std: Column, n: Column, percentile: Column, strategy: Column) -> Column:
    """How far a z-score may be shown: the first rule that fits."""
    return (
        F.when((n < 30) | z.isNull() | F.isnan(z), "discard").when(std < 1e-5, "unstable")
        .when((z > 100) | ((z > 50) & strategy.isin("dark_strict", "brightness_threshold_loose")), "unstable")
        .when((z > 20) | (percentile >= 99.5), "exploratory").otherwise("public_safe")
    )


def media_time(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame / fps).otherwise(0.0)


def fourcc(code: Column) -> Column:
    """Four-character code of an integer, least byte first."""
    return F.concat(*[F.chr(F.shiftright(code, 8 * i).bitwiseAND(F.lit(255))) for i in range(4)])


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, as processors' fused multiply-add does: the errors of the product and of the sum are kept (Dekker, Knuth).

    Beyond 1e290, where halves would overflow, and without a finite sum it is rounded twice.
    """
    halves = lambda v: ((v * 134217729.0) - ((v * 134217729.0) - v), v - ((v * 134217729.0) - ((v * 134217729.0) - v)))
    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    back = s - p
    return F.when((F.abs(a) < 1e290) & (F.abs(b) < 1e290) & (F.abs(s) < 1e290), s + (((p - (s - back)) + (c - back)) + lost)).otherwise(s)
