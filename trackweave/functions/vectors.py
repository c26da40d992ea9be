"""Arithmetic over array columns (crops as flat arrays), inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std(v: Column) -> Column:
    """Population deviation, in two passes."""
    return F.get(F.transform(F.array(mean(v)), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))), F.lit(0))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def mean_squared_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def share(v: Column, test) -> Column:
    return F.size(F.filter(v, test)) / F.size(v)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, null where either side is constant."""
    def centred(v):
        return F.get(F.transform(F.array(mean(v)), lambda m: F.transform(v, lambda x: x.cast("double") - m)), F.lit(0))

    def out(p):
        dot = total(F.zip_with(p["a"], p["b"], lambda x, y: x * y))
        size = F.sqrt(total(F.transform(p["a"], lambda x: x * x)) * total(F.transform(p["b"], lambda x: x * x)))
        return F.when(size > 0, dot / size)

    return F.get(F.transform(F.array(F.struct(centred(a).alias("a"), centred(b).alias("b"))), out), F.lit(0))


def percentile(v: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    def at(s):
        place = (F.size(s) - 1) * q
        low = F.floor(place).cast("int")
        left, right = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return left + (right - left) * (place - low)

    return F.get(F.transform(F.array(F.sort_array(F.transform(v, lambda x: x.cast("double")))), at), F.lit(0))


def stencil_laplacian(v: Column, width: int, height: int) -> Column:
    """Four-neighbour Laplacian of a raster's inner pixels."""
    inner = [F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1)]
    at = lambda i: F.get(v, i).cast("double")
    return F.transform(F.array(*inner), lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))


def block_mean(v: Column, width: int, height: int, by: int) -> Column:
    """Area resize by an integer factor."""
    blocks = [F.array(*[F.lit((y + j) * width + x + i) for j in range(by) for i in range(by)]) for y in range(0, height, by) for x in range(0, width, by)]
    return F.transform(F.array(*blocks), lambda b: F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(v, i).cast("double")) / float(by * by))
