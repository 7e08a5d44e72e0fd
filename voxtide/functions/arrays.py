"""Expressions on images and planes held as arrays, one row each: nothing is shuffled, and no Python runs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often a lambda in `body` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def array_std(a: Column) -> Column:
    """Of the population."""
    return let(array_mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a)))


def normalize(a: Column) -> Column:
    """v / mean."""
    return let(array_mean(a), lambda m: F.transform(a, lambda x: x / m))


def normalize_inverse(a: Column) -> Column:
    """1 - v / mean."""
    return let(array_mean(a), lambda m: F.transform(a, lambda x: 1 - x / m))


def normalize_mean0(a: Column) -> Column:
    """v / mean - 1."""
    return let(array_mean(a), lambda m: F.transform(a, lambda x: x / m - 1))


def denormalize(a: Column, mean: Column, how: str) -> Column:
    """Undo one of the above; `how` names it."""
    back = {"normalize": lambda x, m: x * m, "inverse": lambda x, m: (1 - x) * m, "mean0": lambda x, m: (x + 1) * m}
    # bound once: an expression that stands in a lambda is computed for each element
    return let(mean, lambda m: let(a, lambda v: F.transform(v, lambda x: back[how](x, m))))


def rescale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def match_mean_std(a: Column, mean: Column, std: Column) -> Column:
    """Shift and scale to another mean and deviation; a flat image becomes its mean."""
    scaled = lambda m, s: let(mean, lambda to: let(std, lambda wide: F.transform(a, lambda x: to + F.when(s > 0, (x - m) * wide / s).otherwise(0.0))))
    return let(array_mean(a), lambda m: let(array_std(a), lambda s: scaled(m, s)))


def rounded(x: Column) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def saturate(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def eight_bit(x: Column) -> Column:
    """As 8-bit images are written: half to even, then saturated."""
    return saturate(F.rint(x), 0, 255)


def stretch(a: Column) -> Column:
    """To 0..255 between the least and the greatest value; a flat image is 0."""
    return let(F.array_min(a), lambda lo: let(F.array_max(a), lambda hi: F.transform(a, lambda x: F.when(hi > lo, 255 * (x - lo) / (hi - lo)).otherwise(0.0))))


def contrast(a: Column, low: float, high: float) -> Column:
    """For display: the share `low`..`high` of an image's range becomes 0..255."""
    return let(
        F.array_min(a),
        lambda lo: let(F.array_max(a) - F.array_min(a), lambda r: F.transform(a, lambda x: saturate(F.when(r > 0, (x - (lo + low * r)) * 255 / ((high - low) * r)).otherwise(0.0), 0, 255))),
    )


def threshold(x: Column, t: float, how: str, top: float = 1.0) -> Column:
    """to_zero: values below t become 0; binary: above t becomes `top`, else 0; binary_inv: below t becomes `top`, else 0 (so t itself is 0 in both)."""
    if how == "to_zero":
        return F.when(x < t, 0.0).otherwise(x)
    return F.when((x > t) if how == "binary" else (x < t), F.lit(float(top))).otherwise(0.0)


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    """In [0, 2 pi)."""
    return F.pmod(F.atan2(im, re), F.lit(2 * math.pi))


def soft_threshold(x: Column, t: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def soft_threshold_power(re: Column, im: Column, t: float) -> tuple[Column, Column]:
    """Shrink a complex value by its squared magnitude: v y / (y + t), y = max(|v|^2 - t, 0)."""
    y = F.greatest(re * re + im * im - t, F.lit(0.0))
    k = F.when(y > 0, y / (y + t)).otherwise(0.0)
    return re * k, im * k


def crop(a: Column, w: Column, x0: int, y0: int, cw: int, ch: int, h: Column | None = None) -> Column:
    """A rectangle of a row-major image; what lies outside the image is 0."""
    inside = lambda i: (F.lit(x0) + F.pmod(i, F.lit(cw)) >= 0) & (F.lit(x0) + F.pmod(i, F.lit(cw)) < w) & (F.lit(y0) + F.floor(i / cw) >= 0) & (F.lit(y0) + F.floor(i / cw) < F.size(a) / w)
    at = lambda i: ((F.lit(y0) + F.floor(i / cw)) * w + F.lit(x0) + F.pmod(i, F.lit(cw))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(cw * ch - 1)), lambda i: F.when(inside(i), F.get(a, at(i))).otherwise(0.0))


def zero_pad(a: Column, w: Column, h: Column, p: int) -> Column:
    """`p` zeros on every side, whatever the aspect."""
    wide = w + 2 * p
    def value(i):
        x, y = F.pmod(i, wide) - p, F.floor(i / wide) - p
        return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(a, (y * w + x).cast("int"))).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), (wide * (h + 2 * p) - 1).cast("int")), value)


def linear_index(x: Column, y: Column, z: Column, w, h) -> Column:
    return (z * h + y) * w + x


def from_linear(i: Column, w: int, h: int, d: int) -> Column:
    """(x, y, z); (0, 0, 0) out of range."""
    ok = (i >= 0) & (i < w * h * d)
    part = lambda e: F.when(ok, e).otherwise(0).cast("int")
    return F.struct(part(F.pmod(i, F.lit(w))).alias("x"), part(F.floor(F.pmod(i, F.lit(w * h)) / w)).alias("y"), part(F.floor(i / (w * h))).alias("z"))


def tukey(i: Column, n: int, r: float) -> Column:
    """A separable factor of the tapered cosine window over 0..n-1; ones if r is outside (0, 1)."""
    if not 0 < r < 1:
        return F.lit(1.0)
    t = i / F.lit(float(n - 1))
    edge = lambda u: 0.5 * (1 + F.cos(2 * math.pi / r * (u - r / 2)))
    return F.when(t < r / 2, edge(t)).when(t > 1 - r / 2, edge(1 - t)).otherwise(1.0)


def gaussian(i: Column, n: int, a: float) -> Column:
    """exp(-(a k / (n/2))^2 / 2) of the distance k from the middle."""
    k = (i - F.lit((n - 1) / 2)) * (a / (n / 2))
    return F.exp(-0.5 * k * k)


def last_number(path: Column) -> Column:
    """The last run of digits of a path, as a number."""
    return F.regexp_extract(path, r"(\d+)(?!.*\d)", 1).try_cast("bigint")
