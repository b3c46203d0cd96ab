"""Scalar expressions: band indices, angles, frames, normalisation. All are Column -> Column, without Python at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exg(r="red", g="green", b="blue") -> Column:
    r, g, b = map(_c, (r, g, b))
    return (2 * g - r - b) / (r + g + b + EPS)


def vari(r="red", g="green", b="blue") -> Column:
    """Clipped to [-1, 1]; a denominator of exactly zero gives null."""
    r, g, b = map(_c, (r, g, b))
    return clip(F.try_divide(g - r, g + r - b + EPS), -1.0, 1.0)


def gli(r="red", g="green", b="blue") -> Column:
    r, g, b = map(_c, (r, g, b))
    return (2 * g - r - b) / (2 * g + r + b + EPS)


def ngrdi(r="red", g="green") -> Column:
    r, g = _c(r), _c(g)
    return (g - r) / (g + r + EPS)


def ndvi(n="nir", r="red") -> Column:
    n, r = _c(n), _c(r)
    return (n - r) / (n + r + EPS)


def darkness(r="red", g="green", b="blue") -> Column:
    return 1 - (_c(r) + _c(g) + _c(b)) / 765.0


def absolute_green(r="red", g="green", b="blue") -> Column:
    return 2 * _c(g) - _c(r) - _c(b)


def brightness(r="red", g="green", b="blue") -> Column:
    return (_c(r) + _c(g) + _c(b)) / 3.0


#: Indices by name, and what they need.
INDICES = {"exg": exg, "vari": vari, "gli": gli, "ngrdi": ngrdi, "ndvi": ndvi, "dark": darkness}


def index(name: str) -> Column:
    if name.lower() not in INDICES:
        raise ValueError(f"no index {name!r}; there are {', '.join(INDICES)}")
    return INDICES[name.lower()]()


def clip(x, lo, hi) -> Column:
    x = _c(x)
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x.isNull(), x).otherwise(F.greatest(lo, F.least(hi, x)))


def angle_diff(a, b) -> Column:
    """Difference of two directions, modulo 180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def azimuth(dx, dy) -> Column:
    """Bearing from north of a direction in map coordinates, modulo 180."""
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(180.0))


def line_angle(dx, dy) -> Column:
    return F.degrees(F.atan2(_c(dy), _c(dx)))


def length(dx, dy) -> Column:
    return F.sqrt(_c(dx) * _c(dx) + _c(dy) * _c(dy))


def to_map(col, row, gt: tuple[float, ...], centre: float = 0.5) -> tuple[Column, Column]:
    """Map coordinates of a pixel. gt: x0, dx, rx, y0, ry, dy."""
    c, r = _c(col) + centre, _c(row) + centre
    return gt[0] + c * gt[1] + r * gt[2], gt[3] + c * gt[4] + r * gt[5]


def to_pixel(x, y, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """Column and row (whole numbers) that hold a map point; the inverse of to_map."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = _c(x) - gt[0], _c(y) - gt[3]
    return F.floor((gt[5] * dx - gt[2] * dy) / det), F.floor((gt[1] * dy - gt[4] * dx) / det)


def across(x, y, angle_deg: float | Column) -> Column:
    """Coordinate across rows of this direction."""
    a = F.radians(angle_deg if isinstance(angle_deg, Column) else F.lit(float(angle_deg)))
    return -_c(x) * F.sin(a) + _c(y) * F.cos(a)


def along(x, y, angle_deg: float | Column) -> Column:
    a = F.radians(angle_deg if isinstance(angle_deg, Column) else F.lit(float(angle_deg)))
    return _c(x) * F.cos(a) + _c(y) * F.sin(a)


def normalised(v, base, ref) -> Column:
    """0 at base, 1 at ref; null where ref is not above base."""
    v, base, ref = map(_c, (v, base, ref))
    return F.when(ref - base >= EPS, (v - base) / F.when(ref - base >= EPS, ref - base))


def level_fraction(value, lo, hi) -> Column:
    return F.try_divide(_c(value) - _c(lo), _c(hi) - _c(lo))


def bin_of(x, origin, width) -> Column:
    return F.floor((_c(x) - origin) / width)


def phase_bin(t, period, n: int) -> Column:
    """Which of n parts of the period t falls in."""
    return F.least(F.floor(F.pmod(_c(t) / period, F.lit(1.0)) * n), F.lit(n - 1))


def parabola_offset(before, at, after) -> Column:
    """Where between its neighbours a maximum lies: within half a step."""
    a, b, c = map(_c, (before, at, after))
    den = a - 2 * b + c
    return F.when(F.abs(den) <= 1e-12, F.lit(0.0)).otherwise(clip(F.try_divide(0.5 * (a - c), den), -0.5, 0.5))


def robust_weight(w, residual, scale: float = 0.12) -> Column:
    q = _c(residual) / scale
    return _c(w) / (1 + q * q)


def capped_loss(w, residual, cap: float = 0.25) -> Column:
    """Sum of squares, each capped."""
    r = _c(residual)
    return F.sum(_c(w) * F.least(r * r, F.lit(cap * cap)))


def present(con, left, right, tau) -> Column:
    """A contrast over tau with both sides lower; null counts as absent."""
    return F.coalesce((_c(con) > tau) & (F.least(_c(left), _c(right)) > 0), F.lit(False))


def dn_scale(top) -> Column:
    """What 8-bit numbers are multiplied with, from a high percentile of the bands."""
    t = _c(top)
    return F.when(t <= 1.5, F.lit(1 / 255.0)).when(t <= 255, F.lit(1.0)).otherwise(F.lit(257.0))


def reasons(c) -> Column:
    """Distinct reasons, sorted, joined by a comma and a space (an aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(_c(c))), ", ")


def half_even(x, digits: int) -> Column:
    return F.bround(_c(x), digits)


def circular_mean(angle_deg, weight) -> Column:
    """Weighted mean of directions modulo 180 (an aggregate)."""
    a, w = F.radians(2 * _c(angle_deg)), _c(weight)
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) / 2, F.lit(180.0))


def weighted_mean(x, w) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(_c(w)))


def noise_rms(x) -> Column:
    """Root mean square of the negative values where there are 50 of them, else a tenth of the median size (an aggregate)."""
    x = _c(x)
    neg = F.when(x < 0, x)
    return F.when(F.count(neg) >= 50, F.sqrt(F.avg(neg * neg))).otherwise(0.1 * F.percentile(F.abs(x), F.lit(0.5)))


TWO_PI = 2 * math.pi


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SHADOW = 30.0


def lit_enough(scale, r="red", g="green", b="blue") -> Column:
    """Brightness over the shadow threshold, taken to the scale of the numbers."""
    return brightness(r, g, b) >= SHADOW * _c(scale)
