"""Scalar column functions on pixel values, spectra and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference wavelengths (nm) of red, green and blue.
RGB_WAVELENGTHS = [630.0, 532.0, 465.0]

# Colour ramps, one list of (r, g, b) stops each.
WEIGHT_RAMP = [(24, 68, 129), (1, 132, 71), (253, 236, 132)]
COVARIANCE_RAMP = [(15, 0, 255), (0, 255, 0), (255, 255, 0)]
TERRAIN_RAMP = [(102, 0, 172), (33, 87, 166), (78, 156, 103), (252, 255, 146), (220, 26, 0)]


def select_bands(spectrum: Column | str, bands: list[int]) -> Column:
    """Subset or reorder bands of a spectrum array."""
    col = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    return F.array(*[col[b] for b in bands])


def wrap_band(k: Column, n_bands: Column | int) -> Column:
    """Band index that wraps around in both directions."""
    return F.pmod(k, n_bands if isinstance(n_bands, Column) else F.lit(n_bands))


def stretch(v: Column, black: Column, white: Column, compat: bool = False) -> Column:
    """Linear stretch to 0..255; ``compat`` divides by white alone."""
    span = white if compat else white - black
    return F.least(F.greatest(F.try_divide(v - black, span), F.lit(0.0)), F.lit(1.0)) * 255


def to_uint8(v: Column, black: Column, white: Column) -> Column:
    """8-bit level: 0 below black, 255 from white on, truncated in between."""
    inside = F.try_divide(255 * (v - black), white - black).cast("int")
    return F.when(v < black, 0).when(v >= white, 255).otherwise(inside)


def gamma_level(v: Column, peak: Column) -> Column:
    """Value relative to the channel maximum, gamma 2.2, scaled to 255."""
    return F.pow(F.try_divide(v, peak), F.lit(1 / 2.2)) * 255


def two_segment_ramp(p: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Three-stop colour map; channels truncated to integers, ends clamped."""
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    low = p < 0.5
    w = F.when(low, p * 2).otherwise(p * 2 - 1)
    return [
        F.when(low, stops[0][c] * (1 - w) + stops[1][c] * w).otherwise(stops[1][c] * (1 - w) + stops[2][c] * w).cast("int")
        for c in range(3)
    ]


def stop_ramp(p: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Colour map with n stops at p = 0, 1/n, 2/n, ...; the position is clamped to the last stop."""
    x = p * len(stops)
    last = F.lit(len(stops) - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    lo = F.least(F.greatest(F.floor(x), zero), last)
    hi = F.least(F.greatest(F.ceil(x), zero), last)
    w = x - F.floor(x)

    def channel(c: int) -> Column:
        table = F.array(*[F.lit(float(s[c])) for s in stops])
        return ((1 - w) * table[lo] + w * table[hi]).cast("int")

    return [channel(c) for c in range(3)]


def valid_height(z: Column, low: float | None = None, high: float | None = None) -> Column:
    """True for a finite height inside the bounds; heights at or below -1e10 mark voids."""
    ok = z.isNotNull() & ~F.isnan(z) & (z > -1e10) & (z < math.inf)
    if low is not None:
        ok = ok & (z >= low)
    if high is not None:
        ok = ok & (z <= high)
    return F.coalesce(ok, F.lit(False))


def rescale_time(t: Column, scale: float, delta: float) -> Column:
    return t * scale + delta


def angle_delta(a: Column, b: Column) -> Column:
    """Difference of two angles after moving negatives to [0, 2pi); the difference itself is not wrapped."""
    turn = 2 * math.pi
    return F.when(a < 0, a + turn).otherwise(a) - F.when(b < 0, b + turn).otherwise(b)


def angle_lerp(a: Column, b: Column, w: Column, mode: str = "compat") -> Column:
    """Blend of two angles. ``compat`` shifts the blend by pi across the cut, ``shortest_arc`` follows the arc."""
    if mode == "shortest_arc":
        d = F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
        return a + w * d
    blend = (1 - w) * a + w * b
    return F.when(F.abs(a - b) > math.pi, F.when(blend < 0, blend + math.pi).otherwise(blend - math.pi)).otherwise(blend)


def resolve_range(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Negative ends count from the end; reversed ends are swapped."""
    a = F.when(start < 0, n + start).otherwise(start)
    b = F.when(end < 0, n + end).otherwise(end)
    return F.least(a, b), F.greatest(a, b)


def synth_wavelength(band: Column, n_bands: Column) -> Column:
    """Evenly spaced wavelengths from 380 to 2490 nm."""
    return 380 + F.try_divide(2110 * band.cast("double"), n_bands - 1)


def parse_wavelengths(text: Column) -> Column:
    """'{a, b, ...}' -> array of doubles, dropping items that are not numbers."""
    items = F.split(F.regexp_replace(text, "[{}]", ""), ",")
    return F.filter(F.transform(items, lambda s: F.trim(s).try_cast("double")), lambda x: x.isNotNull())
