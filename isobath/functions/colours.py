"""Colours as 0xRRGGBB column expressions, and the textures that modifiers lay over water.

Colours of classifications come from short rules in single precision; their few values are worked out once and
looked up, so that a pixel costs one array access.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .water import LAKE, RIVER_KIND, SEA, SWAMP_KIND

# The maps' colours, by kind (sea, river, lake, swamp), temperature (warm, medium, cold) and depth.
VOID, LAND, PANEL = 0x0E0E14, 0x34363A, 0x08080C
TEXT, DIM, HEADING = 0xE8E8EC, 0x9698A0, 0x7EC6FF
RIVER_COLOR, SWAMP_COLOR = 0x99CACD, 0xC4A484
CAVE_DOT, CORAL_DOT, ICE_STRIPE, DESERT_DOT, MANGROVE_DOT = 0x44484F, 0xFF5ABE, 0xEBF8FF, 0xE2C878, 0x965028
KIND_COLORS = (0x1E52B2, 0x3AA8CD, 0x28A584, SWAMP_COLOR)
WARM_TINT, COLD_TINT, JUNGLE_TINT = 0xFF8C28, 0x78EBFF, 0x3CC85A
DEPTH_LUMINANCE = (0.62, 0.38, 0.18)
DEPTH_STOPS = ((0, 0xC6F4FC), (10, 0x60C4E2), (30, 0x2670C0), (60, 0x12307A), (100, 0x081036))
OCEAN_COLORS = (0x4E5D7C, 0x2B3752, 0x12326E, 0x091937, 0x48659C, 0x2B3D5E)
INLAND_COLORS = (0x247078, RIVER_COLOR, 0x64BED3, SWAMP_COLOR)
DESERT_RIVER, DESERT_LAKE = 0xEAD7A0, 0xD8A27D
LAKE_STOPS = (0x37539D, 0x34BADA, 0x42DC9B, 0xF8D85B, 0xEC5E51)
ICE, CORALS, DESERT, MANGROVE, CAVE = 1, 2, 4, 8, 16
SHELF = 30

_f = np.float32


def channels(color: int) -> np.ndarray:
    return np.array([color >> 16 & 255, color >> 8 & 255, color & 255], _f)


def packed(c: np.ndarray) -> int:
    r, g, b = (int(v) for v in c)
    return r << 16 | g << 8 | b


def blend(a: int, b: int, share: float) -> int:
    t = min(max(_f(share), _f(0)), _f(1))
    return packed(np.trunc(channels(a) * (_f(1) - t) + channels(b) * t))


def luminance(color: int) -> float:
    r, g, b = channels(color)
    return (_f(0.2126) * r + _f(0.7152) * g + _f(0.0722) * b) / _f(255)


def with_luminance(color: int, target: float) -> int:
    own, target = luminance(color), _f(target)
    if target <= own:
        return packed(np.trunc(channels(color) * (target / own if own > _f(0.001) else _f(0))))
    return blend(color, 0xFFFFFF, (target - own) / max(_f(1) - own, _f(0.001)))


def style(kind: int, temperature: int, depth: int | None, jungle: bool) -> int:
    """Kind and temperature give the hue, depth the brightness."""
    c = KIND_COLORS[kind]
    c = blend(c, WARM_TINT, 0.42) if temperature == 0 else blend(c, COLD_TINT, 0.42) if temperature == 2 else c
    c = blend(c, JUNGLE_TINT, 0.16) if jungle else c
    return c if depth is None else with_luminance(c, DEPTH_LUMINANCE[depth])


def ramp(blocks: int) -> int:
    """Colour of a measured depth."""
    for (lo, a), (hi, b) in zip(DEPTH_STOPS[:-1], DEPTH_STOPS[1:], strict=True):
        if blocks <= hi:
            return blend(a, b, _f(blocks - lo) / _f(hi - lo))
    return DEPTH_STOPS[-1][1]


def share_ramp(value: float) -> int:
    """Colour of a share from 0 to 1 on the lake layers."""
    place = min(max(value, 0.0), 1.0) * (len(LAKE_STOPS) - 1)
    low = min(int(place), len(LAKE_STOPS) - 2)
    return packed(np.floor(channels(LAKE_STOPS[low]) * (1 - (place - low)) + channels(LAKE_STOPS[low + 1]) * (place - low) + 0.5))


def _table(values: list[int], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def region_color(kind: Column, temperature: Column, depth: Column, vegetation: Column) -> Column:
    """Colour of a classification; a null depth keeps the hue's own brightness."""
    values = [style(k, t, d, j) for k in range(4) for t in range(3) for d in (0, 1, 2, None) for j in (False, True)]
    return _table(values, ((kind * 3 + temperature) * 4 + F.coalesce(depth, F.lit(3))) * 2 + (vegetation == 3).cast("int"))


def depth_color(blocks: Column) -> Column:
    return _table([ramp(k) for k in range(101)], F.least(F.greatest(blocks, F.lit(0)), F.lit(100)))


def ocean_code(temperature: Column, depth: Column) -> Column:
    return (temperature * 2 + (F.coalesce(depth, F.lit(0)) > SHELF).cast("int")).cast("int")


def ocean_color(code: Column) -> Column:
    return _table(list(OCEAN_COLORS), code)


def inland_color(kind: Column, modifiers: Column) -> Column:
    dry = modifiers.bitwiseAND(F.lit(DESERT)) != 0
    return F.when((kind == RIVER_KIND) & dry, DESERT_RIVER).when((kind == LAKE) & dry, DESERT_LAKE).otherwise(_table(list(INLAND_COLORS), kind))


def id_color(region: Column) -> Column:
    """A colour of its own for every region number: hues a golden ratio apart, in single precision."""
    single = lambda v: F.lit(v).cast("float")
    number = region.cast("float") * single(0.618034)
    hue = (number - F.floor(number).cast("float")) * single(6.0)
    step = lambda by: F.floor(region / by) % 3 / 2
    saturation = single(0.55) + single(0.35) * step(7).cast("float")
    value = single(0.60) + single(0.35) * step(3).cast("float")
    sextant = F.floor(hue)
    part = hue - sextant.cast("float")
    one = single(1.0)
    p, q, t = value * (one - saturation), value * (one - part * saturation), value * (one - (one - part) * saturation)
    wheel = ((value, t, p), (q, value, p), (p, value, t), (p, q, value), (t, p, value), (value, p, q))

    def channel(k: int, shift: int) -> Column:
        chosen = F.get(F.array(*[w[k] for w in wheel]), (sextant % 6).cast("int"))
        return F.shiftleft(F.floor(chosen * single(255.0)).cast("int"), shift)

    return channel(0, 16) + channel(1, 8) + channel(2, 0)


def texture(modifiers: Column, x: Column, y: Column, all_of_them: bool = True) -> Column:
    """Colour that modifiers show at a pixel of the whole image, or null: cave over coral over ice over desert over mangrove."""
    has = lambda bit: modifiers.bitwiseAND(F.lit(bit)) != 0
    out = F.when(has(CAVE) & (x % 5).between(2, 3) & (y % 5).between(2, 3), CAVE_DOT).when(has(CORALS) & (x % 6 == 2) & (y % 6 == 2), CORAL_DOT).when(has(ICE) & (y % 8 < 2), ICE_STRIPE)
    return out.when(has(DESERT) & ((x + 5 * y) % 11 < 2), DESERT_DOT).when(has(MANGROVE) & (x % 7 == 3) & (y % 7 == 5), MANGROVE_DOT) if all_of_them else out


INLAND_ORDER = (SEA, LAKE, RIVER_KIND, SWAMP_KIND)
