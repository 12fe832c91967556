"""Water kinds, temperatures, depths, shapes and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import LAND, OCEAN, RIVER, SWAMP

# Wire codes and thresholds.
KINDS = ("sea", "river", "lake", "swamp")
SEA, RIVER_KIND, LAKE, SWAMP_KIND = range(4)
TEMPERATURES = ("warm", "medium", "cold")
VEGETATIONS = ("none", "sparse", "normal", "jungle")
DEPTHS = ("shallow", "normal", "deep")
MODIFIERS = ("ice", "corals", "desert", "mangrove", "cave")
TOUCHES_OCEAN = 16
MIN_SEA = 2_000_000
CONTOURS = (10, 20, 30, 40)


def name_of(code: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for k, n in enumerate(names):
        out = F.when(code == k, n).otherwise(out)
    return out


def modifier_names(bits: Column) -> Column:
    parts = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, n) for k, n in enumerate(MODIFIERS)])
    return F.array_compact(parts)


def touches_ocean(ocean_columns: Column) -> Column:
    return ocean_columns >= TOUCHES_OCEAN


def column_kind(family: Column, ocean_columns: Column, columns: Column, near_ocean: Column, fringe: Column, cave: Column, in_sheet: Column, min_sea: int = MIN_SEA) -> Column:
    """Kind of a cell; fringe is the family of river or swamp water close by, or null."""
    touches = touches_ocean(ocean_columns)
    land = (
        F.when((near_ocean & touches) | (~touches & (columns >= min_sea)), SEA)
        .when(fringe == RIVER, RIVER_KIND)
        .when(fringe == SWAMP, SWAMP_KIND)
        .otherwise(LAKE)
    )
    return F.when(cave, LAKE).when(family == OCEAN, F.when(in_sheet, SEA).otherwise(LAKE)).when(family == RIVER, RIVER_KIND).when(family == SWAMP, SWAMP_KIND).otherwise(land)


def column_temperature(family: Column, kind: Column, own: Column, ocean: Column, fringe: Column) -> Column:
    """Only land water borrows the temperature of the water it belongs to."""
    borrowed = F.when(kind == SEA, F.coalesce(ocean, own)).when(kind.isin(RIVER_KIND, SWAMP_KIND), F.coalesce(fringe, own)).otherwise(own)
    return F.when(family == LAND, borrowed).otherwise(own)


def signature(kind: Column, temperature: Column, icy: Column, cave: Column) -> Column:
    return F.shiftleft(kind.cast("int"), 16) + F.shiftleft(cave.cast("int"), 9) + F.shiftleft(icy.cast("int"), 8) + temperature.cast("int")


def unpack_signature(sig: Column) -> Column:
    byte = lambda shift, mask: F.shiftright(sig, shift).bitwiseAND(F.lit(mask))
    return F.struct(byte(16, 255).alias("kind"), byte(0, 255).alias("temperature"), (byte(8, 1) == 1).alias("icy"), (byte(9, 1) == 1).alias("cave"))


def rounded_mean(total: Column, count: Column) -> Column:
    """total / count to the nearest whole number, halves away from zero, in whole numbers."""
    half = F.floor(count / 2).cast("long")
    return F.when(total >= 0, F.floor((total + half) / count)).otherwise(-F.floor((-total + half) / count))


def depth_class(mean_depth: Column) -> Column:
    return F.when(mean_depth <= 10, 0).when(mean_depth <= 30, 1).otherwise(2)


def promote(vegetation: Column) -> Column:
    return F.least(vegetation + 1, F.lit(3))


def demote(vegetation: Column) -> Column:
    return F.greatest(vegetation - 1, F.lit(0))


def mean_width(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 2.0 * area / perimeter).otherwise(0.0)


def elongation(area: Column, perimeter: Column) -> Column:
    width = mean_width(area, perimeter)
    return F.when(width > 0, area / (width * width)).otherwise(0.0)


def is_bank(area: Column, perimeter: Column, contact: Column) -> Column:
    shaped = (mean_width(area, perimeter) <= 24) & (elongation(area, perimeter) >= 8)
    return F.when((perimeter > 0) & (contact > 0), shaped & (contact / perimeter >= 0.20) & (area / contact <= 32)).otherwise(False)


def accepts(y: Column, min_y: int | None) -> Column:
    return F.lit(True) if min_y is None else y >= min_y
