"""Six maps of a world: every layer is a table of pixels, a later layer wins, and the bounded image is made on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colours, water
from ..operators.contraction import sieve
from ..session import cut
from . import legend, maps

TILE = 512


@dataclass(frozen=True)
class Projection:
    """World columns to pixels; margin: pixels of the legend left of the map."""

    min_x: int
    min_z: int
    max_x: int
    max_z: int
    scale: int = 8
    margin: int = 0

    @property
    def size(self) -> tuple[int, int]:
        return (self.max_x - self.min_x) // self.scale + 1, (self.max_z - self.min_z) // self.scale + 1

    def px(self, x: str) -> Column:
        return F.expr(f"cast(greatest(({x} - ({self.min_x})) div {self.scale}, 0) as int)")

    def pz(self, z: str) -> Column:
        return F.expr(f"cast(greatest(({z} - ({self.min_z})) div {self.scale}, 0) as int)")


def run_pixels(runs: DataFrame, p: Projection) -> DataFrame:
    """Runs, each once for every pixel it meets: px, pz, and the part of the run in the pixel (a0, a1)."""
    spread = runs.withColumn("px", F.explode(F.sequence(p.px("x0"), p.px("x1")))).withColumn("pz", p.pz("z"))
    left = F.col("px") * p.scale + p.min_x
    return spread.withColumns({"a0": F.greatest("x0", left), "a1": F.least("x1", left + p.scale - 1)})


def rectangles(boxes: DataFrame, p: Projection, *carry: str) -> DataFrame:
    """Pixels (px, pz) of boxes (x0, z0, x1, z1), with carried columns."""
    wide = boxes.select(*carry, "z0", "z1", F.explode(F.sequence(p.px("x0"), p.px("x1"))).alias("px"))
    return wide.select(*carry, "px", F.explode(F.sequence(p.pz("z0"), p.pz("z1"))).alias("pz"))


def land(tiles: DataFrame, p: Projection) -> DataFrame:
    """(px, pz, color) of all pixels of the tiles (rx, rz) that exist."""
    boxes = tiles.select((F.col("rx") * TILE).alias("x0"), (F.col("rz") * TILE).alias("z0"), (F.col("rx") * TILE + TILE - 1).alias("x1"), (F.col("rz") * TILE + TILE - 1).alias("z1"))
    return rectangles(boxes, p).distinct().withColumn("color", F.lit(colours.LAND))


def last(pixels: DataFrame, value: Column, *order: str) -> DataFrame:
    """(px, pz, color): the last writer in the stated order."""
    return pixels.groupBy("px", "pz").agg(F.max_by(value, F.struct(*order)).alias("color"))


def classification(runs: DataFrame, p: Projection) -> DataFrame:
    """Regions by kind, temperature, depth and vegetation, with the textures of their modifiers. runs: with the regions' columns."""
    pixels = run_pixels(runs, p)
    shown = F.coalesce(colours.texture(F.col("modifiers"), F.col("px") + p.margin, F.col("pz")), colours.region_color(F.col("kind"), F.col("temperature"), F.col("depth_class"), F.col("vegetation")))
    return last(pixels.withColumn("shown", shown), F.col("shown"), "id", "z", "x0")


def numbered(runs: DataFrame, p: Projection) -> DataFrame:
    return last(run_pixels(runs, p), colours.id_color(F.col("id")), "id", "z", "x0")


def depths(cells: DataFrame, p: Projection) -> DataFrame:
    """Measured depth of every cell (cx, cz, water_cols, cave_cols, depth) without a cave majority."""
    open_ = cells.filter((F.col("water_cols") > 0) & (F.col("cave_cols") * 2 < F.col("water_cols")))
    boxes = open_.select("cx", "cz", "depth", (F.col("cx") * 4).alias("x0"), (F.col("cz") * 4).alias("z0"), (F.col("cx") * 4 + 3).alias("x1"), (F.col("cz") * 4 + 3).alias("z1"))
    at = lambda c, s: F.shiftright(c, s)
    ordered = rectangles(boxes, p, "cx", "cz", "depth").withColumn("order", F.struct(at("cz", 7), at("cx", 7), at("cz", 2), at("cx", 2), F.col("cz"), F.col("cx")))
    return ordered.groupBy("px", "pz").agg(F.max_by(colours.depth_color(F.col("depth")), "order").alias("color"))


def ocean_pixels(runs: DataFrame, cells: DataFrame, p: Projection) -> DataFrame:
    """(px, pz, code, weight): temperature and shelf or basin of seas, and the water columns of the pixel."""
    pixels = run_pixels(runs.filter(F.col("kind") == water.SEA), p)
    sampled = pixels.withColumns({"cx": F.shiftright("a0", 2), "cz": F.shiftright("z", 2)}).join(cells.select("cx", "cz", "depth"), ["cx", "cz"], "left")
    coded = sampled.withColumn("code", colours.ocean_code(F.col("temperature"), F.col("depth")))
    return coded.groupBy("px", "pz").agg(F.max_by("code", F.struct("id", "z", "x0")).alias("code"), F.sum((F.col("a1") - F.col("a0") + 1).cast("long")).alias("weight"))


def ocean(runs: DataFrame, cells: DataFrame, p: Projection, min_area: int) -> DataFrame:
    """Seas in six colours; patches of fewer columns than min_area are joined to their neighbours, lone ones left out."""
    pixels = ocean_pixels(runs, cells, p)
    kept = sieve(cut(pixels), min_area) if min_area else pixels
    return kept.select("px", "pz", colours.ocean_color(F.col("code")).alias("color"))


def inland(runs: DataFrame, p: Projection, with_sea: bool = True) -> DataFrame:
    """Sea as a backdrop (or left out), then lakes, rivers and swamps over each other."""
    rank = F.when(F.col("kind") == water.SEA, 0).when(F.col("kind") == water.LAKE, 1).when(F.col("kind") == water.RIVER_KIND, 2).otherwise(3)
    rows = runs if with_sea else runs.filter(F.col("kind") != water.SEA)
    return last(run_pixels(rows, p).withColumn("rank", rank), colours.inland_color(F.col("kind"), F.col("modifiers")), "rank", "id", "z", "x0")


def over(below: DataFrame, above: DataFrame) -> DataFrame:
    """Pixels of both layers, the upper one's where both have one."""
    both = below.withColumn("layer", F.lit(0)).unionByName(above.withColumn("layer", F.lit(1)))
    return both.groupBy("px", "pz").agg(F.max_by("color", "layer").alias("color"))


def overview_textures(runs: DataFrame, covered: DataFrame, shown: DataFrame, p: Projection) -> DataFrame:
    """(px, pz, color) of corals, ice and roofs where a region's own colour is what a pixel shows; one open column leaves a pixel without roof dots.

    covered: columns (x, z) under a roof.
    """
    pixels = run_pixels(runs, p).withColumn("base", colours.inland_color(F.col("kind"), F.col("modifiers")))
    seen = pixels.join(shown, ["px", "pz"]).filter((F.col("color") == F.col("base")) | ((F.col("kind") == water.SEA) & F.col("color").isin(list(colours.OCEAN_COLORS))))
    wet = seen.groupBy("px", "pz").agg(F.bit_or(F.col("modifiers").bitwiseAND(F.lit(colours.CORALS | colours.ICE))).alias("bits"), F.sum((F.col("a1") - F.col("a0") + 1).cast("long")).alias("columns"))
    # a covered column counts where the run that holds it is seen
    inside = seen.select("px", "pz", "z", "a0", "a1").join(covered.select(F.col("x").alias("cx"), F.col("z").alias("cz"), p.px("x").alias("px"), p.pz("z").alias("pz")), ["px", "pz"]).filter("cz = z and cx between a0 and a1")
    roofs = inside.groupBy("px", "pz").agg(F.count("*").alias("roofed"))
    bits = F.col("bits").bitwiseOR(F.when(F.coalesce("roofed", F.lit(0)) == F.col("columns"), colours.CAVE).otherwise(0))
    drawn = wet.join(roofs, ["px", "pz"], "left").withColumn("color", colours.texture(bits, F.col("px") + p.margin, F.col("pz"), all_of_them=False))
    return drawn.filter("color is not null").select("px", "pz", "color")


def render(folder: str, regions: DataFrame, runs: DataFrame, cells: DataFrame, tiles: DataFrame, covered: DataFrame, bounds: tuple[int, int, int, int], sea_level: int, scale: int = 8, ocean_min_area: int = 10_000) -> dict[str, int]:
    """Write the six maps with their legends; bytes of each."""
    counts = {r.kind: r.n for r in regions.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    legends = legend.legends(counts, sea_level, scale, ocean_min_area)
    p = Projection(*bounds, scale)
    size = legend.scale_for(p.size[1], max(map(len, legends.values())))
    margin = max(legend.width(rows, size) for rows in legends.values())
    p = Projection(*bounds, scale, margin)
    wide, high = p.size
    if (wide + margin) * high > maps.MAX_PIXELS:
        raise ValueError("the map has too many pixels; take a larger scale")
    full = cut(runs.join(regions.select("id", "kind", "temperature", "vegetation", "depth_class", "modifiers"), "id"))
    ground, seas = cut(land(tiles, p)), cut(ocean(full, cells, p, ocean_min_area))
    inner = cut(inland(full, p))
    both = cut(over(inland(full, p, with_sea=False), seas))
    layers = {
        "water_map": over(ground, classification(full, p)),
        "water_regions_map": over(ground, numbered(full, p)),
        "water_depth_map": over(ground, depths(cells, p)),
        "water_ocean_map": over(ground, seas),
        "water_inland_map": over(over(ground, inner), overview_textures(full, covered, inner, p)),
        "water_combined_map": over(over(ground, both), overview_textures(full, covered, both, p)),
    }
    out, height = {}, max(high, *(legend.height(rows, size) for rows in legends.values()))
    for name, pixels in layers.items():
        image = np.zeros((height, margin + wide, 3), np.uint8)
        image[:] = [colours.VOID >> s & 255 for s in (16, 8, 0)]
        image[:high, margin:] = maps.canvas(pixels, wide, high, background=colours.VOID)
        legend.draw(image, legends[name], margin, size)
        raw = maps.png(image)
        (Path(folder) / f"{name}.png").write_bytes(raw)
        out[f"{name}.png"] = len(raw)
    return out
