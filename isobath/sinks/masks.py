"""Agreement of maps with a painted mask: images become pixel tables, and everything else is joins and counts."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maps
from ..sources import waterfile

# Colours of river (1) and lake (2) pixels of maps, now and in earlier maps, and of the default brushes.
PALETTES = {
    "current": {0x99CACD: 1, 0xEAD7A0: 1, 0x64BED3: 2, 0xD8A27D: 2},
    "legacy": {0x64BED3: 1, 0x4FC4C1: 1, 0x3AE1CD: 1, 0xEAD7A0: 1, 0x99CACD: 2, 0xD8A27D: 2, 0xCBB984: 2},
}
BRUSHES = {1: 0x3AE1CD, 2: 0x99CACD}


def brush(text: str) -> int:
    """A colour of six hexadecimal digits, with or without #."""
    digits = text.removeprefix("#")
    if len(digits) != 6 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError("a brush colour has six hexadecimal digits, as in ff0000")
    return int(digits, 16)


def image_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(px, pz, color, alpha) of a PNG, and its width and height; the image is bounded by maps.MAX_PIXELS."""
    image = maps.read_png(Path(path).read_bytes(), alpha=True)
    high, wide, _ = image.shape
    if high * wide > maps.MAX_PIXELS:
        raise ValueError("the image has too many pixels")
    z, x = np.divmod(np.arange(high * wide), wide)
    flat = image.reshape(-1, 4).astype(np.int32)
    table = pa.table({"px": pa.array(x.astype(np.int32)), "pz": pa.array(z.astype(np.int32)), "color": pa.array(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]), "alpha": pa.array(flat[:, 3])})
    return spark.createDataFrame(table), wide, high


def classes(color: Column, palette: dict[int, int]) -> Column:
    """1 for river, 2 for lake, 0 for other colours."""
    out = F.lit(0)
    for value, label in palette.items():
        out = F.when(color == value, label).otherwise(out)
    return out


def painted(pixels: DataFrame, brushes: dict[int, int] | None = None) -> DataFrame:
    """(px, pz, truth) of the pixels (px, pz, color, alpha) that a brush has touched."""
    label = classes(F.col("color"), {c: k for k, c in (brushes or BRUSHES).items()})
    return pixels.filter("alpha > 0").select("px", "pz", label.alias("truth")).filter("truth > 0")


def compared(mask: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(px, pz, truth, predicted) of painted pixels that are inland water in the reference; a candidate without water there predicts 0.

    mask: (px, pz, truth); reference and candidate: (px, pz, class).
    """
    known = reference.filter(F.col("class") > 0).select("px", "pz")
    valid = mask.filter("truth > 0").join(known, ["px", "pz"], "left_semi")
    return valid.join(candidate.select("px", "pz", F.col("class").alias("predicted")), ["px", "pz"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of counts, recalls and accuracies of (truth, predicted)."""
    n = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("predicted") == p))
    counts = rows.agg(F.count("*").alias("sample_count"), n(1, 1).alias("river_as_river"), n(1, 2).alias("river_as_lake"), n(2, 1).alias("lake_as_river"), n(2, 2).alias("lake_as_lake"), F.count_if((F.col("truth") > 0) & (F.col("predicted") == 0)).alias("unavailable_predictions"), F.count_if(F.col("truth") == 1).alias("_rivers"), F.count_if(F.col("truth") == 2).alias("_lakes"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    named = counts.withColumns({"river_recall": share("river_as_river", "_rivers"), "lake_recall": share("lake_as_lake", "_lakes")})
    return named.withColumns({"balanced_accuracy": (F.col("river_recall") + F.col("lake_recall")) / 2, "accuracy": F.when(F.col("sample_count") > 0, (F.col("river_as_river") + F.col("lake_as_lake")) / F.col("sample_count"))}).drop("_rivers", "_lakes")


def report(spark: SparkSession, mask: str, reference: str, reference_data: str, maps_: list[str], scale: int = 8, brushes: dict[int, int] | None = None, reference_palette: str = "current", map_palette: str = "current", output: str | None = None) -> dict:
    """The score of candidate maps against a mask, all of one size and projection; written as JSON if output is given."""
    brushes = brushes or BRUSHES
    if scale <= 0 or len(set(brushes.values())) < 2:
        raise ValueError("the scale must be positive and the brushes must differ")
    x0, z0, x1, z1 = waterfile.WaterFile(Path(reference_data).read_bytes()).bounds
    wide, high = (x1 - x0) // scale + 1, (z1 - z0) // scale + 1
    base, w, h = image_pixels(spark, reference)
    panel = w - wide
    if panel < 0 or h < high:
        raise ValueError("the reference image disagrees with the bounds and the scale")
    of = lambda pixels, palette: pixels.filter(F.col("px") >= panel).select("px", "pz", classes(F.col("color"), PALETTES[palette]).alias("class"))
    paint, mw, mh = image_pixels(spark, mask)
    if (mw, mh) != (w, h):
        raise ValueError("mask and reference must be of one size")
    truth = painted(paint, brushes).cache()
    valid = compared(truth, of(base, reference_palette), of(base, reference_palette))
    if valid.isEmpty():
        raise ValueError("no painted pixel lies on inland water of the reference")
    counts = metrics(valid).first().asDict()
    out = {"sample_count": counts["sample_count"], "ignored_paint_outside_inland_water": truth.count() - counts["sample_count"], "brush_colors": {str(k): f"{c:06x}" for k, c in brushes.items()}, "projection": {"legend_width": panel, "blocks_per_pixel": scale, "world_bounds": [x0, z0, x1, z1]}, "results": []}
    for path in maps_:
        pixels, cw, ch = image_pixels(spark, path)
        if (cw, ch) != (w, h):
            raise ValueError(f"{path} is of another size")
        out["results"].append({"map": Path(path).as_posix(), **metrics(compared(truth, of(base, reference_palette), of(pixels, map_palette))).first().asDict()})
    truth.unpersist()
    if output:
        Path(output).write_text(json.dumps(out, indent=2) + "\n")
    return out
