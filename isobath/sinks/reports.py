"""JSON reports and scores."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import water


def region_json(regions: DataFrame, limit: int | None = None, area: str = "column_count") -> DataFrame:
    """One JSON object a region, largest first, ties by id; a top-k when limited."""
    ordered = regions.orderBy(F.desc(area), "id")
    return (ordered.limit(limit) if limit else ordered).select(F.to_json(F.struct(*regions.columns)).alias("json"))


def write_region_json(regions: DataFrame, path: str, meta: dict, limit: int | None = None) -> int:
    """The report file {meta..., regions: [...]}; rows are streamed from the executors. Returns the bytes written."""
    with Path(path).open("w") as out:
        out.write(json.dumps(meta)[:-1] + (", " if meta else "") + '"regions": [')
        for k, row in enumerate(region_json(regions, limit).toLocalIterator()):
            out.write((",\n" if k else "\n") + row[0])
        out.write("\n]}\n")
    return Path(path).stat().st_size


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, predicted, n) of rows where both are known."""
    return rows.filter("truth is not null and predicted is not null").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def score(matrix: DataFrame) -> DataFrame:
    """balanced_accuracy (mean recall of the truths) and overall share of hits."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    by = matrix.groupBy("truth").agg(F.sum("n").alias("n"), hit.alias("hit"))
    return by.agg(F.round(F.avg(F.col("hit") / F.col("n")), 9).alias("balanced_accuracy"), F.round(F.sum("hit") / F.sum("n"), 9).alias("overall"))


def human_size(size: int) -> str:
    """Bytes in the largest unit that leaves one or more."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    k = min(max((size.bit_length() - 1) // 10, 0), len(units) - 1)
    return f"{size} B" if not k else f"{size / 1024.0**k:.1f} {units[k]}"


def human_size_of(size: Column) -> Column:
    """human_size as an expression."""
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def summary(counts: dict, chunks: dict[int, int], sea_level: int, files: dict[str, int]) -> str:
    """The lines printed at the end of a run. counts: kind_and_modifier_counts; chunks: by state."""
    seen = sum(chunks.values())
    rows = [("chunks seen", seen), ("chunks fully generated", chunks.get(1, 0) + chunks.get(2, 0)), ("chunks unreadable", chunks.get(-1, 0)), ("chunks with water", chunks.get(2, 0)), ("sea level", sea_level)]
    rows += [(k.replace("_", " "), v) for k, v in counts.items()]
    return "\n".join([*(f"  {k:<24}{v}" for k, v in rows), *(f"  {k:<24}{human_size(v)}" for k, v in files.items())])


def debug_lines(regions: DataFrame, bodies: DataFrame, sheets: DataFrame, unknown: DataFrame) -> list[str]:
    """The largest 8 bodies (component, columns, ocean_columns), the given sheets, 20 unknown biomes and the 15 largest regions; all top-k queries."""
    out = [f"  body {r.columns:>12} columns, {r.ocean_columns} of ocean biomes" for r in bodies.orderBy(F.desc("columns"), "component").limit(8).collect()]
    out += [f"  sheet {r['columns']:>12} columns" for r in sheets.collect()]
    out += [f"  unknown biome {r.biome}" for r in unknown.orderBy("biome").limit(20).collect()]
    top = regions.orderBy(F.desc("column_count"), "id").limit(15).select("id", "kind", "temperature", "vegetation", "depth_class", "column_count", "surface_y", water.modifier_names(F.col("modifiers")).alias("names"))
    for r in top.collect():
        out.append(f"  #{r.id:<6} {water.KINDS[r.kind]:<6} {water.TEMPERATURES[r.temperature]:<7} {water.VEGETATIONS[r.vegetation]:<7} {water.DEPTHS[r.depth_class]:<8} {r.column_count:>12} columns  y={r.surface_y:<4} {'+'.join(r.names)}")
    return out
