"""python -m isobath --world FOLDER: analyse a world and write its region file, reports and maps."""

from __future__ import annotations

import argparse
import time
from dataclasses import fields
from pathlib import Path

from pyspark.sql import functions as F

from .functions import biomes as biome_functions
from .operators import lakes, regions, runs
from .options import LakeOptions, Options
from .plans import analysis
from .session import session
from .sinks import lake_layers, painters, reports
from .sources import anvil


def options(argv: list[str] | None = None) -> Options:
    parser = argparse.ArgumentParser(prog="isobath")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(flag, action="store_true")
        elif f.name == "world":
            parser.add_argument(flag, required=True)
        else:
            parser.add_argument(flag, type=int if "int" in str(f.type) else str, default=f.default)
    return Options(**vars(parser.parse_args(argv)))


def write_maps(spark, chosen: Options, result: analysis.Result, folder: str, bounds: tuple[int, int, int, int]) -> dict[str, int]:
    tiles = anvil.tiles(spark, chosen.world)
    return painters.render(folder, result.regions, result.runs, result.cells, tiles, result.columns.filter("covered").select("x", "z"), bounds, result.sea_level, chosen.map_scale, chosen.ocean_map_min_area)


def debug_report(result: analysis.Result, chosen: Options) -> list[str]:
    """What --debug prints: largest bodies and sheets, unknown biomes, largest regions."""
    cells = result.cells
    placed = runs.label(result.columns.select("x", "z"))
    counted = regions.segments(placed, "component").join(cells.select("cx", "cz", "family"), ["cx", "cz"])
    bodies = regions.hydro_info(counted, "component")
    sheets = regions.largest_sheets(regions.ocean_sheets(cells, chosen.min_sea_body))
    return reports.debug_lines(result.regions, bodies, sheets, biome_functions.unknown_biomes(cells, result.biomes))


def main(argv: list[str] | None = None) -> dict[str, int]:
    """Run, and return the bytes of the files written."""
    chosen = options(argv)
    begin = time.perf_counter()
    spark = session(master=f"local[{chosen.threads}]" if chosen.threads else None)
    result = analysis.run(spark, chosen)
    out = Path(chosen.output)
    out.mkdir(parents=True, exist_ok=True)
    bounds = analysis.world_bounds(spark, chosen.world)
    files = {"water_regions.bin": analysis.write(result, str(out / "water_regions.bin"), anvil.level_info(chosen.world)["data_version"], bounds)}
    if chosen.export_json:
        files["water_regions.json"] = reports.write_region_json(result.regions, str(out / "water_regions.json"), {"sea_level": result.sea_level}, chosen.json_limit)
    if chosen.export_map:
        files.update(write_maps(spark, chosen, result, str(out), bounds))
    if chosen.lake_debug and result.lakes:
        wet = result.lakes["columns"].select("x", "z")
        lake_layers.write(str(out / "lakes"), result.lakes, lakes.evidence(wet), result.sources, bounds, chosen.map_scale, LakeOptions.load(chosen.lake_config) if chosen.lake_config else LakeOptions())
    counts = {"water regions": result.regions.count(), **regions.kind_and_modifier_counts(result.regions, chosen.min_river_merge, chosen.min_sea_merge).first().asDict(), "geometry runs": result.runs.agg(F.count("*")).first()[0]}
    print(reports.summary(counts, result.chunks, result.sea_level, files))
    if chosen.debug:
        print("\n".join(debug_report(result, chosen)))
    print(f"  {time.perf_counter() - begin:.1f} seconds")
    return files


if __name__ == "__main__":
    main()
