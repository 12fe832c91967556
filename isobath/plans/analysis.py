"""The whole analysis: water columns to attributed regions and their runs, ready for the binary file.

Each step is one operator over tables; the few that later steps read more than once are written to the
shared folder. Regions are numbered anew after every step that removes some.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import biomes as biome_functions
from ..functions import blocks, water
from ..operators import contraction, lakes, neighbourhood, regions, runs
from ..options import LakeOptions, Options
from ..session import cut
from ..sources import anvil, waterfile


@dataclass
class Result:
    """Regions and runs; what the reports need beside them."""

    regions: DataFrame
    runs: DataFrame
    sea_level: int
    columns: DataFrame | None = None
    cells: DataFrame | None = None
    biomes: DataFrame | None = None
    chunks: dict[int, int] | None = None
    lakes: dict[str, DataFrame] | None = None
    sources: DataFrame | None = None


def cells_of(columns: DataFrame, biomes: DataFrame, caves_count: bool) -> DataFrame:
    """Cells with counts, biome, chunk flags and the biome's family and temperature (family null: unknown)."""
    marked = columns.withColumn("cave", F.col("covered") if caves_count else F.lit(False))
    named = columns.groupBy(F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")).agg(F.min("biome").alias("biome"), F.bool_or("coral").alias("coral"), F.bool_or("plants").alias("plants"))
    dim = biomes.select(F.col("name").alias("biome"), "family", "water_temperature")
    return regions.aggregate_cells(marked).join(named, ["cx", "cz"]).join(dim, "biome", "left")


def detect_sea_level(columns: DataFrame, biomes: DataFrame) -> int:
    return regions.sea_level(regions.surface_histogram(cells_of(columns, biomes, True))).first().sea_level


def kind_field(columns: DataFrame, cells: DataFrame, options: Options) -> DataFrame:
    """(cx, cz, code): the signature of every classified cell, smoothed; cave cells neither vote nor change."""
    bodies = cut(runs.label(columns.select("x", "z")))
    sized = runs.measures(bodies, "component").filter(F.col("area") >= options.min_water_body).select("component")
    placed = cut(runs.explode_runs(bodies.join(sized, "component")).select("component", "x", "z", F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")))
    hydro = regions.hydro_info(placed.join(cells.select("cx", "cz", "family"), ["cx", "cz"]).withColumn("n", F.lit(1)), "component")
    first = placed.groupBy("cx", "cz").agg(F.min_by("component", (F.col("z").bitwiseAND(F.lit(3)) * 4 + F.col("x").bitwiseAND(F.lit(3)))).alias("component"))
    known = cells.filter(F.col("family").isNotNull())
    as_grid = known.select(F.col("cx").alias("x"), F.col("cz").alias("z"), F.col("family").alias("code"), "water_temperature")
    smooth = cut(neighbourhood.majority(as_grid))
    sheets = cut(regions.ocean_sheets(cells, options.min_sea_body).select("cx", "cz"))
    seeds = sheets.join(known, ["cx", "cz"]).select(F.col("cx").alias("x"), F.col("cz").alias("z"), F.col("water_temperature").alias("ocean_temperature"))
    ocean = neighbourhood.nearest(seeds, 6, "ocean_temperature").drop("distance")
    banks = smooth.filter(F.col("code").isin(blocks.RIVER, blocks.SWAMP)).select("x", "z", F.col("code").alias("fringe"), F.col("water_temperature").alias("fringe_temperature"))
    fringe = neighbourhood.nearest(banks, 2, "fringe", "fringe_temperature").drop("distance")
    rows = (
        smooth.join(ocean, ["x", "z"], "left")
        .join(fringe, ["x", "z"], "left")
        .withColumnsRenamed({"x": "cx", "z": "cz", "code": "smooth_family"})
        .join(known.select("cx", "cz", "water_cols", "ice_cols", "cave_cols"), ["cx", "cz"])
        .join(first, ["cx", "cz"])
        .join(hydro, "component")
        .join(sheets.withColumn("sheet", F.lit(True)), ["cx", "cz"], "left")
    )
    half = lambda c: (F.col(c) > 0) & (F.col(c) * 2 >= F.col("water_cols"))
    cave = half("cave_cols")
    kind = water.column_kind(F.col("smooth_family"), F.col("ocean_columns"), F.col("columns"), F.col("ocean_temperature").isNotNull(), F.col("fringe"), cave, F.coalesce("sheet", F.lit(False)), options.min_sea_body)
    rows = rows.withColumn("kind", kind)
    temperature = water.column_temperature(F.col("smooth_family"), F.col("kind"), F.col("water_temperature"), F.col("ocean_temperature"), F.col("fringe_temperature"))
    coded = rows.select(F.col("cx").alias("x"), F.col("cz").alias("z"), water.signature(F.col("kind"), temperature, half("ice_cols"), cave).alias("code"), cave.alias("still"))
    return neighbourhood.majority(coded, frozen="still").select(F.col("x").alias("cx"), F.col("z").alias("cz"), "code")


def analyze(columns: DataFrame, biomes: DataFrame, options: Options, caves_count: bool = False, arid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions, runs) of water columns: id, kind, attributes; id, z, x0, x1. arid: cells of arid dry land."""
    columns = cut(columns)
    cells = cut(cells_of(columns, biomes, caves_count))
    field = cut(kind_field(columns, cells, options))
    coded = columns.select("x", "z", F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")).join(field, ["cx", "cz"]).select("x", "z", "code")
    pieces = cut(runs.canonical(runs.label(coded, "code")))
    parts = water.unpack_signature(F.col("code"))
    nodes = pieces.groupBy("id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("size"), F.first("code").alias("code")).select("id", "size", parts.kind.alias("kind"), parts.cave.alias("cave"), "code")
    nodes = cut(nodes)
    group = cut(contraction.absorb_regions(nodes.drop("code"), runs.adjacency(pieces, "id"), options.min_water_body))
    own = cut(runs.coalesce_runs(pieces.drop("code").join(group.select("id", "group"), "id").drop("id").withColumnRenamed("group", "id"), "id"))
    heads = group.select(F.col("group").alias("id"), F.col("donor")).distinct().join(nodes.select(F.col("id").alias("donor"), "code"), "donor").select("id", parts.kind.alias("kind"), parts.temperature.alias("temperature"))
    sums = cut(regions.accumulate(own, cells, biomes, arid=arid))
    final = cut(regions.finalize(sums.join(heads, "id")))
    shaped = cut(regions.shape_correct(final.select("id", "kind", F.col("modifiers").bitwiseAND(F.lit(16)).cast("boolean").alias("cave")), own))
    merged = cut(contraction.consolidate_regions(shaped.join(sums.select("id", F.col("columns").alias("size")), "id").select("id", "size", "kind", "cave"), runs.adjacency(own, "id"), options.min_river_merge, options.min_sea_merge))
    own = cut(runs.coalesce_runs(own.join(merged, "id").drop("id").withColumnRenamed("root", "id"), "id"))
    total = regions.merge_sums(sums.join(merged, "id").drop("id").withColumnRenamed("root", "id"), "id")
    kinds = shaped.select("id", F.col("kind"))
    again = regions.finalize(total.join(kinds, "id").join(heads.select("id", "temperature"), "id"))
    # vegetation and modifiers stay those of the root
    whole = again.drop("vegetation", "modifiers").join(final.select("id", "vegetation", "modifiers"), "id")
    least = F.when(F.col("modifiers").bitwiseAND(F.lit(16)) != 0, options.min_cave_body).otherwise(options.min_water_body)
    kept = cut(runs.number_in_order(whole.filter(F.col("columns") >= least), ["id"], "new_id"))
    kept_runs = cut(own.join(kept.select("id", "new_id"), "id").select(F.col("new_id").alias("id"), "z", "x0", "x1"))
    return bounded(kept.drop("id").withColumnRenamed("new_id", "id"), kept_runs), kept_runs


def bounded(regions_: DataFrame, own: DataFrame) -> DataFrame:
    """Regions with the bounds and the area of their runs."""
    box = runs.measures(own, "id").drop("runs").withColumnRenamed("area", "column_count")
    return regions_.drop("min_x", "min_z", "max_x", "max_z", "column_count").join(box, "id")


def roofed(regions_: DataFrame, own: DataFrame, columns: DataFrame) -> DataFrame:
    """Regions with the cave bit set where half of their columns or more lie under a roof."""
    under = regions.coverage(own, columns.filter("covered")).select("id", F.col("cave").alias("roofed"))
    bits = F.col("modifiers").bitwiseOR(F.when(F.col("roofed"), 16).otherwise(0))
    return regions_.join(under, "id").withColumn("modifiers", bits).drop("roofed")


def lake_step(found: DataFrame, own: DataFrame, cells: DataFrame, ground: DataFrame, options: LakeOptions) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(regions, runs, tables of the lake analysis) after rivers and lakes are told apart by their shape."""
    tables = lakes.analyze(found, own, cells, ground, options)
    divided, pieces = lakes.apply(found, own, tables["columns"])
    return bounded(divided, cut(pieces)), pieces, tables


def run(spark: SparkSession, options: Options) -> Result:
    """Read the world for the sea level, again above the cutoff, and analyse; lakes and roofs come last, as the options say."""
    lake_options = LakeOptions.load(options.lake_config) if options.lake_config else LakeOptions()
    packs = [str(p) for p in (anvil.world_root(options.world) / "datapacks").glob("*")] if "://" not in options.world else []
    biomes = cut(biome_functions.biome_table(spark, packs))
    cutoff = options.height_cutoff
    level = options.sea_level
    if level is None:
        level = detect_sea_level(anvil.scan_world(spark, options.world, caves=options.include_deep_caves), biomes)
    read = anvil.scan(spark, options.world, caves=not options.no_caves, min_y=None if cutoff is None else level - cutoff)
    columns, caves_count = read["columns"], cutoff is None
    found, own = analyze(columns, biomes, options, caves_count=caves_count, arid=regions.dryland(read["surface"], biomes))
    cells = cut(cells_of(columns, biomes, caves_count))
    tables, sources = None, found
    if not options.no_lake_detection:
        found, own, tables = lake_step(found, own, cells, read["ground"], lake_options)
    if not caves_count:
        found = roofed(found, own, columns)
    chunks = {r.state: r.n for r in read["chunks"].collect()}
    return Result(cut(found), own, level, columns, cells, biomes, chunks, tables, sources)


def world_bounds(spark: SparkSession, world: str) -> tuple[int, int, int, int]:
    """Columns that the region files of a world span: min_x, min_z, max_x, max_z."""
    box = anvil.tiles(spark, world).agg(F.min("rx"), F.min("rz"), F.max("rx"), F.max("rz")).first()
    return (0, 0, 0, 0) if box[0] is None else (box[0] * 512, box[1] * 512, box[2] * 512 + 511, box[3] * 512 + 511)


def write(result: Result, path: str, data_version: int = 0, bounds: tuple[int, int, int, int] | None = None) -> int:
    """Write the binary file and check it by reading it again; returns its bytes. Without bounds those of the water, by whole files, are taken."""
    if bounds is None:
        box = result.runs.agg(F.min("x0"), F.min("z"), F.max("x1"), F.max("z")).first()
        low = [int(v) >> 9 << 9 for v in box[:2]] if box[0] is not None else [0, 0]
        high = [(int(v) >> 9 << 9) + 511 for v in box[2:]] if box[0] is not None else [0, 0]
        bounds = (*low, *high)
    named = result.regions.select([F.col(c.split()[0]) for c in waterfile.REGION.split(", ")])
    size = waterfile.write_file(path, named, result.runs, bounds, sea_level=result.sea_level, data_version=data_version)
    waterfile.verify(path, named, result.runs, result.sea_level)
    return size
