"""Every raster, region and serving query over the demonstration rasters, each with SQL that says what it returns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import biomes, blocks, water
from ..operators import contraction, neighbourhood, regions, runs
from ..session import cut, ensure_checkpoint_folder
from . import demo

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        text = None if sql is None else f"WITH {'RECURSIVE ' if recursive else ''}{demo.SQL.strip()}{sql}"
        _ALL[f.__name__] = (f, text)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}


# ---- runs, contacts, components ---------------------------------------------------

_RUNS = """, island AS (SELECT status, z, x, x - row_number() OVER (PARTITION BY status, z ORDER BY x) AS i FROM grid),
runs AS (SELECT status, z, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM island GROUP BY status, z, i)"""

_LABELS = """, cells AS (SELECT CAST(z AS BIGINT) * 4294967296 + x AS id, x, z, status FROM grid),
links AS (SELECT a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.status = b.status AND ((b.z = a.z AND (b.x = a.x + 1 OR b.x = a.x - 1)) OR (b.x = a.x AND (b.z = a.z + 1 OR b.z = a.z - 1)))),
cc(id, component) USING KEY (id) AS (
  SELECT id, id AS component FROM cells
  UNION
  SELECT l.b AS id, min(c.component) AS component FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.component < r.component GROUP BY l.b
), labelled AS (SELECT c.component, k.x, k.z, k.status FROM cc c JOIN cells k ON k.id = c.id)"""

_CANON = """, firsts AS (SELECT component, min(row(z >> 9, x >> 9, z, x)) AS f FROM labelled GROUP BY component),
numbered AS (SELECT component, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS id FROM firsts)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.label(demo.raster(spark, sf_dir).select("x", "z", "status"), "status")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.canonical(_labelled(spark, sf_dir))


@query(_RUNS + " SELECT * FROM runs")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.encode(demo.raster(spark, sf_dir), "status")


@query(_RUNS + " SELECT status, z, CAST(min(x0) AS INTEGER) AS x0, CAST(max(x1) AS INTEGER) AS x1 FROM (SELECT *, sum(g) OVER (PARTITION BY status, z ORDER BY x0) AS p FROM (SELECT status, z, x0, x1, CASE WHEN x0 <= max(x1) OVER (PARTITION BY status, z ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS g FROM (SELECT status, CAST(floor(z / 2) * 2 AS INTEGER) AS z, x0, x1 FROM runs))) GROUP BY status, z, p")
def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = runs.encode(demo.raster(spark, sf_dir), "status").withColumn("z", F.shiftleft(F.shiftright("z", 1), 1))
    return runs.coalesce_runs(folded, "status")


@query(" SELECT least(a.status, b.status) AS a, greatest(a.status, b.status) AS b, count(*) AS w FROM grid a JOIN grid b ON a.status <> b.status AND ((b.z = a.z AND b.x = a.x + 1) OR (b.x = a.x AND b.z = a.z + 1)) GROUP BY 1, 2")
def run_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.adjacency(runs.encode(demo.raster(spark, sf_dir), "status"), "status")


@query(_LABELS + " SELECT status, component, count(*) AS area FROM labelled GROUP BY status, component", recursive=True)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("status", "component").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"))


@query(_LABELS + _CANON + " SELECT id, min(status) AS status, count(*) AS area, min(x) AS min_x, min(z) AS min_z, max(x) AS max_x, max(z) AS max_z FROM labelled JOIN numbered USING (component) GROUP BY id", recursive=True)
def component_bbox_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _regions(spark, sf_dir)
    return runs.measures(own).drop("runs").join(own.groupBy("id").agg(F.first("status").alias("status")), "id")


_PERIMETER = _LABELS + ", sides AS (SELECT l.component, count(*) AS area, sum(4 - (SELECT count(*) FROM links k WHERE k.a = CAST(l.z AS BIGINT) * 4294967296 + l.x)) AS perimeter FROM labelled l GROUP BY l.component)"


@query(_PERIMETER + " SELECT component, area, CAST(perimeter AS BIGINT) AS perimeter FROM sides", recursive=True)
def component_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.perimeters(_labelled(spark, sf_dir), "component")


@query(_PERIMETER + " SELECT component, round(2.0 * area / perimeter, 6) AS mean_width, round(area / ((2.0 * area / perimeter) * (2.0 * area / perimeter)), 6) AS elongation, 2.0 * area / perimeter <= 24 AND area / ((2.0 * area / perimeter) * (2.0 * area / perimeter)) >= 8 AND (area // 2) / perimeter >= 0.2 AND area // 2 > 0 AND area / nullif(area // 2, 0) <= 32 AS bank FROM sides", recursive=True)
def shape_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, edge = F.col("area"), F.col("perimeter")
    half = F.expr("area div 2")
    return runs.perimeters(_labelled(spark, sf_dir), "component").select("component", F.round(water.mean_width(area, edge), 6).alias("mean_width"), F.round(water.elongation(area, edge), 6).alias("elongation"), water.is_bank(area, edge, half).alias("bank"))


@query(_LABELS + " SELECT status, component, area FROM (SELECT *, row_number() OVER (ORDER BY area DESC, component) AS k FROM (SELECT status, component, count(*) AS area FROM labelled GROUP BY status, component)) WHERE k <= 24", recursive=True)
def topn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).orderBy(F.desc("area"), "component").limit(24)


@query(_LABELS + _CANON + ", n AS (SELECT count(*) AS n FROM numbered) SELECT id FROM numbered, n WHERE id % greatest(1, n // 64) = 0", recursive=True)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _regions(spark, sf_dir).select("id").distinct()
    return ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).filter("id % greatest(1, n div 64) = 0").select("id")


# ---- neighbourhoods ---------------------------------------------------------------


@query("""), nb AS (SELECT a.x, a.z, a.status AS own, b.status AS vote, (b.z - a.z) * 3 + b.x - a.x AS pos FROM wet2 a JOIN wet2 b ON abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1),
v AS (SELECT x, z, own, vote, count(*) AS n, min(pos) AS pos FROM nb GROUP BY ALL), o AS (SELECT x, z, n FROM v WHERE own = vote),
b AS (SELECT v.x, v.z, v.own, arg_max(v.vote, row(v.n, -v.pos)) AS best, max(v.n) AS most FROM v GROUP BY v.x, v.z, v.own)
SELECT b.x, b.z, CASE WHEN b.most > o.n THEN b.best ELSE b.own END AS code FROM b JOIN o USING (x, z)""".replace("), nb", ", wet2 AS (SELECT x, z, status FROM grid), nb", 1))
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = demo.raster(spark, sf_dir).select("x", "z", F.col("status").alias("code"))
    return neighbourhood.majority(cells)


_SEEDS = ", seeds AS (SELECT x, z, customer FROM grid WHERE customer % 37 = 0)"


@query(_SEEDS + " SELECT g.x, g.z, CAST(min(greatest(abs(g.x - s.x), abs(g.z - s.z))) AS INTEGER) AS distance FROM wet g JOIN seeds s ON abs(g.x - s.x) <= 6 AND abs(g.z - s.z) <= 6 GROUP BY g.x, g.z")
def nearest_feature_cheb(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = demo.raster(spark, sf_dir).filter("customer % 37 = 0")
    return neighbourhood.nearest(seeds, 6).join(demo.water(spark, sf_dir).select("x", "z"), ["x", "z"]).select("x", "z", "distance")


@query(_SEEDS + " SELECT x, z, CAST(distance AS INTEGER) AS distance, customer_no FROM (SELECT g.x, g.z, greatest(abs(g.x - s.x), abs(g.z - s.z)) AS distance, s.customer AS customer_no, row_number() OVER (PARTITION BY g.x, g.z ORDER BY greatest(abs(g.x - s.x), abs(g.z - s.z)), s.z, s.x) AS k FROM wet g JOIN seeds s ON abs(g.x - s.x) <= 2 AND abs(g.z - s.z) <= 2) WHERE k = 1")
def nearest_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = demo.raster(spark, sf_dir).filter("customer % 37 = 0").withColumn("customer_no", F.col("customer"))
    return neighbourhood.nearest(seeds, 2, "customer_no").join(demo.water(spark, sf_dir).select("x", "z"), ["x", "z"])


@query(" SELECT w.x, w.z, w.biome <> 'minecraft:desert' AND EXISTS (SELECT 1 FROM grid d WHERE d.biome = 'minecraft:desert' AND abs(d.x - w.x) <= 4 AND abs(d.z - w.z) <= 4) AS near_only FROM wet w")
def dryland_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = demo.raster(spark, sf_dir)
    near = neighbourhood.nearest(grid.filter("biome = 'minecraft:desert'"), 4).select("x", "z", F.lit(True).alias("near"))
    return grid.filter("status = 'O'").join(near, ["x", "z"], "left").select("x", "z", (F.coalesce("near", F.lit(False)) & (F.col("biome") != "minecraft:desert")).alias("near_only"))


@query(""", m AS (SELECT x, z FROM grid WHERE status IN ('O', 'P')),
dry AS (SELECT x, z FROM (SELECT unnest(range(-66, 66)) AS x) CROSS JOIN (SELECT unnest(range((SELECT min(z) FROM grid) - 2, (SELECT max(z) FROM grid) + 3)) AS z) ANTI JOIN m USING (x, z))
SELECT m.x, m.z, CAST(min(abs(m.x - d.x) + abs(m.z - d.z)) AS INTEGER) AS distance FROM m JOIN dry d ON abs(m.x - d.x) <= 12 AND abs(m.z - d.z) <= 12 GROUP BY m.x, m.z""")
def manhattan_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.shore_distance(demo.water(spark, sf_dir, "O", "P"))


@query(" SELECT a.x, a.z, CAST((count(*) * 255 + 144) // 289 AS INTEGER) AS d8 FROM wet a JOIN wet b ON abs(a.x - b.x) <= 8 AND abs(a.z - b.z) <= 8 GROUP BY a.x, a.z")
def box_density_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.density(demo.water(spark, sf_dir), (8,))


_CORE = """, c8 AS (SELECT a.x, a.z, (count(*) * 255 + 144) // 289 AS d FROM wet a JOIN wet b ON abs(a.x - b.x) <= 8 AND abs(a.z - b.z) <= 8 GROUP BY a.x, a.z),
core AS (SELECT CAST(z AS BIGINT) * 4294967296 + x AS id, x, z FROM c8 WHERE CAST(d AS FLOAT) / CAST(255.0 AS FLOAT) >= CAST(0.35 AS FLOAT)),
links AS (SELECT a.id AS a, b.id AS b FROM core a JOIN core b ON abs(a.x - b.x) + abs(a.z - b.z) = 1),
cc(id, component) USING KEY (id) AS (SELECT id, id AS component FROM core UNION SELECT l.b AS id, min(c.component) AS component FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.component < r.component GROUP BY l.b)
SELECT component, count(*) AS core_area, count(*) < 8 AS too_small FROM cc GROUP BY component"""


@query(_CORE, recursive=True)
def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores by density alone: the sparse demonstration raster has no broad water."""
    dense = neighbourhood.density(demo.water(spark, sf_dir), (8,)).filter((F.col("d8").cast("float") / F.lit(255.0).cast("float")).cast("float") >= F.lit(0.35).cast("float"))
    return runs.measures(runs.label(dense), "component").select("component", F.col("area").alias("core_area"), (F.col("area") < 8).alias("too_small"))


# ---- scalar functions -------------------------------------------------------------

_ID = "regexp_replace(name, '^[^:]*:', '')"
_FAMILY = f"CASE WHEN regexp_matches({_ID}, 'swamp|marsh|bayou|mangrove') THEN 3 WHEN contains({_ID}, 'river') THEN 2 WHEN contains({_ID}, 'ocean') THEN 1 ELSE 0 END"
_TRAITS = f"(CASE WHEN regexp_matches({_ID}, 'frozen|snowy|glacial|wintry|siberian|polar|frost|ice_|_ice|icy') OR {_ID} = 'ice' THEN 1 ELSE 0 END + CASE WHEN regexp_matches({_ID}, 'desert|canyon') OR {_ID} IN ('badlands', 'eroded_badlands', 'wooded_badlands') THEN 2 ELSE 0 END + CASE WHEN contains({_ID}, 'mangrove') THEN 4 ELSE 0 END + CASE WHEN regexp_matches({_ID}, 'jungle|rainforest|bamboo') THEN 8 ELSE 0 END + CASE WHEN contains({_ID}, 'cave') OR contains({_ID}, 'deep_dark') THEN 16 ELSE 0 END)"
_NAMES = ", named AS (SELECT DISTINCT biome || CASE WHEN customer % 11 < 4 THEN ['_plateau', '_caves', '_badlands', '_jungle'][1 + CAST(customer % 11 AS INTEGER)] ELSE '' END AS name, CAST(customer % 9 AS INTEGER) AS k FROM grid)"
_DERIVED = f""", dim AS (SELECT name, k, {_FAMILY} AS family, {_TRAITS} AS traits FROM named)
SELECT name, k, CAST(family AS INTEGER) AS family, CAST(traits AS INTEGER) AS traits,
 CAST(CASE WHEN family = 1 THEN CASE WHEN contains({_ID}, 'warm') THEN 0 WHEN regexp_matches({_ID}, 'frozen|cold') THEN 2 ELSE 1 END WHEN traits & 1 = 1 THEN 2 WHEN family = 2 AND contains({_ID}, 'warm') THEN 0 WHEN k >= 3 THEN 0 WHEN k >= 1 THEN 1 ELSE 2 END AS INTEGER) AS water_temperature,
 CAST(CASE WHEN traits & 12 <> 0 THEN 3 WHEN family = 1 THEN CASE WHEN contains({_ID}, 'frozen') THEN 0 WHEN contains({_ID}, 'cold') THEN 1 ELSE 2 END WHEN traits & 2 = 2 THEN 0 WHEN k >= 6 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END AS INTEGER) AS vegetation FROM dim"""


@query(_NAMES + _DERIVED)
def biome_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = demo.raster(spark, sf_dir)
    tail = F.coalesce(F.get(F.array(*map(F.lit, ("_plateau", "_caves", "_badlands", "_jungle"))), (F.col("customer") % 11).cast("int")), F.lit(""))
    named = grid.select(F.concat("biome", F.when(F.col("customer") % 11 < 4, tail).otherwise("")).alias("name"), (F.col("customer") % 9).cast("int").alias("k")).distinct()
    name = F.col("name")
    return named.select("name", "k", blocks.family(name).alias("family"), blocks.traits(name).alias("traits"), blocks.water_temperature(name, F.col("k") * 0.25).alias("water_temperature"), blocks.vegetation(name, F.col("k") * 0.1).alias("vegetation"))


_BLOCKS = ("minecraft:water", "minecraft:flowing_water", "minecraft:air", "cave_air", "minecraft:lava", "pack:packed_ice", "mud", "minecraft:kelp", "lily_pad", "stone", "dead_tube_coral", "minecraft:tube_coral", "sea_pickle")


@query(f""", b AS (SELECT DISTINCT [{', '.join(repr(b) for b in _BLOCKS)}][1 + CAST(customer % 13 AS INTEGER)] AS name, customer % 2 = 0 AS waterlogged, CASE WHEN customer % 3 = 0 THEN NULL ELSE CAST(customer % 3 - 1 AS INTEGER) END AS level FROM grid),
i AS (SELECT *, {_ID} AS id FROM b)
SELECT name, waterlogged, level, CASE WHEN id = 'flowing_water' THEN 'solid' WHEN id = 'water' THEN CASE WHEN coalesce(level, 0) = 0 THEN 'water' ELSE 'solid' END WHEN id IN ('air', 'cave_air', 'void_air') THEN 'air' WHEN id IN ('lava', 'flowing_lava') THEN 'lava'
 WHEN id IN ('ice', 'packed_ice', 'blue_ice', 'frosted_ice') THEN 'ice' WHEN id IN ('mud', 'bubble_column', 'kelp', 'kelp_plant', 'seagrass', 'tall_seagrass', 'sea_pickle') THEN 'water' WHEN waterlogged THEN 'water' WHEN id IN ('snow', 'lily_pad', 'snow_block', 'powder_snow') THEN 'cover' ELSE 'solid' END AS class,
 contains(id, 'coral') AND NOT starts_with(id, 'dead_') AS coral, id IN ('kelp', 'kelp_plant', 'seagrass', 'tall_seagrass', 'sea_pickle') AS plant FROM i""")
def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = demo.raster(spark, sf_dir)
    customer = F.col("customer")
    made = grid.select(F.get(F.array(*map(F.lit, _BLOCKS)), (customer % 13).cast("int")).alias("name"), (customer % 2 == 0).alias("waterlogged"), F.when(customer % 3 == 0, None).otherwise((customer % 3 - 1).cast("int")).alias("level")).distinct()
    name = F.col("name")
    return made.select("name", "waterlogged", "level", water.name_of(blocks.block_class(name, F.col("waterlogged"), F.col("level")), blocks.CLASSES).alias("class"), blocks.is_coral(name).alias("coral"), blocks.is_aquatic_plant(name).alias("plant"))


@query(" SELECT x, z, CAST(x >> 2 AS INTEGER) AS cell_x, CAST(z >> 2 AS INTEGER) AS cell_z, CAST(((z & 15) >> 2) * 4 + ((x & 15) >> 2) AS INTEGER) AS cell, CAST((z >> 4 & 31) * 32 + (x >> 4 & 31) AS INTEGER) AS chunk, CAST(x >> 9 AS INTEGER) AS region_x, CAST(z >> 9 AS INTEGER) AS region_z FROM grid")
def coord_addressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = lambda c, mask: F.col(c).bitwiseAND(F.lit(mask))
    up = F.shiftright
    return demo.raster(spark, sf_dir).select("x", "z", up("x", 2).alias("cell_x"), up("z", 2).alias("cell_z"), (up(low("z", 15), 2) * 4 + up(low("x", 15), 2)).alias("cell"), (up("z", 4).bitwiseAND(F.lit(31)) * 32 + up("x", 4).bitwiseAND(F.lit(31))).alias("chunk"), up("x", 9).alias("region_x"), up("z", 9).alias("region_z"))


@query(" SELECT x, z, kind, temperature, kind * 65536 + cave * 512 + icy * 256 + temperature AS signature FROM (SELECT x, z, CAST(customer % 4 AS INTEGER) AS kind, CAST(customer % 3 AS INTEGER) AS temperature, CAST(ice AS INTEGER) AS icy, CAST(covered AS INTEGER) AS cave FROM wet)")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = demo.water(spark, sf_dir).select("x", "z", water.signature(F.col("customer") % 4, F.col("customer") % 3, F.col("ice"), F.col("covered")).alias("signature"))
    back = water.unpack_signature(F.col("signature"))
    return made.select("x", "z", back.kind.alias("kind"), back.temperature.alias("temperature"), "signature")


@query(""", c AS (SELECT x, z, CAST(customer % 4 AS INTEGER) AS family, customer % 23 AS ocean_columns, customer % 5000 AS columns, customer % 2 = 0 AS near_ocean, CASE WHEN customer % 5 < 2 THEN 2 + CAST(customer % 5 AS INTEGER) END AS fringe, covered AS cave, ice AS in_sheet, CAST(customer % 3 AS INTEGER) AS own FROM grid),
k AS (SELECT *, CASE WHEN cave THEN 2 WHEN family = 1 THEN CASE WHEN in_sheet THEN 0 ELSE 2 END WHEN family = 2 THEN 1 WHEN family = 3 THEN 3 WHEN (near_ocean AND ocean_columns >= 16) OR (ocean_columns < 16 AND columns >= 3000) THEN 0 WHEN fringe = 2 THEN 1 WHEN fringe = 3 THEN 3 ELSE 2 END AS kind FROM c)
SELECT x, z, CAST(kind AS INTEGER) AS kind, CAST(CASE WHEN family <> 0 THEN own WHEN kind = 0 THEN CASE WHEN near_ocean THEN 2 ELSE own END WHEN kind IN (1, 3) AND fringe IS NOT NULL THEN 1 ELSE own END AS INTEGER) AS temperature FROM k""")
def kind_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("customer")
    made = demo.raster(spark, sf_dir).select("x", "z", (c % 4).cast("int").alias("family"), (c % 23).alias("ocean_columns"), (c % 5000).alias("columns"), (c % 2 == 0).alias("near_ocean"), F.when(c % 5 < 2, 2 + c % 5).cast("int").alias("fringe"), "covered", "ice", (c % 3).cast("int").alias("own"))
    kinds = made.withColumn("kind", water.column_kind(*map(F.col, ("family", "ocean_columns", "columns", "near_ocean", "fringe", "covered", "ice")), min_sea=3000))
    return kinds.select("x", "z", "kind", water.column_temperature(F.col("family"), F.col("kind"), F.col("own"), F.when(F.col("near_ocean"), 2), F.when(F.col("fringe").isNotNull(), 1)).alias("temperature"))


# ---- cells, bodies, regions -------------------------------------------------------

_CELLS = """, cell AS (SELECT CAST(x >> 2 AS INTEGER) AS cx, CAST(z >> 2 AS INTEGER) AS cz, count(*) AS water_cols, count(*) FILTER (ice) AS ice_cols, count(*) FILTER (covered) AS cave_cols, CAST(trunc(sum(surface_y) / count(*)) AS INTEGER) AS surface_y, CAST(least(trunc(sum(greatest(surface_y - floor_y, 0)) / count(*)), 65535) AS INTEGER) AS depth, min_by(biome, z * 1000 + x) AS biome FROM wet GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = demo.water(spark, sf_dir).withColumn("cave", F.col("covered"))
    named = wet.groupBy(F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")).agg(F.min_by("biome", F.col("z") * 1000 + F.col("x")).alias("biome"))
    return regions.aggregate_cells(wet).join(named, ["cx", "cz"])


@query(_CELLS + " SELECT * FROM cell")
def cell_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(" SELECT CAST(x >> 2 AS INTEGER) AS cx, CAST(z >> 2 AS INTEGER) AS cz, min(surface_y) AS y FROM grid WHERE status <> 'O' GROUP BY 1, 2")
def terrain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.terrain(demo.raster(spark, sf_dir).select("x", "z", F.col("surface_y").alias("y"), (F.col("status") == "O").alias("water")))


_HIST = _CELLS + f", hist AS (SELECT CAST(least(greatest(surface_y, -128), 383) AS INTEGER) AS y, CAST(coalesce(sum(water_cols) FILTER ({_FAMILY.replace('name', 'biome')} = 1), 0) AS BIGINT) AS ocean_n, CAST(sum(water_cols) AS BIGINT) AS all_n FROM cell WHERE cave_cols * 2 < water_cols GROUP BY 1)"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.surface_histogram(demo.segments_of(_cells(spark, sf_dir)))


@query(_HIST + " SELECT * FROM hist")
def surface_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(_HIST + """, big AS (SELECT y, ocean_n * 100 AS ocean_n, all_n * 100 AS all_n FROM hist),
o AS (SELECT max(row(ocean_n, y)) AS top, sum(ocean_n) AS total FROM big), a AS (SELECT max(row(all_n, y)) AS top, sum(all_n) AS total FROM big)
SELECT CAST(CASE WHEN o.total >= 10000 AND o.top[1] >= 0.25 * o.total THEN o.top[2] + 1 WHEN a.total >= 10000 AND a.top[1] >= 0.25 * a.total THEN a.top[2] + 1 ELSE 63 END AS INTEGER) AS sea_level,
 CASE WHEN o.total >= 10000 AND o.top[1] >= 0.25 * o.total THEN 'ocean' WHEN a.total >= 10000 AND a.top[1] >= 0.25 * a.total THEN 'all' ELSE 'fallback' END AS source FROM o, a""")
def sea_level_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sea_level(_histogram(spark, sf_dir).withColumns({"ocean_n": F.col("ocean_n") * 100, "all_n": F.col("all_n") * 100}))


@query(_LABELS + f""", seg AS (SELECT l.component, l.x, l.z, g.biome FROM labelled l JOIN grid g USING (x, z))
SELECT component, count(*) AS columns, count(*) FILTER (f = 1) AS ocean_columns, count(*) FILTER (f = 2) AS river_columns, count(*) FILTER (f = 3) AS swamp_columns, count(*) FILTER (f = 0) AS land_columns FROM (SELECT component, {_FAMILY.replace('name', 'biome')} AS f FROM seg) GROUP BY component""", recursive=True)
def hydro_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = demo.segments_of(demo.raster(spark, sf_dir))
    placed = runs.explode_runs(_labelled(spark, sf_dir)).select("component", "x", "z").join(grid.select("x", "z", "family"), ["x", "z"])
    return regions.hydro_info(placed.withColumn("n", F.lit(1)), "component")


@query(_CELLS + f""", oc AS (SELECT CAST(cz AS BIGINT) * 4294967296 + cx AS id, cx, cz, water_cols FROM cell WHERE {_FAMILY.replace('name', 'biome')} = 1 AND cave_cols * 2 < water_cols),
links AS (SELECT a.id AS a, b.id AS b FROM oc a JOIN oc b ON abs(a.cx - b.cx) + abs(a.cz - b.cz) = 1),
cc(id, component) USING KEY (id) AS (SELECT id, id AS component FROM oc UNION SELECT l.b AS id, min(c.component) AS component FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.component < r.component GROUP BY l.b),
s AS (SELECT component, sum(water_cols) AS columns FROM cc JOIN oc USING (id) GROUP BY component HAVING sum(water_cols) >= 12)
SELECT cx, cz, component AS sheet, CAST(columns AS BIGINT) AS columns FROM cc JOIN oc USING (id) JOIN s USING (component)""", recursive=True)
def ocean_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.ocean_sheets(demo.segments_of(_cells(spark, sf_dir)), 12)


def _dimension(spark: SparkSession) -> DataFrame:
    return biomes.biome_table(spark)


def _water_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (id, z, x0, x1) of the O raster's components; id is the least run code."""
    wet = demo.water(spark, sf_dir, "O")
    return runs.label(wet.select("x", "z")).withColumnRenamed("component", "id")


_DIM = ", dim AS (SELECT * FROM (VALUES ('minecraft:warm_ocean', 0, 2), ('minecraft:cold_ocean', 0, 1), ('minecraft:river', 0, 1), ('minecraft:frozen_river', 1, 1), ('minecraft:swamp', 0, 2), ('minecraft:mangrove_swamp', 4, 3), ('minecraft:desert', 2, 0), ('minecraft:plains', 0, 1), ('minecraft:forest', 0, 2)) t(biome, traits, vegetation))"
_WET_LABELS = _LABELS.replace("FROM grid)", "FROM wet)", 1)
_SUMS = _CELLS + _DIM + _WET_LABELS + """, piece AS (SELECT id, cx, cz, count(*) AS n FROM (SELECT component AS id, CAST(x >> 2 AS INTEGER) AS cx, CAST(z >> 2 AS INTEGER) AS cz, z, x - row_number() OVER (PARTITION BY component, z ORDER BY x) AS g FROM labelled) GROUP BY id, cx, cz, z, g),
sums AS (SELECT p.id, CAST(sum(n) AS BIGINT) AS columns, CAST(sum(surface_y * n) AS BIGINT) AS surface_sum, CAST(sum(depth * n) AS BIGINT) AS depth_sum, max(depth) AS depth_max,
 CAST(sum(CAST(round(CAST(least(CAST(ice_cols AS FLOAT) / CAST(water_cols AS FLOAT), 1) AS DOUBLE) * n) AS BIGINT)) AS BIGINT) AS ice_columns, CAST(sum(CAST(round(CAST(least(CAST(cave_cols AS FLOAT) / CAST(water_cols AS FLOAT), 1) AS DOUBLE) * n) AS BIGINT)) AS BIGINT) AS cave_columns,
 CAST(coalesce(sum(n) FILTER (depth > 10), 0) AS BIGINT) AS over_10, CAST(coalesce(sum(n) FILTER (depth > 20), 0) AS BIGINT) AS over_20, CAST(coalesce(sum(n) FILTER (depth > 30), 0) AS BIGINT) AS over_30, CAST(coalesce(sum(n) FILTER (depth > 40), 0) AS BIGINT) AS over_40,
 CAST(sum(coalesce(vegetation, 1) * n) AS BIGINT) AS vegetation_sum, CAST(coalesce(sum(n) FILTER (traits & 2 <> 0), 0) AS BIGINT) AS desert_columns, CAST(coalesce(sum(n) FILTER (traits & 4 <> 0), 0) AS BIGINT) AS mangrove_columns,
 CAST(coalesce(sum(n) FILTER (cx % 3 = 0), 0) AS BIGINT) AS coral_columns, CAST(coalesce(sum(n) FILTER (cz % 2 = 0), 0) AS BIGINT) AS plant_columns FROM piece p JOIN cell c USING (cx, cz) LEFT JOIN dim d USING (biome) GROUP BY p.id)"""


def _accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"coral": F.col("cx") % 3 == 0, "plants": F.col("cz") % 2 == 0})
    return regions.accumulate(_water_regions(spark, sf_dir), cells, _dimension(spark))


@query(_SUMS + " SELECT * FROM sums", recursive=True)
def region_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accumulated(spark, sf_dir)


_FINAL = _SUMS + """, k AS (SELECT *, CAST(abs(id) % 4 AS INTEGER) AS kind, least(CAST(round(vegetation_sum / columns) AS INTEGER), 3) AS base FROM sums),
f AS (SELECT *, CAST(mangrove_columns AS FLOAT) / columns >= CAST(0.25 AS FLOAT) AS mangrove FROM k)
SELECT id, kind, CAST(CASE WHEN mangrove THEN 3 WHEN CAST(plant_columns AS FLOAT) / columns >= CAST(0.25 AS FLOAT) AND base < 2 THEN base + 1 WHEN kind = 0 AND CAST(plant_columns AS FLOAT) / columns < CAST(0.02 AS FLOAT) THEN greatest(base - 1, 0) ELSE base END AS INTEGER) AS vegetation,
 CAST(CASE WHEN CAST(ice_columns AS FLOAT) / columns >= 0.5 THEN 1 ELSE 0 END + CASE WHEN kind = 0 AND CAST(coral_columns AS FLOAT) / columns >= CAST(0.02 AS FLOAT) THEN 2 ELSE 0 END + CASE WHEN kind <> 0 AND CAST(desert_columns AS FLOAT) / columns >= CAST(0.4 AS FLOAT) THEN 4 ELSE 0 END + CASE WHEN mangrove THEN 8 ELSE 0 END + CASE WHEN CAST(cave_columns AS FLOAT) / columns >= 0.5 THEN 16 ELSE 0 END AS INTEGER) AS modifiers,
 CAST((depth_sum + columns // 2) // columns AS INTEGER) AS mean_depth, CAST(CASE WHEN (depth_sum + columns // 2) // columns <= 10 THEN 0 WHEN (depth_sum + columns // 2) // columns <= 30 THEN 1 ELSE 2 END AS INTEGER) AS depth_class, CAST((surface_sum + columns // 2) // columns AS INTEGER) AS surface_y,
 CAST(round(over_10 / columns * 255.0) AS INTEGER) AS contour_10, CAST(round(over_30 / columns * 255.0) AS INTEGER) AS contour_30 FROM f"""


@query(_FINAL, recursive=True)
def region_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _accumulated(spark, sf_dir).withColumn("kind", (F.abs("id") % 4).cast("int"))
    return regions.finalize(sums).select("id", "kind", "vegetation", "modifiers", "mean_depth", "depth_class", "surface_y", "contour_10", "contour_30")


@query(_CELLS + _WET_LABELS + ", n AS (SELECT component AS id, biome, count(*) AS n FROM labelled l JOIN cell c ON c.cx = l.x >> 2 AND c.cz = l.z >> 2 GROUP BY 1, 2) SELECT id, arg_max(biome, row(n, biome)) AS dominant_biome, max(n) AS biome_columns FROM n GROUP BY id", recursive=True)
def dominant_biome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.dominant_biome(_water_regions(spark, sf_dir), _cells(spark, sf_dir))


@query(" SELECT biome, count(*) AS cells FROM grid WHERE biome LIKE 'pack:%' GROUP BY biome")
def unknown_biomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biomes.unknown_biomes(demo.raster(spark, sf_dir), _dimension(spark))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, nodes (id, size, kind, cave) and edges of all components of the three-state raster."""
    own = _regions(spark, sf_dir)
    kind = F.when(F.col("status") == "O", 0).when(F.col("status") == "P", 1).otherwise(2)
    nodes = own.groupBy("id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("size"), F.first(kind).alias("kind")).withColumn("cave", F.col("id") % 11 == 0)
    return own, nodes, runs.adjacency(own, "id")


@query()
def absorb_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, edges = _graph(spark, sf_dir)
    return contraction.absorb_regions(nodes, edges, 6)


@query()
def consolidate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one kind: every second component is renamed, so that touching components can share a kind."""
    _, nodes, edges = _graph(spark, sf_dir)
    return contraction.consolidate_regions(nodes.withColumn("kind", (F.col("id") % 2).cast("int")), edges, 20, 10)


@query(_LABELS + " SELECT count(*) FILTER (area >= 3) AS kept, count(*) FILTER (area < 3) AS dropped, CAST(sum(area) FILTER (area >= 3) AS BIGINT) AS kept_columns FROM (SELECT component, count(*) AS area FROM labelled GROUP BY component)", recursive=True)
def retain_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = runs.measures(_labelled(spark, sf_dir), "component")
    big = F.col("area") >= 3
    return area.agg(F.count_if(big).alias("kept"), F.count_if(~big).alias("dropped"), F.sum(F.when(big, F.col("area"))).alias("kept_columns"))


@query()
def shape_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, nodes, _ = _graph(spark, sf_dir)
    return regions.shape_correct(nodes.withColumn("kind", F.col("kind") + 1), own).select("id", "kind")


_KINDED = _LABELS.replace("a.status = b.status AND ", "").replace("FROM grid)", "FROM grid WHERE status <> 'F')", 1)


@query(_KINDED + " SELECT component AS body, count(*) AS area, bool_or(status = 'O' AND x % 16 = 0) AS reaches_sea, count(*) FILTER (NOT (status = 'O' AND x % 16 = 0)) AS inland_area FROM labelled GROUP BY component", recursive=True)
def closed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = demo.raster(spark, sf_dir).filter("status <> 'F'")
    kind = F.when((F.col("status") == "O") & (F.col("x") % 16 == 0), water.SEA).when(F.col("status") == "O", water.LAKE).otherwise(water.RIVER_KIND)
    own = runs.label(grid.select("x", "z", kind.alias("kind")), "kind").withColumnRenamed("component", "id")
    nodes = own.groupBy("id").agg(F.first("kind").alias("kind")).withColumn("cave", F.lit(False))
    bodies = regions.closed_bodies(nodes, own.drop("kind"), min_area=4, max_area=500, small_area=20)
    return bodies.groupBy("body").agg(F.first("area").alias("area"), F.first("reaches_sea").alias("reaches_sea"), F.first("inland_area").alias("inland_area"))


@query(_WET_LABELS + " SELECT component AS id, count(*) AS columns, count(*) FILTER (covered) AS covered_columns, CAST(count(*) FILTER (covered) / count(*) AS FLOAT) >= 0.5 AS cave FROM labelled JOIN wet USING (x, z) GROUP BY component", recursive=True)
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.coverage(_water_regions(spark, sf_dir), demo.water(spark, sf_dir).filter("covered"))


@query(_LABELS + _CANON + " SELECT CAST(x >> 6 AS INTEGER) AS cell_x, CAST(z >> 6 AS INTEGER) AS cell_z, count(DISTINCT id) AS regions, CAST(sum(DISTINCT id) AS BIGINT) AS id_sum FROM labelled JOIN numbered USING (component) GROUP BY 1, 2", recursive=True)
def spatial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = regions.spatial_index(_regions(spark, sf_dir))
    return index.select("cell_x", "cell_z", F.size("region_ids").cast("long").alias("regions"), F.aggregate("region_ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("id_sum"))


@query(_LABELS + _CANON + ", p AS (SELECT DISTINCT CAST(user_id % 150 - 75 AS INTEGER) AS x, CAST(event_id // 7 % 200 - 60 AS INTEGER) AS z FROM events) SELECT p.x, p.z, n.id FROM p LEFT JOIN (labelled l JOIN numbered n USING (component)) ON l.x = p.x AND l.z = p.z", recursive=True)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs.coalesce_runs(_regions(spark, sf_dir), "id")
    points = demo.table(spark, sf_dir, "events").select((F.col("user_id") % 150 - 75).cast("int").alias("x"), F.expr("cast(event_id div 7 % 200 - 60 as int)").alias("z")).distinct()
    return regions.lookup(points, own)


# ---- reports, pixels, scores ------------------------------------------------------


@query(_LABELS + " SELECT status AS kind, count(*) AS regions, CAST(sum(area) AS BIGINT) AS columns, max(area) AS largest FROM (SELECT status, component, count(*) AS area FROM labelled GROUP BY ALL) GROUP BY status", recursive=True)
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("regions"), F.sum("area").alias("columns"), F.max("area").alias("largest"))


@query(_LABELS + " SELECT component AS id, status AS kind, area AS column_count FROM (SELECT *, row_number() OVER (ORDER BY area DESC, component) AS k FROM (SELECT status, component, count(*) AS area FROM labelled GROUP BY ALL)) WHERE k <= 50", recursive=True)
def json_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.reports import region_json

    rows = components(spark, sf_dir).select(F.col("component").alias("id"), F.col("status").alias("kind"), F.col("area").alias("column_count"))
    read = F.from_json("json", "id bigint, kind string, column_count bigint").alias("r")
    return region_json(rows, 50).select(read).select("r.*")


@query(" SELECT CAST(trunc((x + 64) / 4) AS INTEGER) AS px, CAST(trunc((z + 37) / 4) AS INTEGER) AS pz, arg_max(status, row(rank, z, x)) AS painted FROM (SELECT *, CASE status WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM grid) GROUP BY 1, 2")
def pixel_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.maps import paint

    rank = F.when(F.col("status") == "O", 0).when(F.col("status") == "P", 1).otherwise(2)
    rows = demo.raster(spark, sf_dir).select("x", "z", F.col("status").alias("painted"), rank.alias("rank"))
    return paint(rows, "painted", ["rank", "z", "x"], -64, -37, 4)


@query(" SELECT CAST(trunc((x + 64) / 4) AS INTEGER) AS px, CAST(trunc((z + 37) / 4) AS INTEGER) AS pz, count(*) AS weight, CAST(max(surface_y - floor_y) AS INTEGER) AS deepest, bit_or(CASE WHEN covered THEN 1 ELSE 2 END) AS evidence FROM wet GROUP BY 1, 2")
def pixel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.maps import pixel

    wet = demo.water(spark, sf_dir)
    return wet.groupBy(*pixel(-64, -37, 4)).agg(F.count("*").alias("weight"), F.max(F.col("surface_y") - F.col("floor_y")).alias("deepest"), F.bit_or(F.when(F.col("covered"), 1).otherwise(2)).alias("evidence"))


@query()
def display_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.maps import pixel

    pixels = demo.water(spark, sf_dir).groupBy(*pixel(-64, -37, 2)).agg(F.max(F.col("customer") % 3).cast("int").alias("code"), F.count("*").alias("weight"))
    return contraction.sieve(pixels, 8)


@query(" SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.reports import confusion

    return confusion(demo.table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))


@query(" SELECT round(avg(r), 9) AS balanced_accuracy, round(sum(hit) / sum(n), 9) AS overall FROM (SELECT quality, count(*) AS n, count(*) FILTER (quality = toxic) AS hit, count(*) FILTER (quality = toxic) / count(*) AS r FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality)")
def mask_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.reports import confusion, score

    return score(confusion(demo.table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))))


@query(" SELECT (SELECT count(*) FROM wet) AS columns, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained, CAST(0 AS BIGINT) AS overlaps")
def mask_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.verify import mask_difference

    wet = demo.water(spark, sf_dir).select("x", "z")
    return mask_difference(wet, _water_regions(spark, sf_dir))



@query(_LABELS + _CANON + " SELECT id, count(*) AS area FROM labelled JOIN numbered USING (component) GROUP BY id", recursive=True)
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the regions after they were encoded in the binary file and parsed again."""
    from ..sources import waterfile

    own = cut(runs.coalesce_runs(_regions(spark, sf_dir), "id"))
    box = own.agg(F.min("x0"), F.min("z"), F.max("x1"), F.max("z")).first()
    sized = runs.measures(own).withColumnRenamed("area", "column_count")
    plain = {c.split()[0]: F.lit(0).cast(c.split()[1]) for c in waterfile.REGION.split(", ")}
    rows = sized.select(*[F.col(n) if n in sized.columns else e.alias(n) for n, e in plain.items()])
    ensure_checkpoint_folder(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/regions-{uuid.uuid4().hex}.bin")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    with tempfile.TemporaryDirectory() as folder:
        # one machine writes the file, all read it by ranges from the shared folder
        path = f"{os.path.realpath(folder)}/regions.bin"
        waterfile.write_file(path, rows, own, tuple(box))
        store.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}"), place)
    regions_, runs_ = waterfile.read_file(spark, store.makeQualified(place).toString())
    area = runs.measures(runs_).select("id", "area")
    parsed = cut(regions_.select("id", "column_count").join(area, "id", "left").select("id", F.when(F.col("area") == F.col("column_count"), F.col("area")).alias("area")))
    store.delete(place, False)
    return parsed


@query()
def lake_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores, channel flood, necks and reconstruction on the percolating two-state raster, with thresholds that fit its size."""
    from ..operators.lakes import separate
    from ..options import LakeOptions

    options = LakeOptions(core_radius=2, density_8=0.5, density_16=0.5, density_32=0.4, min_core_area=2, min_channel_length=4)
    return separate(demo.water(spark, sf_dir, "O", "P").select("x", "z"), options)


@query()
def region_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, absorption, sums of the merged groups and final attributes in one plan."""
    own, nodes, edges = _graph(spark, sf_dir)
    group = cut(contraction.absorb_regions(nodes, edges, 6))
    joined = runs.coalesce_runs(own.drop("status").join(group.select("id", "group"), "id").drop("id").withColumnRenamed("group", "id"), "id")
    cells = _cells(spark, sf_dir).withColumns({"coral": F.lit(False), "plants": F.lit(False)})
    kind = nodes.select(F.col("id").alias("donor"), "kind")
    heads = group.select("group", "donor").distinct().join(kind, "donor").select(F.col("group").alias("id"), "kind")
    sums = regions.accumulate(joined, cells, _dimension(spark))
    return regions.finalize(sums.join(heads, "id")).select("id", "kind", "columns", "vegetation", "modifiers", "mean_depth", "surface_y")


# ---- lakes ------------------------------------------------------------------------


@query(" SELECT a.x, a.z, CAST((count(*) FILTER (abs(a.x - b.x) <= 16 AND abs(a.z - b.z) <= 16) * 255 + 544) // 1089 AS INTEGER) AS d16, CAST((count(*) * 255 + 2112) // 4225 AS INTEGER) AS d32 FROM wet a JOIN wet b ON abs(a.x - b.x) <= 32 AND abs(a.z - b.z) <= 32 GROUP BY a.x, a.z")
def box_density_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.density(demo.water(spark, sf_dir), (16, 32))


_MEASURES = """, m AS (SELECT x, z FROM grid WHERE status IN ('O', 'P')),
dry AS (SELECT x, z FROM (SELECT unnest(range(-66, 66)) AS x) CROSS JOIN (SELECT unnest(range((SELECT min(z) FROM grid) - 2, (SELECT max(z) FROM grid) + 3)) AS z) ANTI JOIN m USING (x, z)),
shore AS (SELECT m.x, m.z, min(abs(m.x - d.x) + abs(m.z - d.z)) AS distance FROM m JOIN dry d ON abs(m.x - d.x) <= 12 AND abs(m.z - d.z) <= 12 GROUP BY m.x, m.z),
dense AS (SELECT a.x, a.z, (count(*) FILTER (abs(a.x - b.x) <= 8 AND abs(a.z - b.z) <= 8) * 255 + 144) // 289 AS d8, (count(*) FILTER (abs(a.x - b.x) <= 16 AND abs(a.z - b.z) <= 16) * 255 + 544) // 1089 AS d16, (count(*) * 255 + 2112) // 4225 AS d32 FROM m a JOIN m b ON abs(a.x - b.x) <= 32 AND abs(a.z - b.z) <= 32 GROUP BY a.x, a.z)"""


@query(_MEASURES + " SELECT x, z, distance >= 2 AND CAST(d8 AS FLOAT) / CAST(255 AS FLOAT) >= CAST(0.5 AS FLOAT) AND CAST(d16 AS FLOAT) / CAST(255 AS FLOAT) >= CAST(0.5 AS FLOAT) AND CAST(d32 AS FLOAT) / CAST(255 AS FLOAT) >= CAST(0.4 AS FLOAT) AS core FROM shore JOIN dense USING (x, z)")
def core_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four conditions of a core, with thresholds that fit the raster."""
    from ..operators import lakes
    from ..options import LakeOptions

    options = LakeOptions(core_radius=2, density_8=0.5, density_16=0.5, density_32=0.4)
    return lakes.evidence(demo.water(spark, sf_dir, "O", "P").select("x", "z")).select("x", "z", lakes.good_core(options).alias("core"))


@query(" SELECT x, z FROM grid WHERE customer % 4 IN (1, 2) AND customer % 32 < 16")
def inland_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inland water by its kind (customer modulo 4) and modifiers (modulo 32)."""
    from ..operators import lakes

    marked = demo.raster(spark, sf_dir).select("x", "z", (F.col("customer") % 4).cast("int").alias("kind"), (F.col("customer") % 32).cast("int").alias("modifiers"))
    return marked.filter(lakes.inland()).select("x", "z")


@query(_WET_LABELS + """, box AS (SELECT component AS body, min(x) AS bx, min(z) AS bz, max(x) AS ex, max(z) AS ez, CAST(count(*) AS DOUBLE) AS n FROM labelled GROUP BY 1),
loc AS (SELECT b.*, CAST(l.x - bx AS DOUBLE) AS u, CAST(l.z - bz AS DOUBLE) AS v FROM labelled l JOIN box b ON b.body = l.component),
mom AS (SELECT body, 0.5 * atan2(2 * (sum(u * v) - sum(u) * sum(v) / min(n)), (sum(u * u) - sum(u) * sum(u) / min(n)) - (sum(v * v) - sum(v) * sum(v) / min(n))) AS t FROM loc GROUP BY body),
ext AS (SELECT body, max(cos(t) * u + sin(t) * v) - min(cos(t) * u + sin(t) * v) + min(abs(cos(t)) + abs(sin(t))) AS a, max(cos(t) * v - sin(t) * u) - min(cos(t) * v - sin(t) * u) + min(abs(cos(t)) + abs(sin(t))) AS b FROM loc JOIN mom USING (body) GROUP BY body)
SELECT body, round(CAST(n / ((ex - bx + 1) * (ez - bz + 1)) AS DOUBLE), 4) AS axis_fill, round(least(1, n / least((ex - bx + 1) * (ez - bz + 1), a * b)), 4) AS fill FROM box JOIN ext USING (body)""", recursive=True)
def lake_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lakes

    placed = runs.explode_runs(_water_regions(spark, sf_dir)).select(F.col("id").alias("body"), "x", "z")
    return lakes.footprints(placed, "body").select("body", F.round(F.col("axis_fill").cast("double"), 4).alias("axis_fill"), F.round(F.col("fill").cast("double"), 4).alias("fill"))


@query(_WET_LABELS + """, wc AS (SELECT l.component, l.x, l.z, w.surface_y FROM labelled l JOIN wet w USING (x, z)),
ground AS (SELECT x >> 2 AS cx, z >> 2 AS cz, min(surface_y) AS y FROM grid WHERE status = 'F' GROUP BY 1, 2),
side AS (SELECT w.component, w.surface_y, w.x + s.dx AS x, w.z + s.dz AS z FROM wc w CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dx, dz)),
bank AS (SELECT s.* FROM side s ANTI JOIN (SELECT x, z FROM grid WHERE status IN ('O', 'P')) g ON g.x = s.x AND g.z = s.z)
SELECT component AS body, (SELECT count(*) FROM labelled k WHERE k.component = b.component) AS area, count(*) AS edges, count(y) AS ground_samples, count(*) FILTER (y >= surface_y + 1) AS ground_rises FROM bank b LEFT JOIN ground g ON g.cx = b.x >> 2 AND g.cz = b.z >> 2 GROUP BY component""", recursive=True)
def lake_candidate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, banks and risen ground of the water's components; P water is protected, F is dry ground. Components without a bank are left out."""
    from ..operators import lakes
    from ..options import LakeOptions

    grid = demo.raster(spark, sf_dir)
    wet = demo.water(spark, sf_dir)
    found = runs.explode_runs(_water_regions(spark, sf_dir)).select("x", "z", F.col("id").alias("body"), F.lit(1).alias("lake"))
    ground = regions.terrain(grid.filter("status = 'F'").select("x", "z", F.col("surface_y").alias("y"), F.lit(False).alias("water")))
    sums = lakes.candidate_sums(found, lakes.evidence(wet.select("x", "z")), wet.select("x", "z", "surface_y"), ground, grid.filter("status = 'P'").select("x", "z"), LakeOptions())
    return sums.filter("edges > 0").select("body", "area", "edges", "ground_samples", "ground_rises")


_SCORED = """, c AS (SELECT order_key AS body, 500 + customer * 37 % 60000 AS area, customer % 50 AS min_x, customer % 50 + 5 + customer % 400 AS max_x, 0 AS min_z, 100 + customer % 300 AS max_z, 1 + customer % 90 AS max_distance, 200 + customer % 256 AS d16, customer % 256 AS d32, customer % 40 AS samples, customer % 40 // 2 AS rises, CAST((customer % 100) / 100.0 AS FLOAT) AS fill, 10 + customer * 13 % 40000 AS core_area, CAST(customer % 200 AS DOUBLE) AS width, customer % 4 AS contacts, (customer % 10) / 10.0 AS widening, customer % 5 AS outflows, [customer % 50 + customer % 3] AS near, [100 + customer % 300 - customer % 2] AS far FROM grid),
k AS (SELECT *, area / pow(2.0 * max_distance, 2) AS e, core_area / CAST(area AS DOUBLE) AS core, CASE WHEN max_z - min_z > max_x - min_x THEN list_contains(list_transform(far, lambda v: v <= min_z + (max_z - min_z) * 0.25), true) AND list_contains(list_transform(far, lambda v: v >= max_z - (max_z - min_z) * 0.25), true)
  ELSE list_contains(list_transform(list_concat(near, far), lambda v: v <= min_x + (max_x - min_x) * 0.25), true) AND list_contains(list_transform(list_concat(near, far), lambda v: v >= max_x - (max_x - min_x) * 0.25), true) END AS opposed FROM c),
s AS (SELECT *, greatest(0, least(1, 0.10 * least(1, width / 72.0) + 0.12 * least(1, core_area / 256.0) + 0.20 * least(1, greatest(0, 0.4 * (d16 / 255.0) + 0.6 * (d32 / 255.0))) + 0.15 * CASE WHEN contacts = 0 THEN 0.7 ELSE widening END + 0.08 * least(1, area / 4000.0) + 0.20 * greatest(0, least(1, 1 - e / 16.0)) + 0.10 * CASE WHEN samples > 0 THEN rises / CAST(samples AS DOUBLE) ELSE 0.5 END + 0.05 / (1.0 + 0.5 * greatest(outflows - 1, 0)))) AS confidence FROM k),
r AS (SELECT *, CASE WHEN area < 2000 THEN 'candidate_too_small' WHEN fill < CAST(0.25 AS FLOAT) THEN 'channel_like_footprint' WHEN CAST(core AS FLOAT) < CAST(0.6 AS FLOAT) AND NOT (area <= 20000 AND fill >= CAST(0.75 AS FLOAT)) THEN 'insufficient_basin_core' WHEN CAST(e AS FLOAT) > 8 AND NOT opposed THEN 'uniform_wide_channel' WHEN CAST(confidence AS FLOAT) < CAST(0.58 AS FLOAT) THEN 'low_confidence' END AS rejection FROM s)
SELECT body, round(confidence, 4) AS confidence, opposed, rejection, CASE WHEN rejection IS NOT NULL THEN rejection WHEN fill < CAST(0.4 AS FLOAT) THEN 'new_lake_footprint' WHEN CAST(core AS FLOAT) < CAST(0.9 AS FLOAT) AND fill < CAST(0.75 AS FLOAT) THEN 'new_lake_core_support' END AS new_lake_rejection FROM r"""


@query(_SCORED)
def lake_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, confidence, opposed necks and both cascades of verdicts on candidates made of the orders."""
    from ..operators import lakes
    from ..options import LakeOptions

    c = F.col("customer")
    double = lambda e: e.cast("double")
    area = 500 + c * 37 % 60000
    made = demo.raster(spark, sf_dir).select(
        F.col("order_key").alias("body"), F.lit(1).alias("lake"), area.alias("area"), (c % 50).alias("min_x"), (c % 50 + 5 + c % 400).alias("max_x"), F.lit(0).cast("long").alias("min_z"), (100 + c % 300).alias("max_z"),
        (1 + c % 90).alias("max_distance"), F.lit(0).alias("distance_sum"), F.lit(0.0).alias("d8_sum"), (double(200 + c % 256) * area).alias("d16_sum"), (double(c % 256) * area).alias("d32_sum"),
        (c % 40).alias("ground_samples"), F.expr("customer % 40 div 2").alias("ground_rises"), (c % 40).alias("edges"), (c % 100 / 100.0).cast("float").alias("fill"), (10 + c * 13 % 40000).alias("core_area"), double(c % 200).alias("width"),
        (c % 4).alias("contacts"), (c % 10 / 10.0).alias("widening"), (c % 5).alias("outflows"), F.array(c % 50 + c % 3, 100 + c % 300 - c % 2).alias("necks_x"), F.array(100 + c % 300 - c % 2).alias("necks_z"),
    )
    scored = lakes.score(made, LakeOptions(min_new_lake_fill=0.4, min_new_lake_core_fraction=0.9))
    return scored.select("body", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "opposed", "rejection", "new_lake_rejection")


@query(_LABELS + _CANON + """, src AS (SELECT n.id AS source, l.x, l.z, l.status, g.customer % 3 = 0 AS lake FROM labelled l JOIN numbered n USING (component) JOIN grid g USING (x, z)),
prot AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS id, count(*) AS area FROM src WHERE status = 'O' GROUP BY source),
pc AS (SELECT CAST(z AS BIGINT) * 4294967296 + x AS pid, source * 2 + CAST(lake AS BIGINT) AS piece, x, z FROM src WHERE status <> 'O'),
pl AS (SELECT a.pid AS a, b.pid AS b FROM pc a JOIN pc b ON a.piece = b.piece AND abs(a.x - b.x) + abs(a.z - b.z) = 1),
c2(pid, component) USING KEY (pid) AS (SELECT pid, pid AS component FROM pc UNION SELECT l.b AS pid, min(c.component) AS component FROM c2 c JOIN pl l ON c.pid = l.a JOIN recurring.c2 r ON r.pid = l.b WHERE c.component < r.component GROUP BY l.b),
pieces AS (SELECT component, min(piece) AS piece, count(*) AS area, min(row(z >> 5, x >> 5, z, x)) AS f FROM c2 JOIN pc USING (pid) GROUP BY component)
SELECT CAST(id AS BIGINT) AS id, 0 AS kind, area AS column_count FROM prot UNION ALL
SELECT CAST(row_number() OVER (ORDER BY f) - 1 + (SELECT count(*) FROM prot) AS BIGINT) AS id, CASE WHEN piece % 2 = 1 THEN 2 ELSE 1 END AS kind, area AS column_count FROM pieces""", recursive=True)
def lake_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division of inland regions into lakes and rivers: O components stay as they are, the others are cut where customer modulo 3 says lake."""
    from ..operators import lakes

    own = _regions(spark, sf_dir)
    found = own.groupBy("id").agg(F.first(F.when(F.col("status") == "O", water.SEA).otherwise(water.RIVER_KIND)).alias("kind")).withColumn("modifiers", F.lit(0))
    marked = runs.explode_runs(own.filter("status <> 'O'")).select(F.col("id").alias("source"), "x", "z").join(demo.raster(spark, sf_dir).select("x", "z", (F.col("customer") % 3 == 0).alias("is_lake")), ["x", "z"])
    whole, pieces = lakes.apply(found, own.drop("status"), marked)
    area = pieces.groupBy("id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("column_count"))
    return whole.join(area, "id").select("id", "kind", "column_count")


@query(_CELLS + _DIM + _WET_LABELS + """, arid AS (SELECT DISTINCT x >> 2 AS cx, z >> 2 AS cz FROM grid WHERE biome = 'minecraft:desert' AND status <> 'O'),
wc AS (SELECT l.component AS id, l.x >> 2 AS cx, l.z >> 2 AS cz FROM labelled l)
SELECT id, CAST(count(*) FILTER (coalesce(traits, 0) & 2 <> 0 OR EXISTS (SELECT 1 FROM arid a WHERE abs(a.cx - w.cx) <= 4 AND abs(a.cz - w.cz) <= 4)) AS BIGINT) AS desert_columns FROM wc w JOIN cell c USING (cx, cz) LEFT JOIN dim d USING (biome) GROUP BY id""", recursive=True)
def arid_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desert columns of regions: the cell's own biome, or arid dry land within four cells, counted once."""
    dry = demo.raster(spark, sf_dir).filter("status <> 'O'").select(F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz"), "biome")
    biome_dim = _dimension(spark)
    cells = _cells(spark, sf_dir).withColumns({"coral": F.lit(False), "plants": F.lit(False)})
    return regions.accumulate(_water_regions(spark, sf_dir), cells, biome_dim, arid=regions.dryland(dry, biome_dim)).select("id", "desert_columns")


# ---- maps -------------------------------------------------------------------------

_MAPPED = _LABELS + _CANON + """, reg AS (SELECT l.x, l.z, n.id, CAST(n.id % 4 AS INTEGER) AS kind, CAST(n.id % 3 AS INTEGER) AS temperature, CAST(n.id // 3 % 32 AS INTEGER) AS modifiers FROM labelled l JOIN numbered n USING (component)),
pix AS (SELECT *, CAST((x + 64) // 4 AS INTEGER) AS px, CAST((z + 37) // 4 AS INTEGER) AS pz FROM reg)"""
_INLAND_SQL = "CASE WHEN kind = 1 AND modifiers & 4 <> 0 THEN 15390624 WHEN kind = 2 AND modifiers & 4 <> 0 THEN 14197373 ELSE [2388088, 10078925, 6602451, 12887172][kind + 1] END"


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """Runs of all components with made-up attributes, and the projection to pixels of four columns."""
    from ..sinks.painters import Projection

    own = _regions(spark, sf_dir)
    whole = lambda e: e.cast("int")
    rows = own.select("id", "z", "x0", "x1", whole(F.col("id") % 4).alias("kind"), whole(F.col("id") % 3).alias("temperature"), whole(F.col("id") % 3).alias("depth_class"), whole(F.col("id") % 4).alias("vegetation"), F.expr("cast(id div 3 % 32 as int)").alias("modifiers"))
    return rows, Projection(-64, -37, 63, 1200, 4)


@query(" SELECT x, z, CASE WHEN customer % 32 & 16 <> 0 AND (x + 64) % 5 IN (2, 3) AND (z + 40) % 5 IN (2, 3) THEN 4474959 WHEN customer % 32 & 2 <> 0 AND (x + 64) % 6 = 2 AND (z + 40) % 6 = 2 THEN 16734910 WHEN customer % 32 & 1 <> 0 AND (z + 40) % 8 < 2 THEN 15464703 WHEN customer % 32 & 4 <> 0 AND (x + 64 + 5 * (z + 40)) % 11 < 2 THEN 14862456 WHEN customer % 32 & 8 <> 0 AND (x + 64) % 7 = 3 AND (z + 40) % 7 = 5 THEN 9850920 END AS color FROM grid")
def modifier_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import colours

    grid = demo.raster(spark, sf_dir)
    return grid.select("x", "z", colours.texture((F.col("customer") % 32).cast("int"), F.col("x") + 64, F.col("z") + 40).alias("color"))


@query(""", d AS (SELECT DISTINCT CAST(surface_y - floor_y + customer % 60 AS INTEGER) AS depth FROM grid),
s AS (SELECT depth, CASE WHEN depth <= 10 THEN [0, 198, 244, 252, 10, 96, 196, 226] WHEN depth <= 30 THEN [10, 96, 196, 226, 30, 38, 112, 192] WHEN depth <= 60 THEN [30, 38, 112, 192, 60, 18, 48, 122] ELSE [60, 18, 48, 122, 100, 8, 16, 54] END AS k FROM d),
t AS (SELECT depth, k, CAST(least(depth, 100) - k[1] AS FLOAT) / CAST(k[5] - k[1] AS FLOAT) AS t FROM s)
SELECT depth, CAST(trunc(CAST(k[2] AS FLOAT) * (CAST(1 AS FLOAT) - t) + CAST(k[6] AS FLOAT) * t) * 65536 + trunc(CAST(k[3] AS FLOAT) * (CAST(1 AS FLOAT) - t) + CAST(k[7] AS FLOAT) * t) * 256 + trunc(CAST(k[4] AS FLOAT) * (CAST(1 AS FLOAT) - t) + CAST(k[8] AS FLOAT) * t) AS INTEGER) AS color FROM t""")
def depth_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import colours

    depth = (F.col("surface_y") - F.col("floor_y") + F.col("customer") % 60).cast("int")
    return demo.raster(spark, sf_dir).select(depth.alias("depth")).distinct().select("depth", colours.depth_color(F.col("depth")).alias("color"))


@query(", t AS (SELECT DISTINCT x >> 5 AS rx, z >> 5 AS rz FROM grid) SELECT DISTINCT CAST(px AS INTEGER) AS px, CAST(pz AS INTEGER) AS pz, 3421754 AS color FROM (SELECT rx, rz, unnest(range((rx * 512 + 4096) // 64, (rx * 512 + 511 + 4096) // 64 + 1)) AS px FROM t) JOIN (SELECT rx, rz, unnest(range((rz * 512 + 4096) // 64, (rz * 512 + 511 + 4096) // 64 + 1)) AS pz FROM t) USING (rx, rz)")
def land_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the tiles that exist; a tile here is named by 32 columns of the raster."""
    from ..sinks import painters

    tiles = demo.raster(spark, sf_dir).select(F.shiftright("x", 5).alias("rx"), F.shiftright("z", 5).alias("rz")).distinct()
    return painters.land(tiles, painters.Projection(-4096, -4096, 100_000, 100_000, 64))


@query(_MAPPED + f" SELECT px, pz, arg_max({_INLAND_SQL}, row([0, 2, 1, 3][kind + 1], id, z, x)) AS color FROM pix GROUP BY px, pz", recursive=True)
def inland_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks import painters

    rows, p = _mapped(spark, sf_dir)
    return painters.inland(rows, p)


@query(_MAPPED + " SELECT px, pz, max(id) AS top FROM pix GROUP BY px, pz", recursive=True)
def region_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last writer of every pixel in the order of regions."""
    from ..sinks import painters

    rows, p = _mapped(spark, sf_dir)
    return painters.last(painters.run_pixels(rows, p), F.col("id"), "id", "z", "x0").withColumnRenamed("color", "top")


@query(_CELLS + " SELECT CAST((cx * 4 + 64) // 8 AS INTEGER) AS px, CAST((cz * 4 + 40) // 8 AS INTEGER) AS pz, arg_max(least(depth, 100), row(cz >> 7, cx >> 7, cz >> 2, cx >> 2, cz, cx)) AS depth FROM cell WHERE cave_cols * 2 < water_cols GROUP BY 1, 2")
def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth that every pixel of eight columns shows, read back from its colour."""
    from ..functions import colours
    from ..sinks import painters

    shown = painters.depths(_cells(spark, sf_dir), painters.Projection(-64, -40, 63, 1200, 8))
    back = spark.createDataFrame([(k, colours.ramp(k)) for k in range(101)], "depth int, color int").groupBy("color").agg(F.min("depth").alias("depth"))
    return shown.join(back, "color").select("px", "pz", "depth")


@query(_CELLS + _MAPPED.replace("), pix AS", "), pix AS", 1) + """, rr AS (SELECT id, kind, temperature, z, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY id, z ORDER BY x) AS g FROM reg WHERE kind = 0) GROUP BY id, kind, temperature, z, g),
rp AS (SELECT *, greatest(x0, px * 4 - 64) AS a0, least(x1, px * 4 - 61) AS a1, (z + 37) // 4 AS pz FROM (SELECT *, unnest(range((x0 + 64) // 4, (x1 + 64) // 4 + 1)) AS px FROM rr)),
s AS (SELECT rp.*, temperature * 2 + CASE WHEN coalesce(c.depth, 0) > 30 THEN 1 ELSE 0 END AS code FROM rp LEFT JOIN cell c ON c.cx = rp.a0 >> 2 AND c.cz = rp.z >> 2)
SELECT CAST(px AS INTEGER) AS px, CAST(pz AS INTEGER) AS pz, CAST(arg_max(code, row(id, z, x0)) AS INTEGER) AS code, CAST(sum(a1 - a0 + 1) AS BIGINT) AS weight FROM s GROUP BY 1, 2""", recursive=True)
def ocean_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and shelf or basin of sea pixels, with the columns they hold, before the sieve."""
    from ..sinks import painters

    rows, p = _mapped(spark, sf_dir)
    return painters.ocean_pixels(rows, _cells(spark, sf_dir), p)


@query(_MAPPED + f""", shown AS (SELECT px, pz, arg_max({_INLAND_SQL}, row([0, 2, 1, 3][kind + 1], id, z, x)) AS color FROM pix GROUP BY px, pz),
seen AS (SELECT p.*, g.covered FROM pix p JOIN shown s USING (px, pz) JOIN grid g ON g.x = p.x AND g.z = p.z WHERE s.color = {_INLAND_SQL}),
bits AS (SELECT px, pz, bit_or(modifiers & 3) AS b, bool_and(covered) AS roofed FROM seen GROUP BY px, pz)
SELECT px, pz, color FROM (SELECT px, pz, CASE WHEN roofed AND px % 5 IN (2, 3) AND pz % 5 IN (2, 3) THEN 4474959 WHEN b & 2 <> 0 AND px % 6 = 2 AND pz % 6 = 2 THEN 16734910 WHEN b & 1 <> 0 AND pz % 8 < 2 THEN 15464703 END AS color FROM bits) WHERE color IS NOT NULL""", recursive=True)
def overview_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks import painters

    rows, p = _mapped(spark, sf_dir)
    covered = demo.raster(spark, sf_dir).filter("covered").select("x", "z")
    return painters.overview_textures(rows, covered, painters.inland(rows, p), p)


@query(" SELECT customer, CASE WHEN v >= 1099511627776 THEN printf('%.1f TiB', v / 1099511627776.0) WHEN v >= 1073741824 THEN printf('%.1f GiB', v / 1073741824.0) WHEN v >= 1048576 THEN printf('%.1f MiB', v / 1048576.0) WHEN v >= 1024 THEN printf('%.1f KiB', v / 1024.0) ELSE printf('%d B', v) END AS size FROM (SELECT DISTINCT customer, customer * customer * customer * (1 + customer % 5) AS v FROM grid)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.reports import human_size_of

    c = F.col("customer")
    return demo.raster(spark, sf_dir).select("customer").distinct().select("customer", human_size_of(c * c * c * (1 + c % 5)).alias("size"))


@query(_MAPPED + ", r AS (SELECT id, min(kind) AS kind, min(modifiers) AS m, count(*) AS n FROM reg GROUP BY id) SELECT count(*) FILTER (kind = 0) AS sea, count(*) FILTER (kind = 1) AS river, count(*) FILTER (kind = 2) AS lake, count(*) FILTER (kind = 3) AS swamp, count(*) FILTER (m & 1 <> 0) AS with_ice, count(*) FILTER (m & 2 <> 0) AS with_corals, count(*) FILTER (m & 4 <> 0) AS with_desert, count(*) FILTER (m & 8 <> 0) AS with_mangrove, count(*) FILTER (m & 16 <> 0) AS with_cave, count(*) FILTER (kind = 1 AND m & 16 = 0 AND n < 3) AS small_rivers, count(*) FILTER (kind = 0 AND m & 16 = 0 AND n < 2) AS small_seas FROM r", recursive=True)
def modifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _mapped(spark, sf_dir)
    found = rows.groupBy("id").agg(F.first("kind").alias("kind"), F.first("modifiers").alias("modifiers"), F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("column_count"))
    return regions.kind_and_modifier_counts(found, 3, 2)


@query(_CELLS + f""", oc AS (SELECT CAST(cz AS BIGINT) * 4294967296 + cx AS id, cx, cz, water_cols FROM cell WHERE {_FAMILY.replace('name', 'biome')} = 1 AND cave_cols * 2 < water_cols),
links AS (SELECT a.id AS a, b.id AS b FROM oc a JOIN oc b ON abs(a.cx - b.cx) + abs(a.cz - b.cz) = 1),
cc(id, component) USING KEY (id) AS (SELECT id, id AS component FROM oc UNION SELECT l.b AS id, min(c.component) AS component FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.component < r.component GROUP BY l.b)
SELECT sheet, CAST(columns AS BIGINT) AS columns FROM (SELECT component AS sheet, sum(water_cols) AS columns, row_number() OVER (ORDER BY sum(water_cols) DESC, component) AS k FROM cc JOIN oc USING (id) GROUP BY component) WHERE k <= 48""", recursive=True)
def largest_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.largest_sheets(regions.ocean_sheets(demo.segments_of(_cells(spark, sf_dir)), 1))


_MASKED = """, px AS (SELECT x AS px, z AS pz, customer % 3 AS truth, [0, 10078925, 15390624, 6602451, 14197373, 255][1 + CAST(customer % 6 AS INTEGER)] AS c1, [0, 10078925, 15390624, 6602451, 14197373, 255][1 + CAST(customer // 7 % 6 AS INTEGER)] AS c2 FROM grid),
k AS (SELECT truth, CASE WHEN c1 IN (10078925, 15390624) THEN 1 WHEN c1 IN (6602451, 14197373) THEN 2 ELSE 0 END AS ref, CASE WHEN c2 IN (10078925, 15390624) THEN 1 WHEN c2 IN (6602451, 14197373) THEN 2 ELSE 0 END AS p FROM px), v AS (SELECT * FROM k WHERE truth > 0 AND ref > 0),
m AS (SELECT count(*) AS sample_count, count(*) FILTER (truth = 1 AND p = 1) AS river_as_river, count(*) FILTER (truth = 1 AND p = 2) AS river_as_lake, count(*) FILTER (truth = 2 AND p = 1) AS lake_as_river, count(*) FILTER (truth = 2 AND p = 2) AS lake_as_lake, count(*) FILTER (p = 0) AS unavailable_predictions, count(*) FILTER (truth = 1) AS r, count(*) FILTER (truth = 2) AS l FROM v)
SELECT sample_count, river_as_river, river_as_lake, lake_as_river, lake_as_lake, unavailable_predictions, round(river_as_river / r, 9) AS river_recall, round(lake_as_lake / l, 9) AS lake_recall, round((river_as_river / r + lake_as_lake / l) / 2, 9) AS balanced_accuracy, round((river_as_river + lake_as_lake) / sample_count, 9) AS accuracy FROM m"""


@query(_MASKED)
def mask_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A painted mask, a reference and a candidate as pixel tables, joined by pixel and scored."""
    from ..sinks import masks

    c = F.col("customer")
    colors = F.array(*map(F.lit, (0, 0x99CACD, 0xEAD7A0, 0x64BED3, 0xD8A27D, 255)))
    grid = demo.raster(spark, sf_dir).select(F.col("x").alias("px"), F.col("z").alias("pz"), (c % 3).cast("int").alias("truth"), F.get(colors, (c % 6).cast("int")).alias("c1"), F.get(colors, F.expr("cast(customer div 7 % 6 as int)")).alias("c2"))
    seen = lambda name: grid.select("px", "pz", masks.classes(F.col(name), masks.PALETTES["current"]).alias("class"))
    brushes = F.when(F.col("truth") == 1, masks.BRUSHES[1]).when(F.col("truth") == 2, masks.BRUSHES[2]).otherwise(0)
    mask = masks.painted(grid.select("px", "pz", brushes.alias("color"), F.lit(255).alias("alpha")))
    scores = masks.metrics(masks.compared(mask, seen("c1"), seen("c2")))
    share = {"river_recall", "lake_recall", "balanced_accuracy", "accuracy"}
    return scores.select(*[F.round(n, 9).alias(n) if n in share else F.col(n) for n in scores.columns])
