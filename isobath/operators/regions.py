"""Region statistics: accumulation over cells, final attributes, shape correction, closed bodies, coverage, spatial index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, water
from .graph import components
from .neighbourhood import nearest
from .runs import BUCKET_SHIFT, adjacency, perimeters


def aggregate_cells(columns: DataFrame) -> DataFrame:
    """Columns (x, z, surface_y, floor_y, ice, cave) to 4x4 cells: counts, truncated mean surface and depth (0..65535)."""
    n = F.count("*")
    cut = lambda total: F.expr("0") + (F.signum(total) * F.floor(F.abs(total) / n)).cast("long")
    depth = F.greatest(F.col("surface_y") - F.col("floor_y"), F.lit(0))
    return columns.groupBy(F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")).agg(
        n.alias("water_cols"),
        F.count_if(F.col("ice")).alias("ice_cols"),
        F.count_if(F.col("cave")).alias("cave_cols"),
        cut(F.sum("surface_y")).cast("int").alias("surface_y"),
        F.least(cut(F.sum(depth)), F.lit(65535)).cast("int").alias("depth"),
    )


def terrain(columns: DataFrame) -> DataFrame:
    """Least surface of the dry columns of every cell (x, z, y, water)."""
    return columns.filter(~F.col("water")).groupBy(F.shiftright("x", 2).alias("cx"), F.shiftright("z", 2).alias("cz")).agg(F.min("y").alias("y"))


def hydro_info(segments: DataFrame, key: str, family: str = "family", n: str = "n") -> DataFrame:
    """Column counts of every body by family; unknown families count as land."""
    count = lambda test: F.sum(F.when(test, F.col(n)).otherwise(0)).cast("long")
    known = F.coalesce(F.col(family), F.lit(blocks.LAND))
    return segments.groupBy(key).agg(
        F.sum(n).cast("long").alias("columns"),
        count(known == blocks.OCEAN).alias("ocean_columns"),
        count(known == blocks.RIVER).alias("river_columns"),
        count(known == blocks.SWAMP).alias("swamp_columns"),
        count(known == blocks.LAND).alias("land_columns"),
    )


def sea_level(histogram: DataFrame) -> DataFrame:
    """One row (sea_level, source) from (y, ocean_n, all_n): the ocean mode if clear, else that of all water, else 63.

    A mode needs 10,000 samples and a quarter of them; ties go to the higher y.
    """
    kinds = histogram.select("y", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("ocean_n").alias("n")), F.struct(F.lit(1).alias("rank"), F.col("all_n").alias("n")))).alias("k")).select("y", "k.rank", "k.n")
    best = kinds.groupBy("rank").agg(F.sum("n").alias("total"), F.max(F.struct("n", "y")).alias("top"))
    clear = best.filter((F.col("total") >= 10_000) & (F.col("top.n") >= 0.25 * F.col("total")))
    chosen = clear.agg(F.min(F.struct("rank", "top.y")).alias("c"))
    return chosen.select(F.coalesce(F.col("c.y") + 1, F.lit(63)).cast("int").alias("sea_level"), F.when(F.col("c.rank") == 0, "ocean").when(F.col("c.rank") == 1, "all").otherwise("fallback").alias("source"))


def surface_histogram(cells: DataFrame) -> DataFrame:
    """(y, ocean_n, all_n) with y clamped to -128..383; cells with a cave majority do not count."""
    open_sky = cells.filter(F.col("cave_cols") * 2 < F.col("water_cols"))
    y = F.least(F.greatest("surface_y", F.lit(-128)), F.lit(383))
    return open_sky.groupBy(y.alias("y")).agg(F.sum(F.when(F.col("family") == blocks.OCEAN, F.col("water_cols")).otherwise(0)).cast("long").alias("ocean_n"), F.sum("water_cols").cast("long").alias("all_n"))


def segments(runs: DataFrame, key: str) -> DataFrame:
    """Runs split at the 4-column edges of cells: (key, cx, cz, n)."""
    cells = runs.withColumn("cx", F.explode(F.sequence(F.shiftright("x0", 2), F.shiftright("x1", 2))))
    n = F.least("x1", F.col("cx") * 4 + 3) - F.greatest("x0", F.col("cx") * 4) + 1
    return cells.select(key, "cx", F.shiftright("z", 2).alias("cz"), n.alias("n"))


#: Arid dry land lends its trait to water within so many cells.
DRYLAND_RADIUS = 4


def dryland(surface: DataFrame, biomes: DataFrame) -> DataFrame:
    """(cx, cz) of the cells (cx, cz, biome) whose surface biome is arid land."""
    arid = biomes.filter((F.col("family") == blocks.LAND) & blocks.has(F.col("traits"), blocks.DESERT)).select(F.col("name").alias("biome"))
    return surface.join(arid, "biome", "left_semi").select("cx", "cz").distinct()


def accumulate(runs: DataFrame, cells: DataFrame, biomes: DataFrame, key: str = "id", arid: DataFrame | None = None) -> DataFrame:
    """Additive sums of every region over its run-cell segments, so that merged regions add up.

    Shares of a segment's columns are rounded after single-precision division, as the file format expects.
    arid: cells (cx, cz) of dryland(); water within DRYLAND_RADIUS of one counts as desert once, whatever its own biome.
    """
    dim = biomes.select(F.col("name").alias("biome"), "traits", "vegetation")
    rows = segments(runs, key).join(cells, ["cx", "cz"]).join(dim, "biome", "left")
    desert = blocks.has(F.coalesce("traits", F.lit(0)), blocks.DESERT)
    if arid is not None:
        near = nearest(arid.select(F.col("cx").alias("x"), F.col("cz").alias("z")), DRYLAND_RADIUS).select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.lit(True).alias("near"))
        rows = rows.join(near, ["cx", "cz"], "left")
        desert = desert | F.coalesce("near", F.lit(False))
    n = F.col("n").cast("long")
    share = lambda c: F.round(F.least((F.col(c).cast("float") / F.col("water_cols").cast("float")).cast("float"), F.lit(1.0).cast("float")).cast("double") * n).cast("long")
    counted = lambda test: F.sum(F.when(test, n).otherwise(0))
    return rows.groupBy(key).agg(
        F.sum(n).alias("columns"),
        F.sum(F.col("surface_y") * n).alias("surface_sum"),
        F.sum(F.col("depth") * n).alias("depth_sum"),
        F.max("depth").alias("depth_max"),
        F.sum(share("ice_cols")).alias("ice_columns"),
        F.sum(share("cave_cols")).alias("cave_columns"),
        *[counted(F.col("depth") > c).alias(f"over_{c}") for c in water.CONTOURS],
        F.sum(F.coalesce("vegetation", F.lit(blocks.SPARSE)) * n).alias("vegetation_sum"),
        counted(desert).alias("desert_columns"),
        counted(blocks.has(F.coalesce("traits", F.lit(0)), blocks.MANGROVE)).alias("mangrove_columns"),
        counted(F.coalesce("coral", F.lit(False))).alias("coral_columns"),
        counted(F.coalesce("plants", F.lit(False))).alias("plant_columns"),
    )


SUMS = ("columns", "surface_sum", "depth_sum", "ice_columns", "cave_columns", *[f"over_{c}" for c in water.CONTOURS], "vegetation_sum", "desert_columns", "mangrove_columns", "coral_columns", "plant_columns")


def merge_sums(sums: DataFrame, key: str) -> DataFrame:
    """Sums of joined regions."""
    return sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("depth_max").alias("depth_max"))


def dominant_biome(runs: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    """The biome of most columns of every region; ties go to the later name."""
    rows = segments(runs, key).join(cells.select("cx", "cz", "biome"), ["cx", "cz"]).groupBy(key, "biome").agg(F.sum("n").alias("n"))
    return rows.groupBy(key).agg(F.max(F.struct("n", "biome")).alias("m")).select(key, F.col("m.biome").alias("dominant_biome"), F.col("m.n").cast("long").alias("biome_columns"))


def finalize(sums: DataFrame, kind: str = "kind") -> DataFrame:
    """Attributes of regions from their sums and kind."""
    n = F.greatest(F.col("columns"), F.lit(1))
    part = lambda c: (F.col(c).cast("float") / n.cast("float")).cast("float")
    least = lambda c, t: part(c) >= F.lit(t).cast("float")
    base = F.least(F.round(F.col("vegetation_sum") / n).cast("int"), F.lit(3))
    grown = (
        F.when(least("plant_columns", 0.25) & (base < blocks.NORMAL), water.promote(base))
        .when((F.col(kind) == water.SEA) & (part("plant_columns") < F.lit(0.02).cast("float")), water.demote(base))
        .otherwise(base)
    )
    mangrove = least("mangrove_columns", 0.25)
    sea = F.col(kind) == water.SEA
    bit = lambda test, k: F.when(test, 1 << k).otherwise(0)
    modifiers = bit(least("ice_columns", 0.5), 0) + bit(sea & least("coral_columns", 0.02), 1) + bit(~sea & least("desert_columns", 0.4), 2) + bit(mangrove, 3) + bit(least("cave_columns", 0.5), 4)
    mean_depth = water.rounded_mean(F.col("depth_sum"), n).cast("int")
    contour = [F.round(F.col(f"over_{c}") / n * 255.0).cast("int").alias(f"contour_{c}") for c in water.CONTOURS]
    return sums.withColumns({"vegetation": F.when(mangrove, 3).otherwise(grown), "modifiers": modifiers, "mean_depth": mean_depth, "max_depth": F.least("depth_max", F.lit(65535)), "depth_class": water.depth_class(mean_depth), "surface_y": water.rounded_mean(F.col("surface_sum"), n).cast("int")}).select("*", *contour)


def shape_correct(regions: DataFrame, runs: DataFrame, key: str = "id") -> DataFrame:
    """regions (key, kind, cave) with kinds corrected by outline: pools, strands, then river banks, all decided at once."""
    open_ = regions.filter(~F.col("cave"))
    own = runs.join(open_.select(key), key, "left_semi")
    touch = adjacency(own, key)
    kinds = open_.select(key, "kind")
    both = touch.join(kinds.select(F.col(key).alias("a"), F.col("kind").alias("ka")), "a").join(kinds.select(F.col(key).alias("b"), F.col("kind").alias("kb")), "b")
    roots = open_.select(key, "kind").join(components(both.filter("ka = kb"), "a", "b").select(F.col("node").alias(key), F.col("component").alias("root")), key, "left").withColumn("root", F.coalesce("root", key))
    outline = perimeters(own, key).join(roots, key).groupBy("root").agg(F.first("kind").alias("kind"), F.sum("area").alias("area"), F.sum("perimeter").alias("outer"))
    of = lambda side: roots.select(F.col(key).alias(side), F.col("root").alias(f"r{side}"))
    rooted = touch.join(of("a"), "a").join(of("b"), "b")
    inner = rooted.filter("ra = rb").groupBy(F.col("ra").alias("root")).agg(F.sum("w").alias("inner"))
    outline = outline.join(inner, "root", "left").select("root", "kind", "area", (F.col("outer") - 2 * F.coalesce("inner", F.lit(0))).alias("perimeter"))
    width, long = water.mean_width(F.col("area"), F.col("perimeter")), water.elongation(F.col("area"), F.col("perimeter"))
    shaped = outline.withColumn("kind2", F.when((F.col("kind") == water.RIVER_KIND) & (width >= 30) & (long <= 8), water.LAKE).when((F.col("kind") == water.LAKE) & (width <= 10) & (long >= 30), water.RIVER_KIND).otherwise(F.col("kind")))
    code = lambda side: shaped.select(F.col("root").alias(f"r{side}"), F.col("kind2").alias(f"c{side}"))
    coded = rooted.join(code("a"), "ra").join(code("b"), "rb")
    river = coded.filter(((F.col("ca") == water.LAKE) & (F.col("cb") == water.RIVER_KIND)) | ((F.col("cb") == water.LAKE) & (F.col("ca") == water.RIVER_KIND))).groupBy(F.when(F.col("ca") == water.LAKE, F.col("ra")).otherwise(F.col("rb")).alias("root")).agg(F.sum("w").alias("contact"))
    final = shaped.join(river, "root", "left").withColumn("kind3", F.when((F.col("kind2") == water.LAKE) & water.is_bank(F.col("area"), F.col("perimeter"), F.coalesce("contact", F.lit(0))), water.RIVER_KIND).otherwise(F.col("kind2"))).select("root", "kind3")
    new = roots.join(final, "root").select(key, "kind3")
    return regions.join(new, key, "left").withColumn("kind", F.coalesce("kind3", "kind")).drop("kind3")


def closed_bodies(regions: DataFrame, runs: DataFrame, key: str = "id", min_area: int = 2000, max_area: int = 500_000, small_area: int = 5000, min_fill: float = 0.30, max_elongation: float = 5.0, min_width: float = 0.0) -> DataFrame:
    """(key, body, area, reaches_sea, inland_area, river_area, fill, elongation, mean_width, forced) of regions (key, kind, cave).

    Bodies join all touching non-cave regions. Fill is the area over the lesser of the axis box and the box
    along the principal axes, from run moments in whole columns: work grows with runs, not columns.
    """
    part = regions.filter(~F.col("cave")).select(key, "kind")
    own = runs.join(part, key)
    found = components(adjacency(own, key), "a", "b").select(F.col("node").alias(key), F.col("component").alias("body"))
    bodies = part.join(found, key, "left").withColumn("body", F.coalesce("body", key))
    rows = own.join(bodies.select(key, "body"), key).withColumn("len", (F.col("x1") - F.col("x0") + 1).cast("double"))
    kind_area = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("len")).otherwise(0)).cast("long")
    box = rows.groupBy("body").agg(
        F.sum("len").alias("area"), F.min("x0").alias("bx"), F.min("z").alias("bz"), F.max("x1").alias("ex"), F.max("z").alias("ez"),
        F.bool_or(F.col("kind") == water.SEA).alias("reaches_sea"), kind_area(water.RIVER_KIND, water.LAKE).alias("inland_area"), kind_area(water.RIVER_KIND).alias("river_area"),
    )
    placed = rows.join(box.select("body", "bx", "bz"), "body").withColumns({"mx": (F.col("x0") + F.col("x1")) / 2.0 - F.col("bx"), "mz": (F.col("z") - F.col("bz")).cast("double")})
    moments = placed.groupBy("body").agg(*[F.sum(e * F.col("len")).alias(n) for n, e in (("sx", F.col("mx")), ("sz", F.col("mz")), ("sxx", F.col("mx") * F.col("mx") + (F.col("len") * F.col("len") - 1) / 12.0), ("szz", F.col("mz") * F.col("mz")), ("sxz", F.col("mx") * F.col("mz")))], F.sum("len").alias("n"))
    n = F.col("n")
    vx, vz, cov = F.col("sxx") / n - F.pow(F.col("sx") / n, 2), F.col("szz") / n - F.pow(F.col("sz") / n, 2), F.col("sxz") / n - F.col("sx") * F.col("sz") / (n * n)
    angle = moments.select("body", (0.5 * F.atan2(2 * cov, vx - vz)).alias("t"))
    ends = placed.join(angle, "body").withColumns({"ax": F.col("x0") - F.col("bx"), "ay": F.col("x1") - F.col("bx")})
    c, s = F.cos("t"), F.sin("t")
    along = [F.col(e) * c + F.col("mz") * s for e in ("ax", "ay")]
    over = [F.col("mz") * c - F.col(e) * s for e in ("ax", "ay")]
    spans = ends.groupBy("body").agg((F.max(F.greatest(*along)) - F.min(F.least(*along)) + F.first(F.abs(c) + F.abs(s))).alias("major"), (F.max(F.greatest(*over)) - F.min(F.least(*over)) + F.first(F.abs(c) + F.abs(s))).alias("minor"))
    whole = box.join(spans, "body")
    wide, high = F.col("ex") - F.col("bx") + 1, F.col("ez") - F.col("bz") + 1
    a = F.col("area")
    long_side = F.greatest("major", "minor")
    shaped = whole.select("body", a.cast("long").alias("area"), "reaches_sea", "inland_area", "river_area", (a / F.least((wide * high).cast("double"), F.col("major") * F.col("minor"))).alias("fill"), (long_side / F.least("major", "minor")).alias("elongation"), (a / long_side).alias("mean_width"))
    lake_shape = (F.col("fill") >= min_fill) & (F.col("elongation") <= max_elongation) & (F.col("mean_width") >= min_width)
    forced = ~F.col("reaches_sea") & (F.col("inland_area") > 0) & F.col("area").between(min_area, max_area) & ((F.col("area") <= small_area) | lake_shape)
    return bodies.select(key, "kind", "body").join(shaped.withColumn("forced", forced if max_area else F.lit(False)), "body")


def coverage(runs: DataFrame, covered: DataFrame, key: str = "id", share: float = 0.5) -> DataFrame:
    """(key, columns, covered_columns, cave) of regions; covered: columns (x, z) under a roof. A share of half or more makes a cave."""
    total = runs.groupBy(key).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("columns"))
    under = contains(covered.select("x", "z").distinct(), runs, key).groupBy(key).agg(F.count("*").alias("covered_columns"))
    both = total.join(under, key, "left").withColumn("covered_columns", F.coalesce("covered_columns", F.lit(0)))
    return both.withColumn("cave", (F.col("covered_columns") / F.col("columns")).cast("float") >= F.lit(share).cast("float"))


def contains(points: DataFrame, runs: DataFrame, key: str = "id") -> DataFrame:
    """points (x, z, ...) inside runs, with the run's key: an equi-join on row and column bucket, then the interval test."""
    spread = runs.select(key, "z", "x0", "x1", F.explode(F.sequence(F.shiftright("x0", BUCKET_SHIFT), F.shiftright("x1", BUCKET_SHIFT))).alias("_b"))
    return points.withColumn("_b", F.shiftright("x", BUCKET_SHIFT)).join(spread, ["z", "_b"]).filter("x between x0 and x1").drop("_b", "x0", "x1")


def spatial_index(runs: DataFrame, key: str = "id", shift: int = BUCKET_SHIFT) -> DataFrame:
    """(cell_x, cell_z, region_ids): the regions that meet every index cell, in order."""
    pairs = runs.select(F.col(key), F.shiftright("z", shift).alias("cell_z"), F.explode(F.sequence(F.shiftright("x0", shift), F.shiftright("x1", shift))).alias("cell_x")).distinct()
    return pairs.groupBy("cell_x", "cell_z").agg(F.sort_array(F.collect_list(key)).alias("region_ids"))


def lookup(points: DataFrame, runs: DataFrame, key: str = "id") -> DataFrame:
    """points with the region that contains each (null: none): runs are met by row and column bucket, so a point sees only the runs of its row nearby."""
    hits = contains(points.select("x", "z").distinct(), runs, key).groupBy("x", "z").agg(F.min(key).alias(key))
    return points.join(hits, ["x", "z"], "left")


def ocean_sheets(cells: DataFrame, min_columns: int) -> DataFrame:
    """(cx, cz, sheet, columns) of ocean cells (no cave majority) in 4-connected sheets of at least min_columns columns."""
    from .runs import label

    wet = cells.filter((F.col("family") == blocks.OCEAN) & (F.col("water_cols") > 0) & (F.col("cave_cols") * 2 < F.col("water_cols")))
    runs = label(wet.select(F.col("cx").alias("x"), F.col("cz").alias("z")))
    placed = contains(wet.select(F.col("cx").alias("x"), F.col("cz").alias("z"), "water_cols"), runs, "component")
    sizes = placed.groupBy("component").agg(F.sum("water_cols").cast("long").alias("columns")).filter(F.col("columns") >= min_columns)
    return placed.join(sizes, "component").select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.col("component").alias("sheet"), "columns")


def largest_sheets(sheets: DataFrame, most: int = 48) -> DataFrame:
    """(sheet, columns) of the largest sheets of ocean_sheets()."""
    return sheets.select("sheet", "columns").distinct().orderBy(F.desc("columns"), "sheet").limit(most)


def kind_and_modifier_counts(regions: DataFrame, small_river: int = 20_000, small_sea: int = 10_000) -> DataFrame:
    """One row: regions by kind, by modifier, and rivers and seas (no caves) under a size. regions: (kind, modifiers, column_count)."""
    has = lambda k: F.col("modifiers").bitwiseAND(F.lit(1 << k)) != 0
    by_kind = [F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(water.KINDS)]
    by_bit = [F.count_if(has(k)).alias(f"with_{n}") for k, n in enumerate(water.MODIFIERS)]
    small = lambda kind, most: F.count_if((F.col("kind") == kind) & ~has(4) & (F.col("column_count") < most))
    return regions.agg(*by_kind, *by_bit, small(water.RIVER_KIND, small_river).alias("small_rivers"), small(water.SEA, small_sea).alias("small_seas"))
