"""Run-length relations: encoding, merging, adjacency, perimeters, labels and canonical numbers.

A run is (z, x0, x1), both ends inside. It stands for hundreds of columns, so that all
graph work is done on runs. Interval joins are equi-joins on a row and a bucket of
``BUCKET`` columns, which bounds the rows that meet in one key whatever the raster's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut
from .graph import components

BUCKET_SHIFT = 6


def encode(columns: DataFrame, *keys: str) -> DataFrame:
    """(x, z, keys...) to maximal runs (keys..., z, x0, x1) of touching columns with equal keys."""
    place = W.partitionBy(*keys, "z").orderBy("x")
    return columns.select(*keys, "x", "z").distinct().withColumn("_island", F.col("x") - F.row_number().over(place)).groupBy(*keys, "z", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def coalesce_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Join touching or overlapping runs of equal keys."""
    place = W.partitionBy(*keys, "z").orderBy("x0", "x1")
    before = F.max("x1").over(place.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(F.col("x0") <= before + 1, 0).otherwise(1))
    return marked.withColumn("_part", F.sum("_new").over(place)).groupBy(*keys, "z", "_part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_part")


def explode_runs(runs: DataFrame) -> DataFrame:
    """Columns (x) of every run; other columns are repeated."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def _bucketed(runs: DataFrame, names: dict[str, str], reach: int = 0) -> DataFrame:
    shifted = lambda c, by: F.shiftright(F.col(c) + by, BUCKET_SHIFT)
    out = runs.select(*[F.col(a).alias(b) for a, b in names.items()], F.explode(F.sequence(shifted("x0", -reach), shifted("x1", reach))).alias("_bucket"))
    return out


def contacts(runs: DataFrame, key: str = "region_id") -> DataFrame:
    """(ka, kb, w): shared edge length of every two touching runs, from the run above or left to the other; equal keys included."""
    down = _bucketed(runs, {key: "ka", "z": "za", "x0": "a0", "x1": "a1"})
    up = _bucketed(runs, {key: "kb", "z": "zb", "x0": "b0", "x1": "b1"})
    first = F.shiftleft(F.col("_bucket"), BUCKET_SHIFT)
    lo, hi = F.greatest("a0", "b0", first), F.least("a1", "b1", first + (1 << BUCKET_SHIFT) - 1)
    vertical = down.withColumn("zb", F.col("za") + 1).join(up, ["zb", "_bucket"]).filter(lo <= hi).select("ka", "kb", (hi - lo + 1).cast("long").alias("w"))
    ends = runs.select(F.col(key).alias("ka"), "z", (F.col("x1") + 1).alias("x0"))
    starts = runs.select(F.col(key).alias("kb"), "z", "x0")
    side = ends.join(starts, ["z", "x0"]).select("ka", "kb", F.lit(1).cast("long").alias("w"))
    return vertical.unionByName(side)


def adjacency(runs: DataFrame, key: str = "region_id") -> DataFrame:
    """(a, b, w) with a < b: shared edge length of different regions."""
    found = contacts(runs, key).filter("ka <> kb")
    return found.groupBy(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).agg(F.sum("w").alias("w"))


def perimeters(runs: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, area, perimeter) of every region."""
    own = runs.groupBy(key).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"), F.sum((2 + 2 * (F.col("x1") - F.col("x0") + 1)).cast("long")).alias("_edges"))
    inner = contacts(runs, key).filter("ka = kb").groupBy(F.col("ka").alias(key)).agg(F.sum("w").alias("_inner"))
    return own.join(inner, key, "left").select(key, "area", (F.col("_edges") - 2 * F.coalesce("_inner", F.lit(0))).alias("perimeter"))


def number_in_order(rows: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """rows with dense numbers in a total order, without a window over all rows.

    Rows are range-partitioned and sorted once; one count a partition reaches the driver.
    """
    spark = rows.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    before, starts = first, []
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect()):
        starts.append((r["_part"], before - r["low"]))
        before += r["n"]
    shift = spark.createDataFrame(starts or [(-1, 0)], "_part int, _shift long")
    return dealt.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _run_code() -> Column:
    """A run's number from its place; 2**31 rows of 2**31 columns."""
    return F.shiftleft(F.col("z").cast("long"), 32) + F.col("x0").cast("long")


def label(columns: DataFrame, key: str | None = None) -> DataFrame:
    """Runs (key, z, x0, x1, component) of 4-connected columns with equal keys; components are named by their least run code."""
    keyed = columns if key else columns.withColumn("_key", F.lit(0))
    name = key or "_key"
    runs = cut(encode(keyed, name).withColumn("_code", _run_code()))
    return label_runs(runs, name, "_code").drop("_code", *([] if key else ["_key"]))


def label_runs(runs: DataFrame, key: str, code: str) -> DataFrame:
    """runs with a component: runs of equal keys that touch belong together."""
    packed = runs.withColumn("_both", F.struct(code, key))
    links = contacts(packed, "_both").filter(f"ka.`{key}` = kb.`{key}`").select(F.col(f"ka.{code}").alias("a"), F.col(f"kb.{code}").alias("b"))
    found = components(links, "a", "b").select(F.col("node").alias(code), "component")
    return runs.join(found, code, "left").withColumn("component", F.coalesce("component", code))


def canonical(labelled: DataFrame, tile_shift: int = 9) -> DataFrame:
    """labelled runs with dense component ids in the order of first cells by (tile row, tile column, z, x)."""
    pieces = labelled.withColumn("_tile", F.explode(F.sequence(F.shiftright("x0", tile_shift), F.shiftright("x1", tile_shift))))
    start = F.greatest(F.col("x0"), F.shiftleft("_tile", tile_shift))
    first = pieces.groupBy("component").agg(F.min(F.struct(F.shiftright("z", tile_shift).alias("tz"), F.col("_tile").alias("tx"), F.col("z"), start.alias("x"))).alias("f"))
    flat = first.select("component", "f.tz", "f.tx", F.col("f.z").alias("fz"), F.col("f.x").alias("fx"))
    numbered = number_in_order(flat, ["tz", "tx", "fz", "fx"], "id").select("component", "id")
    return labelled.join(numbered, "component").drop("component")


def measures(runs: DataFrame, key: str = "id") -> DataFrame:
    """Area, runs and bounds of every region."""
    return runs.groupBy(key).agg(
        F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"),
        F.count("*").alias("runs"),
        F.min("x0").alias("min_x"),
        F.min("z").alias("min_z"),
        F.max("x1").alias("max_x"),
        F.max("z").alias("max_z"),
    )


LONG = T.LongType()
