"""The driver's business tables seen as rasters, so that every raster operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks

BIOME_OF = {"1-URGENT": ("minecraft:warm_ocean", "minecraft:cold_ocean"), "2-HIGH": ("minecraft:river", "minecraft:frozen_river"), "3-MEDIUM": ("minecraft:swamp", "minecraft:mangrove_swamp"), "4-NOT SPECIFIED": ("minecraft:desert", "minecraft:plains")}
OTHER = ("minecraft:forest", "pack:unknown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column an order: x, z (negatives too), status, biome, surface_y, floor_y, ice, covered, customer."""
    orders = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    biome = F.lit(None).cast("string")
    odd = customer % 2 == 1
    biome = F.when(odd, OTHER[1]).otherwise(OTHER[0])
    for priority, (even_name, odd_name) in BIOME_OF.items():
        biome = F.when(F.col("o_orderpriority") == priority, F.when(odd, odd_name).otherwise(even_name)).otherwise(biome)
    return orders.select(
        (key.bitwiseAND(F.lit(127)) - 64).cast("int").alias("x"),
        (F.shiftright(key, 7) - 37).cast("int").alias("z"),
        F.col("o_orderstatus").alias("status"),
        biome.alias("biome"),
        (62 - customer % 7).cast("int").alias("surface_y"),
        (62 - customer % 7 - customer % 53).cast("int").alias("floor_y"),
        (customer % 3 == 0).alias("ice"),
        (customer % 5 == 0).alias("covered"),
        customer.alias("customer"),
        key.alias("order_key"),
    )


def water(spark: SparkSession, sf_dir: str, *status: str) -> DataFrame:
    return raster(spark, sf_dir).filter(F.col("status").isin(*(status or ("O",))))


#: The same raster as SQL common table expressions.
SQL = """
grid AS (
  SELECT CAST((o_orderkey & 127) - 64 AS INTEGER) AS x, CAST((o_orderkey >> 7) - 37 AS INTEGER) AS z, o_orderstatus AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_custkey % 2 = 1 THEN 'minecraft:cold_ocean' ELSE 'minecraft:warm_ocean' END
      WHEN '2-HIGH' THEN CASE WHEN o_custkey % 2 = 1 THEN 'minecraft:frozen_river' ELSE 'minecraft:river' END
      WHEN '3-MEDIUM' THEN CASE WHEN o_custkey % 2 = 1 THEN 'minecraft:mangrove_swamp' ELSE 'minecraft:swamp' END
      WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_custkey % 2 = 1 THEN 'minecraft:plains' ELSE 'minecraft:desert' END
      ELSE CASE WHEN o_custkey % 2 = 1 THEN 'pack:unknown' ELSE 'minecraft:forest' END END AS biome,
    CAST(62 - o_custkey % 7 AS INTEGER) AS surface_y, CAST(62 - o_custkey % 7 - o_custkey % 53 AS INTEGER) AS floor_y,
    o_custkey % 3 = 0 AS ice, o_custkey % 5 = 0 AS covered, o_custkey AS customer, o_orderkey AS order_key
  FROM orders
), wet AS (SELECT * FROM grid WHERE status = 'O')
"""


def segments_of(cells: DataFrame) -> DataFrame:
    return cells.withColumn("family", blocks.family(F.col("biome")))
