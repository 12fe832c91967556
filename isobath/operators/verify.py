"""Checks of results against the masks they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runs import explode_runs


def mask_difference(columns: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: columns of the mask, columns that runs lost or gained, runs that overlap another of their row."""
    covered = explode_runs(runs.select("z", "x0", "x1"))
    both = columns.select("x", "z", F.lit(1).alias("m"), F.lit(0).alias("r")).unionByName(covered.select("x", "z", F.lit(0).alias("m"), F.lit(1).alias("r"))).groupBy("x", "z").agg(F.max("m").alias("m"), F.max("r").alias("r"))
    counts = both.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("columns"), F.count_if((F.col("m") == 1) & (F.col("r") == 0)).alias("lost"), F.count_if((F.col("m") == 0) & (F.col("r") == 1)).alias("gained"))
    following = F.lead("x0").over(W.partitionBy("z").orderBy("x0", "x1"))
    overlaps = runs.select("z", "x0", "x1", following.alias("n")).agg(F.count_if(F.col("n") <= F.col("x1")).alias("overlaps"))
    return counts.crossJoin(F.broadcast(overlaps))
