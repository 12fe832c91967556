"""Connected components of an edge table: contraction within partitions, then alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond (SoCC 2014). Before every round
each partition's edges are contracted to stars in bounded lots, so that what lies together costs no
round; the steps between partitions are grouped minima with map-side combination and equi-joins that adaptive
execution can split where a vertex has very many edges. All state stays in DataFrames and the
shared folder; rounds grow with the logarithm of the longest path between partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Edges that a partition contracts at once.
LOT = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jumped := new[new] != new).any():
            new = np.where(jumped, new[new], new)
        if (new == label).all():
            return label
        label = new


def _stars_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    lot = pa.Table.from_batches(parts)
    nodes, ends = np.unique(np.concatenate([lot["u"].to_numpy(), lot["v"].to_numpy()]), return_inverse=True)
    label = least_labels(ends[: lot.num_rows], ends[lot.num_rows :], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own], lot.schema.field("u").type), pa.array(nodes[label[own]], lot.schema.field("v").type)], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to stars around their least nodes, LOT edges at a time; an edge of a lot stays a path in its stars."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
        if size >= LOT:
            stars = _stars_of(waiting)
            # stars that take up half a lot no longer shrink: they go out, so that the lot stays bounded
            waiting, size = [stars], stars.num_rows
            if size >= LOT // 2:
                yield stars
                waiting, size = [], 0
    if waiting:
        yield _stars_of(waiting)


def _unsettled(stars: DataFrame) -> bool:
    """Does a node hang on two others, or on one that hangs itself?"""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return not ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node. Nulls are no nodes."""
    kind = edges.schema[a].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    drawn = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).filter("u <> v")
    now = cut(drawn.mapInArrow(_contract, schema))
    for _ in range(most_rounds):
        if not _unsettled(now):
            break
        now = cut(_small_star(_large_star(now).distinct()).distinct().mapInArrow(_contract, schema))
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
