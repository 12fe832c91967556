"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until every splitter is met.

Rows are ordered by a 60-bit digest of (id, text), ties by their position in the
key table. Each round counts bytes and rows of the cells between equally spaced
candidate boundaries (one map-side combined aggregation over the compact key
table), keeps the cells that hold a wanted splitter, and probes only inside them.
When each remaining cell meets the tolerance, rows are exchanged once, by cell.

Defined results. A null text has size 16 and the checksum of the empty text; a
null id is a value like any other; repeated rows are dealt like different rows;
an empty table gives an empty result; further columns named in ``carry`` pass
through, and a carried column whose name clashes with a result column is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import crc_of, settle

KEY_BITS = 60
FIRST_BITS, STEP_BITS = 12, 8
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _cells() -> list[tuple[Column, Column]]:
    """Cell of a row, from coarse to fine: first by key, then by key and tie."""
    out, shift = [], KEY_BITS - FIRST_BITS
    while True:
        out.append((F.shiftright("_key", shift), F.lit(0).cast("long")))
        if not shift:
            break
        shift = max(0, shift - STEP_BITS)
    return out + [(F.col("_key"), F.shiftright("_tie", s)) for s in (33, 22, 11, 0)]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows into shards 0..shards-1 of nearly equal bytes (law ``bytes``).

    tolerance: bytes by which a splitter may miss, as a share of a shard; with 0
    splitters fall exactly between two rows. Cells number at most 4096 plus 256 for
    each refined one, whatever the rows; only their sums reach the driver.
    """
    spark = docs.sparkSession
    if clash := {c.lower() for c in carry} & {*RESULT, id_col.lower()}:
        raise ValueError(f"carried columns clash with the result: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    keys = settle(
        docs.select(
            F.col(id_col),
            *carry,
            size.alias("size"),
            crc_of(F.col(text_col)).alias("text_crc32"),
            F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("_key"),
            F.monotonically_increasing_id().alias("_tie"),
        )
    )
    cells = _cells()
    leaves, inside, rows_most = {}, [], 0
    for level, (hi, lo) in enumerate(cells):
        within = keys.filter(_member(cells[level - 1], inside[-1])) if inside else keys
        found = within.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        if not level:
            total, count = sum(r.b for r in found), sum(r.n for r in found)
            rows_most = max(4 * count // (1 << FIRST_BITS), 20_000)
        leaves.update({(*_path(level, r.hi, r.lo), level): (r.b, r.n, r.hi, r.lo) for r in found})
        open_cells, below = [], 0
        for place in sorted(leaves):
            b, n, hi_, lo_ = leaves[place]
            cut = below * shards // max(total, 1) != (below + b - 1) * shards // max(total, 1)
            if n > 1 and (cut and b > tolerance * total / shards or n > rows_most) and place[-1] == level:
                open_cells.append((hi_, lo_, place))
            below += b
        if not open_cells or level + 1 == len(cells):
            break
        for *_, place in open_cells:
            del leaves[place]
        inside.append([(h, x) for h, x, _ in open_cells])
    plan, below, filled = [], 0, [0] * shards
    for place in sorted(leaves):
        b, n, hi_, lo_ = leaves[place]
        shard = min(shards - 1, (2 * below + b) * shards // (2 * total))
        plan.append((place[-1], hi_, lo_, shard, filled[shard]))
        filled[shard] += n
        below += b
    schema = T.StructType([T.StructField("_level", T.IntegerType()), T.StructField("_hi", T.LongType()), T.StructField("_lo", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    cell = F.struct(F.lit(len(inside)).alias("_level"), cells[len(inside)][0].alias("_hi"), cells[len(inside)][1].alias("_lo"))
    for level in range(len(inside) - 1, -1, -1):
        here = F.struct(F.lit(level).alias("_level"), cells[level][0].alias("_hi"), cells[level][1].alias("_lo"))
        cell = F.when(_member(cells[level], inside[level]), cell).otherwise(here)
    dealt = keys.withColumn("_cell", cell).withColumns({c: F.col(f"_cell.{c}") for c in ("_level", "_hi", "_lo")})
    dealt = dealt.join(F.broadcast(spark.createDataFrame(plan, schema)), ["_level", "_hi", "_lo"])
    order = W.partitionBy("_level", "_hi", "_lo").orderBy("_key", "_tie")
    return dealt.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def _path(level: int, hi: int, lo: int) -> tuple[int, int]:
    """The least (key, tie) of a cell, so that cells of all levels sort together."""
    keyed, shift = [KEY_BITS - FIRST_BITS], KEY_BITS - FIRST_BITS
    while shift:
        shift = max(0, shift - STEP_BITS)
        keyed.append(shift)
    if level < len(keyed):
        return hi << keyed[level], 0
    return hi, lo << (33, 22, 11, 0)[level - len(keyed)]


def _member(cell: tuple[Column, Column], chosen: list[tuple[int, int]]) -> Column:
    hi, lo = cell
    if all(x == 0 for _, x in chosen):
        return hi.isin([h for h, _ in chosen]) & (lo == 0)
    return F.concat_ws(":", hi, lo).isin([f"{h}:{x}" for h, x in chosen])
