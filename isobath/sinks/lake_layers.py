"""Reports of the lake analysis: candidates as JSON, exact labels as runs, and ten images of its layers."""

from __future__ import annotations

import json
import struct
from dataclasses import asdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colours
from ..operators.runs import encode
from ..options import LakeOptions
from ..session import cut
from . import legend, maps
from .painters import Projection

# The layers' colours, and the largest distance that the width layer tells apart.
WATER, LAKE, CORE, NECK, REJECTED = 0x3E6978, 0x3AE1CD, 0xFCE358, 0xFF8F3C, 0xEA5070
INFLOW, OUTFLOW, UNKNOWN = 0x74F679, 0x82A5FF, 0xF5F5F5
FARTHEST = 64
MAGIC = b"LKRUNS01"


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates with a number from 1 over all bodies, in the order of body and core."""
    from ..operators.runs import number_in_order

    return number_in_order(candidates, ["body", "lake"], "candidate", first=1)


def layers(columns: DataFrame, measures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Columns (x, z, source, body, lake, core, neck, is_lake, river) with the value each layer gives them; the largest in a pixel shows.

    measures: (x, z, distance, d8, d16, d32); verdicts: (body, lake, accepted, takes_rivers).
    """
    of = lambda side: verdicts.select("body", F.col("lake").alias(side), F.col("accepted").alias(f"{side}_accepted"), F.col("takes_rivers").alias(f"{side}_takes"))
    rows = columns.join(measures, ["x", "z"]).join(of("core"), ["body", "core"], "left").withColumn("shown", F.when(F.col("lake") > 0, F.col("lake")).otherwise(F.col("core")))
    rows = rows.join(of("shown"), ["body", "shown"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    refused = (F.col("shown") > 0) & ~F.col("is_lake") & (~yes("shown_accepted") | (F.col("river") & ~yes("shown_takes")))
    one = lambda test: F.when(test, 2).otherwise(1)
    return rows.select("x", "z", F.lit(1).alias("raw_inland"), (F.least("distance", F.lit(FARTHEST)) + 1).alias("distance_width"), *[(F.col(f"d{r}") + 1).alias(f"density_{r}") for r in (8, 16, 32)], F.when(F.col("core") == 0, 1).when(yes("core_accepted"), 3).otherwise(2).alias("cores"), one(F.col("is_lake")).alias("reconstructed"), one(F.col("neck")).alias("necks"), one(F.col("is_lake")).alias("connections"), one(refused).alias("rejected"))


NAMES = ("raw_inland", "distance_width", "density_8", "density_16", "density_32", "cores", "reconstructed", "necks", "connections", "rejected")


def reduced(rows: DataFrame, p: Projection) -> DataFrame:
    """(px, pz, layers...): the largest value of each layer in a pixel."""
    return rows.groupBy(p.px("x").alias("px"), p.pz("z").alias("pz")).agg(*[F.max(n).alias(n) for n in NAMES])


def palette(layer: str) -> np.ndarray:
    """Colour of every value of a layer; 0 is no inland water."""
    if layer == "raw_inland":
        return np.array([colours.VOID, LAKE])
    if layer == "distance_width":
        return np.array([colours.VOID, *(colours.share_ramp(k / FARTHEST) for k in range(FARTHEST + 1))])
    if layer.startswith("density"):
        return np.array([colours.VOID, *(colours.share_ramp(k / 255) for k in range(256))])
    if layer == "cores":
        return np.array([colours.VOID, WATER, REJECTED, CORE])
    return np.array([colours.VOID, WATER, {"necks": NECK, "rejected": REJECTED}.get(layer, LAKE)])


def write_images(folder: str, rows: DataFrame, contacts: DataFrame, bounds: tuple[int, int, int, int], scale: int) -> list[str]:
    """Write the ten layers; connections are marked by crosses in the colour of their direction."""
    p = Projection(*bounds, scale)
    wide, high = p.size
    if wide * high > maps.MAX_PIXELS:
        raise ValueError("the map has too many pixels; take a larger scale")
    table = reduced(rows, p).toArrow()
    at = np.array(table["pz"]), np.array(table["px"])
    marks = contacts.select(p.px("x").alias("px"), p.pz("z").alias("pz"), "head").toArrow().to_pylist()
    out = []
    for name in NAMES:
        title = [legend.heading(f"LAKE {name.replace('_', ' ')}".upper())]
        margin = legend.width(title, 1)
        value = np.zeros((high, wide), np.int64)
        value[at] = np.array(table[name])
        color = palette(name)[value]
        if name == "connections":
            for m in marks:
                tone = UNKNOWN if m["head"] is None or abs(m["head"]) < 1 else INFLOW if m["head"] > 0 else OUTFLOW
                color[max(0, m["pz"] - 2) : m["pz"] + 3, m["px"]] = tone
                color[m["pz"], max(0, m["px"] - 2) : m["px"] + 3] = tone
        image = np.zeros((max(high, legend.height(title, 1)), margin + wide, 3), np.uint8)
        image[:high, margin:] = np.stack([color >> s & 255 for s in (16, 8, 0)], -1)
        legend.draw(image, title, margin, 1)
        (Path(folder) / f"lake_{name}.png").write_bytes(maps.png(image))
        out.append(f"lake_{name}.png")
    return out


def candidate_runs(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, candidate, z, x0, x1) in raster order: runs of one source and candidate inside a row of a 32-column tile."""
    marked = columns.join(candidates.select("body", "lake", "candidate"), ["body", "lake"], "left").select("x", "z", "source", F.coalesce("candidate", F.lit(0)).alias("candidate"), F.shiftright("x", 5).alias("tx"))
    lines = encode(marked, "source", "candidate", "tx")
    return lines.orderBy(F.shiftright("z", 5), "tx", "z", "x0").select("source", "candidate", "z", "x0", "x1")


def write_runs(path: str, rows: DataFrame) -> int:
    """The runs file: a magic word and little-endian records of 20 bytes, streamed in order; its bytes."""
    size = len(MAGIC)
    with Path(path).open("wb") as out:
        out.write(MAGIC)
        for r in rows.toLocalIterator():
            size += out.write(struct.pack("<IIiii", *r))
    return size


def write(folder: str, tables: dict[str, DataFrame], measures: DataFrame, sources: DataFrame, bounds: tuple[int, int, int, int], scale: int, options: LakeOptions) -> dict:
    """Write lake_candidates.json, lake_candidate_runs.bin and the ten images; returns the head of the JSON."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    candidates = cut(numbered(tables["candidates"]))
    accepted = F.col("rejection").isNull()
    new = accepted & F.col("new_lake_rejection").isNull()
    counts = candidates.agg(F.count_if(accepted).alias("accepted_candidate_count"), F.count_if(new).alias("river_promotion_candidate_count"), F.count_if(~accepted).alias("rejected_candidate_count")).first().asDict()
    head = {"analysis_blocks_per_cell": 1, "render_blocks_per_pixel": scale, "world_bounds": list(bounds), "inland_water_columns": tables["columns"].count(), **counts, "options": asdict(options)}
    with (Path(folder) / "lake_candidates.json").open("w") as out:
        out.write(json.dumps(head)[:-1])
        for name, rows in (("candidates", candidates.orderBy("candidate")), ("connections", tables["contacts"].orderBy("body", "lake", "x", "z")), ("closed_water", tables["closed"].orderBy("id"))):
            out.write(f', "{name}": [')
            for k, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator()):
                out.write((",\n" if k else "\n") + r[0])
            out.write("]")
        out.write("}\n")
    write_runs(str(Path(folder) / "lake_candidate_runs.bin"), candidate_runs(tables["columns"], candidates))
    verdicts = candidates.select("body", "lake", accepted.alias("accepted"), new.alias("takes_rivers"))
    river = sources.select(F.col("id").alias("source"), (F.col("kind") == 1).alias("river"))
    write_images(folder, layers(tables["columns"].join(river, "source"), measures, verdicts), tables["contacts"], bounds, scale)
    return head
