"""Region files: location tables, compressed chunks, packed sections, and the column probe.

Files are read by Spark's binaryFile source, one task a file or more, and each chunk is decoded by
one vectorised kernel in mapInArrow; the decoder keeps only the tags that the probe needs.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..session import cut
from . import nbt

COVER_PROBE, FLOOR_PROBE = 8, 160
_NAME = re.compile(r"r\.(-?\d+)\.(-?\d+)\.mca$")
_WANT_SECTION = {"Y": None, "block_states": {"palette": {"Name": None, "id": None, "": None, "Properties": None}, "data": None}, "biomes": {"palette": None, "data": None}}
WANT = {"xPos": None, "zPos": None, "yPos": None, "DataVersion": None, "Status": None, "Heightmaps": {"MOTION_BLOCKING": None, "OCEAN_FLOOR": None, "WORLD_SURFACE": None}, "sections": _WANT_SECTION}


def region_coords(path: str) -> tuple[int, int] | None:
    found = _NAME.search(path)
    return (int(found[1]), int(found[2])) if found else None


def chunk_payloads(raw: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
    """(index, compression, is external, payload) of every sound entry of a region file; others are passed over."""
    if len(raw) < 8192:
        return
    for index in range(1024):
        entry = struct.unpack(">I", raw[4 * index : 4 * index + 4])[0]
        offset, sectors = entry >> 8, entry & 255
        at = offset * 4096
        if offset < 2 or not sectors or at + 5 > len(raw):
            continue
        length = struct.unpack(">I", raw[at : at + 4])[0]
        if not length or at + 4 + length > len(raw):
            continue
        kind = raw[at + 4]
        yield index, kind & 0x7F, bool(kind & 0x80), raw[at + 5 : at + 4 + length]


def inflate(kind: int, payload: bytes) -> bytes:
    if kind == 1:
        return gzip.decompress(payload)
    if kind == 2:
        return zlib.decompress(payload)
    if kind == 3:
        return payload
    raise ValueError(f"unknown compression {kind}")


def unpack_bits(longs: np.ndarray, bits: int, count: int) -> np.ndarray:
    """count values of so many bits each, none of which crosses a long."""
    per = 64 // bits
    words = longs.astype(">i8").astype(np.int64).view(np.uint64)
    shifts = (np.arange(per) * bits).astype(np.uint64)
    values = (words[:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = np.zeros(count, np.int64)
    flat = values.ravel()[:count].astype(np.int64)
    out[: len(flat)] = flat
    return out


def heightmap(longs: np.ndarray | None) -> np.ndarray | None:
    """256 heights above the lowest section (0: nothing)."""
    if longs is None or not len(longs):
        return None
    per = -(-256 // len(longs))
    return unpack_bits(longs, 64 // per, 256)


def parse_chunk(raw: bytes) -> dict | None:
    """A fully generated chunk, or None."""
    chunk = nbt.read(raw, WANT)
    return chunk if chunk.get("Status") in ("full", "minecraft:full") else None


def block_entry(entry) -> tuple[str, bool, int | None]:
    """(name, waterlogged, level) of a palette entry in any of its three shapes; an unreadable level counts as no source."""
    if isinstance(entry, str):
        return entry, False, None
    name = entry.get("Name") or entry.get("id") or entry.get("") or ""
    own = entry.get("Properties") or {}
    level = own.get("level")
    if level is not None:
        level = int(level) if str(level).isdigit() and int(level) < 255 else 255
    return name, str(own.get("waterlogged", "false")) == "true", level


def class_of(name: str, waterlogged: bool, level: int | None) -> int:
    """The class code of blocks.block_class, for one palette entry."""
    block = name.partition(":")[2] if ":" in name else name
    plain = {**dict.fromkeys(blocks.AIR_BLOCKS, blocks.AIR), **dict.fromkeys(blocks.LAVA_BLOCKS, blocks.LAVA), **dict.fromkeys(blocks.ICE_BLOCKS, blocks.ICE), **dict.fromkeys((*blocks.WATERY_BLOCKS, "mud"), blocks.WATER), "flowing_water": blocks.SOLID}
    if block == "water":
        return blocks.SOLID if level else blocks.WATER
    if block in plain:
        return plain[block]
    if waterlogged:
        return blocks.WATER
    return blocks.COVER if block in blocks.COVER_BLOCKS else blocks.SOLID


class Volume:
    """Classes of all blocks of a chunk as one array (y, z, x); missing sections are air."""

    def __init__(self, chunk: dict):
        own = [s for s in chunk.get("sections", []) if "Y" in s]
        self.low = 16 * min((int(s["Y"]) for s in own), default=int(chunk.get("yPos", -4)))
        high = 16 * max((int(s["Y"]) for s in own), default=int(chunk.get("yPos", -4))) + 16
        self.classes = np.full((max(0, high - self.low), 16, 16), blocks.AIR, np.uint8)
        self.coral = self.plants = self.water = self.mud = False
        self.biomes: dict[int, tuple[list[str], np.ndarray]] = {}
        self.palettes: dict[int, list[str]] = {}
        for s in own:
            y = 16 * int(s["Y"]) - self.low
            states = s.get("block_states") or {}
            entries = [block_entry(e) for e in states.get("palette", [])]
            codes = np.array([class_of(*e) for e in entries] or [blocks.AIR], np.uint8)
            self.palettes[int(s["Y"])] = [e[0].partition(":")[2] if ":" in e[0] else e[0] for e in entries]
            data = states.get("data")
            if len(codes) == 1 or data is None:
                self.classes[y : y + 16] = codes[0] if len(codes) == 1 else blocks.SOLID
            else:
                bits = max(4, (len(codes) - 1).bit_length())
                self.classes[y : y + 16] = codes[np.minimum(unpack_bits(data, bits, 4096), len(codes) - 1)].reshape(16, 16, 16)
            self.water |= bool((codes == blocks.WATER).any())
            own_biomes = s.get("biomes") or {}
            names = list(own_biomes.get("palette", []))
            if names:
                data = own_biomes.get("data")
                bits = (len(names) - 1).bit_length()
                picks = unpack_bits(data, bits, 64) if data is not None and bits else np.zeros(64, np.int64)
                self.biomes[int(s["Y"])] = names, np.minimum(picks, len(names) - 1)

    def at(self, x, y: np.ndarray, z) -> np.ndarray:
        inside = (y >= self.low) & (y < self.low + len(self.classes))
        got = self.classes[np.clip(y - self.low, 0, max(len(self.classes) - 1, 0)), z, x] if len(self.classes) else np.zeros(np.shape(y), np.uint8)
        return np.where(inside, got, blocks.AIR)

    def biome(self, x: int, y: int, z: int) -> str | None:
        names, picks = self.biomes.get(y >> 4, (None, None))
        return names[picks[((y & 15) >> 2) * 16 + (z >> 2) * 4 + (x >> 2)]] or None if names else None

    def flags(self, lo: int, hi: int) -> tuple[bool, bool, bool]:
        """(water, coral, plants) in the palettes of the sections that meet lo..hi."""
        names = [n for y, own in self.palettes.items() if 16 * y <= hi and 16 * y + 15 >= lo for n in own]
        water = any(((self.classes[16 * y - self.low : 16 * y - self.low + 16] == blocks.WATER).any()) for y in self.palettes if 16 * y <= hi and 16 * y + 15 >= lo)
        return water, any("coral" in n and not n.startswith("dead_") for n in names), any(n in blocks.AQUATIC_PLANTS for n in names)


def floor_below(v: Volume, x: np.ndarray, z: np.ndarray, surface: np.ndarray) -> np.ndarray:
    """First y below each surface that is no water, at most FLOOR_PROBE below."""
    y, live = surface - 1, np.ones(len(surface), bool)
    for _ in range(FLOOR_PROBE - 1):
        live &= v.at(x, y, z) == blocks.WATER
        if not live.any():
            break
        y = np.where(live, y - 1, y)
    return np.maximum(y, surface - FLOOR_PROBE)


def probe_columns(chunk: dict, caves: bool = True, min_y: int | None = None) -> list[tuple]:
    """(x, z, surface_y, floor_y, ice, covered, coral, plants, biome) of the chunk's water columns, in world coordinates.

    caves: also the topmost roofed water of columns without open water. Depth below a thin cover is
    measured once for each 4x4 cell, at its first such column.
    """
    maps = chunk.get("Heightmaps", {})
    top = heightmap(maps.get("MOTION_BLOCKING"))
    top = heightmap(maps.get("WORLD_SURFACE")) if top is None else top
    if top is None or not chunk.get("sections"):
        return []
    bed = heightmap(maps.get("OCEAN_FLOOR"))
    low = 16 * int(chunk.get("yPos", -4))
    v = Volume(chunk)
    known = top > 0
    if not known.any():
        return []
    tops = low + top - 1
    z, x = np.divmod(np.arange(256), 16)
    band_hi = int(tops[known].max())
    fluid = known & (top > bed) if bed is not None else np.zeros(256, bool)
    band_lo = max(int((low + bed - 1)[fluid].min()), band_hi - FLOOR_PROBE) if fluid.any() else band_hi - COVER_PROBE
    if caves or any("mud" in own for own in v.palettes.values()):
        band_lo, band_hi = -(1 << 30), 1 << 30
    water, coral, plants = v.flags(band_lo, band_hi)
    if not water:
        return []
    first = v.at(x, tops, z)
    found: dict[int, tuple[int, int, bool, bool]] = {}
    open_ = np.flatnonzero(known & (first == blocks.WATER))
    if len(open_):
        hint = low + bed[open_] - 1 if bed is not None else np.full(len(open_), 1 << 30)
        usable = (bed[open_] > 0) & (hint < tops[open_]) if bed is not None else np.zeros(len(open_), bool)
        wet = usable & (v.at(x[open_], hint, z[open_]) == blocks.WATER)
        start = np.where(wet, hint, tops[open_])
        floor = np.where(usable & ~wet, hint, floor_below(v, x[open_], z[open_], start))
        for k, i in enumerate(open_):
            found[int(i)] = int(tops[i]), int(floor[k]), False, False
    depth_of: dict[int, int] = {}
    for i in np.flatnonzero(known & np.isin(first, (blocks.AIR, blocks.ICE, blocks.COVER))):
        ice = first[i] == blocks.ICE
        for step in range(1, COVER_PROBE + 1):
            y = int(tops[i]) - step
            here = int(v.at(x[i], np.array(y), z[i]))
            if here == blocks.WATER:
                cell = (z[i] >> 2) * 4 + (x[i] >> 2)
                if cell not in depth_of:
                    depth_of[cell] = max(0, y - int(floor_below(v, x[i : i + 1], z[i : i + 1], np.array([y]))[0]))
                found[int(i)] = y, y - depth_of[cell], bool(ice), False
                break
            if here not in (blocks.AIR, blocks.ICE, blocks.COVER):
                break
            ice |= here == blocks.ICE
    accepted = {i: c for i, c in found.items() if min_y is None or c[0] >= min_y}
    if caves:
        wet = v.classes == blocks.WATER
        heights = v.low + np.arange(len(v.classes))
        for i in np.flatnonzero(known):
            if int(i) in accepted:
                continue
            ok = wet[:, z[i], x[i]] & (heights < tops[i]) & (heights >= (min_y if min_y is not None else -(1 << 30)))
            if ok.any():
                y = int(heights[np.flatnonzero(ok)[-1]])
                accepted[int(i)] = y, int(floor_below(v, x[i : i + 1], z[i : i + 1], np.array([y]))[0]), False, True
    base_x, base_z = 16 * int(chunk["xPos"]), 16 * int(chunk["zPos"])
    sums: dict[int, list[int]] = {}
    for i, c in accepted.items():
        sums.setdefault((int(z[i]) >> 2) * 4 + (int(x[i]) >> 2), []).append(c[0])
    biome = {cell: v.biome((cell % 4) * 4, int(sum(ys) / len(ys)), (cell // 4) * 4) for cell, ys in sums.items()}
    return [(base_x + int(x[i]), base_z + int(z[i]), s, f, ice, cov, coral, plants, biome[(int(z[i]) >> 2) * 4 + (int(x[i]) >> 2)]) for i, (s, f, ice, cov) in sorted(accepted.items())]


COLUMNS = "x int, z int, surface_y int, floor_y int, ice boolean, covered boolean, coral boolean, plants boolean, biome string"


def surface_biomes(chunk: dict) -> list[tuple]:
    """(cx, cz, biome) at the surface of the first column of each 4x4 cell, in world cells; cells without one are left out."""
    maps = chunk.get("Heightmaps", {})
    top = heightmap(maps.get("MOTION_BLOCKING"))
    top = heightmap(maps.get("WORLD_SURFACE")) if top is None else top
    if top is None or not chunk.get("sections"):
        return []
    low, v = 16 * int(chunk.get("yPos", -4)), Volume(chunk)
    base_x, base_z = 4 * int(chunk["xPos"]), 4 * int(chunk["zPos"])
    found = []
    for cell in range(16):
        x, z = cell % 4 * 4, cell // 4 * 4
        height = int(top[z * 16 + x])
        name = v.biome(x, low + height - 1, z) if height else None
        if name is not None:
            found.append((base_x + cell % 4, base_z + cell // 4, name))
    return found


def _chunks(spark: SparkSession, world: str) -> DataFrame:
    """(kind, payload) of all chunks of all region files of a world."""
    folder = f"{world.rstrip('/')}/region"
    return chunks_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.mca").load(folder), folder)


def chunks_of(files: DataFrame, folder: str) -> DataFrame:
    """(kind, payload) of all chunks of region files (path, content), read at once or as a stream.

    Chunks kept in side files (c.<x>.<z>.mcc) of the folder are joined by their name.
    """
    files = files.select("path", "content")
    raw = "chunk_x int, chunk_z int, kind int, external boolean, payload binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = region_coords(path)
                if place is None:
                    continue
                rows = [(place[0] * 32 + i % 32, place[1] * 32 + i // 32, kind, ext, body) for i, kind, ext, body in chunk_payloads(content)]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["chunk_x", "chunk_z", "kind", "external", "payload"])

    chunks = files.mapInArrow(split, raw)
    side = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.mcc").load(folder)
    coords = [F.regexp_extract("path", r"c\.(-?\d+)\.(-?\d+)\.mcc$", k).cast("int") for k in (1, 2)]
    outer = side.select(coords[0].alias("chunk_x"), coords[1].alias("chunk_z"), F.col("content").alias("payload"))
    whole = chunks.filter("not external").unionByName(chunks.filter("external").drop("payload").join(outer, ["chunk_x", "chunk_z"]))

    return whole.select("kind", "payload")


def _decoded(chunks: DataFrame, rows_of: Callable[[dict], list[tuple]], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """The rows of all chunks that can be read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in columns.split(", ")]
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                try:
                    chunk = parse_chunk(inflate(kind, payload))
                except (ValueError, KeyError, OSError, zlib.error, EOFError):
                    continue
                rows = rows_of(chunk) if chunk else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return chunks.mapInArrow(decode, columns)


def decoded_columns(chunks: DataFrame, caves: bool = True, min_y: int | None = None) -> DataFrame:
    """The water columns of chunks (kind, payload). Unreadable chunks are passed over."""
    return _decoded(chunks, lambda chunk: probe_columns(chunk, caves, min_y), COLUMNS, [pa.int32()] * 4 + [pa.bool_()] * 4 + [pa.string()])


def scan_world(spark: SparkSession, world: str, caves: bool = True, min_y: int | None = None) -> DataFrame:
    """Water columns of all region files of a world. Unreadable chunks are passed over."""
    return decoded_columns(_chunks(spark, world), caves, min_y)


def scan_surface(spark: SparkSession, world: str) -> DataFrame:
    """(cx, cz, biome): surface biome of the cells of all region files of a world. Unreadable chunks are passed over."""
    return _decoded(_chunks(spark, world), surface_biomes, "cx int, cz int, biome string", [pa.int32()] * 2 + [pa.string()])


#: Rows of scan(): water columns, surface biomes and dry ground of cells, and one row for each chunk entry with what became of it.
SCAN = "what string, x int, z int, y int, floor_y int, ice boolean, covered boolean, coral boolean, plants boolean, biome string"
_SCAN_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
FAILED, PARTIAL, FULL, WET = -1, 0, 1, 2


def ground_rows(chunk: dict, wet: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(cx, cz, y): the least surface of the columns of each 4x4 cell that hold no accepted water."""
    maps = chunk.get("Heightmaps", {})
    top = heightmap(maps.get("MOTION_BLOCKING"))
    top = heightmap(maps.get("WORLD_SURFACE")) if top is None else top
    if top is None:
        return []
    z, x = np.divmod(np.arange(256), 16)
    x, z = x + 16 * int(chunk["xPos"]), z + 16 * int(chunk["zPos"])
    y = 16 * int(chunk.get("yPos", -4)) + top - 1
    dry = (top > 0) & np.array([(a, b) not in wet for a, b in zip(x.tolist(), z.tolist(), strict=True)])
    least: dict[tuple[int, int], int] = {}
    for cx, cz, h in zip((x[dry] >> 2).tolist(), (z[dry] >> 2).tolist(), y[dry].tolist(), strict=True):
        least[cx, cz] = min(h, least.get((cx, cz), h))
    return [(cx, cz, h) for (cx, cz), h in least.items()]


def _scan_rows(kind: int, payload: bytes, caves: bool, min_y: int | None) -> list[tuple]:
    none = (None,) * 8
    try:
        chunk = parse_chunk(inflate(kind, payload))
    except (ValueError, KeyError, OSError, zlib.error, EOFError):
        return [("chunk", FAILED, *none)]
    if chunk is None:
        return [("chunk", PARTIAL, *none)]
    columns = probe_columns(chunk, caves, min_y)
    out = [("water", *r) for r in columns]
    out += [("surface", cx, cz, *none[:6], name) for cx, cz, name in surface_biomes(chunk)]
    out += [("ground", cx, cz, y, *none[:6]) for cx, cz, y in ground_rows(chunk, {(r[0], r[1]) for r in columns})]
    return [*out, ("chunk", WET if columns else FULL, *none)]


def scan(spark: SparkSession, world: str, caves: bool = True, min_y: int | None = None) -> dict[str, DataFrame]:
    """Everything one reading of a world gives, each chunk decoded once: columns, surface (cx, cz, biome), ground (cx, cz, y), chunks (state, n)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCAN.split(", ")]
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                rows = _scan_rows(kind, payload, caves, min_y)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCAN_KINDS, strict=True)], names)

    rows = cut(_chunks(spark, world).mapInArrow(decode, SCAN))
    of = lambda what: rows.filter(F.col("what") == what)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return {
        "columns": of("water").withColumnRenamed("y", "surface_y").select(*names),
        "surface": of("surface").select(F.col("x").alias("cx"), F.col("z").alias("cz"), "biome"),
        "ground": of("ground").select(F.col("x").alias("cx"), F.col("z").alias("cz"), "y"),
        "chunks": of("chunk").groupBy(F.col("x").alias("state")).agg(F.count("*").alias("n")),
    }


def tiles(spark: SparkSession, world: str) -> DataFrame:
    """(rx, rz) of the region files of a world, by their names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mca").load(f"{world.rstrip('/')}/region").select("path")
    coords = [F.regexp_extract("path", _NAME.pattern, k) for k in (1, 2)]
    return files.filter(F.col("path").rlike(_NAME.pattern)).select(coords[0].cast("int").alias("rx"), coords[1].cast("int").alias("rz"))


def region_file(chunks: dict[int, bytes]) -> bytes:
    """Bytes of a region file of zlib-compressed chunks by index (generators and tests)."""
    table, body, sector = bytearray(8192), bytearray(), 2
    for index, raw in sorted(chunks.items()):
        payload = zlib.compress(raw)
        block = struct.pack(">IB", len(payload) + 1, 2) + payload
        size = -(-len(block) // 4096)
        table[4 * index : 4 * index + 4] = struct.pack(">I", sector << 8 | size)
        body += block.ljust(size * 4096, b"\0")
        sector += size
    return bytes(table + body)


def world_root(world: str) -> Path:
    """The folder that holds level.dat: world itself, or the one above a nested dimensions/<namespace>/<name>."""
    path = Path(world)
    parts = path.parts
    if "dimensions" in parts and not (path / "level.dat").exists():
        return Path(*parts[: parts.index("dimensions")])
    return path


def level_info(world: str) -> dict:
    """data_version, level_name, version_name of level.dat, compressed or not; zeros and empty names without one."""
    out = {"data_version": 0, "level_name": "", "version_name": ""}
    try:
        raw = (world_root(world) / "level.dat").read_bytes()
        data = nbt.read(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).get("Data", {})
    except (OSError, ValueError, EOFError):
        return out
    return {"data_version": int(data.get("DataVersion", 0)), "level_name": data.get("LevelName", ""), "version_name": (data.get("Version") or {}).get("Name", "")}
