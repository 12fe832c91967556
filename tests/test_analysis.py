"""A small world from region files to the binary file and back."""

import json
import struct

from isobath.__main__ import options
from isobath.functions import biomes as biome_functions
from isobath.operators import regions
from isobath.options import Options
from isobath.plans import analysis
from isobath.sources import anvil, waterfile
from tests.test_formats import chunk


def test_world_to_file(spark, tmp_path):
    folder = tmp_path / "region"
    folder.mkdir()
    (folder / "r.0.0.mca").write_bytes(anvil.region_file({i: chunk(i % 32, i // 32) for i in (0, 1, 32, 33)}))
    (folder / "r.-1.0.mca").write_bytes(anvil.region_file({i: chunk(i % 32 - 32, i // 32) for i in (31, 100)}))
    (folder / "r.3.3.mca").write_bytes(anvil.region_file({0: b"no tags"}))
    result = analysis.run(spark, Options(str(tmp_path), sea_level=10, min_water_body=100, min_sea_body=1000, no_lake_detection=True))
    assert result.chunks == {anvil.WET: 6, anvil.FAILED: 1}
    rows = sorted((r.column_count, r.kind, r.mean_depth, r.surface_y, r.min_x, r.max_x) for r in result.regions.collect())
    assert rows == [(256, 2, 5, 9, -448, -433), (1280, 0, 5, 9, -16, 31)]
    path = str(tmp_path / "out.bin")
    analysis.write(result, path, 3700)
    file = waterfile.WaterFile((tmp_path / "out.bin").read_bytes())
    assert file.data_version == 3700 and file.region_at(0, 0) == file.region_at(-5, 3) is not None
    assert file.region_at(-440, 50) not in (None, file.region_at(0, 0)) and file.region_at(100, 100) is None


def test_command_writes_everything(spark, tmp_path, monkeypatch, capsys):
    import isobath.__main__ as command
    from isobath.sinks import maps

    folder = tmp_path / "region"
    folder.mkdir()
    (folder / "r.0.0.mca").write_bytes(anvil.region_file({i: chunk(i % 32, i // 32, biome="minecraft:plains") for i in range(96) if i % 32 < 3} | {20: chunk(20, 0)}))
    monkeypatch.setattr(command, "session", lambda **_: spark)
    config = tmp_path / "lakes.json"
    config.write_text('{"core_radius": 4, "density_8": 0.3, "density_16": 0.3, "density_32": 0.2, "min_lake_area": 500, "min_core_area": 8, "min_basin_core_fraction": 0.1}')
    out = tmp_path / "out"
    files = command.main(["--world", str(tmp_path), "--output", str(out), "--sea-level", "10", "--min-water-body", "100", "--min-sea-body", "1000", "--export-json", "--export-map", "--lake-debug", "--debug", "--lake-config", str(config)])
    assert set(files) == {"water_regions.bin", "water_regions.json", *(f"water_{n}.png" for n in ("map", "regions_map", "depth_map", "ocean_map", "inland_map", "combined_map"))}
    image = maps.read_png((out / "water_combined_map.png").read_bytes())
    pixel = lambda x, z: tuple(image[z // 8, image.shape[1] - 64 + x // 8])
    assert pixel(20, 20) == (0x64, 0xBE, 0xD3) and pixel(200, 200) == (0x34, 0x36, 0x3A)
    text = capsys.readouterr().out
    assert "chunks with water       10" in text and "water_map.png" in text and "#0" in text
    report = json.loads((out / "lakes" / "lake_candidates.json").read_text())
    assert report["accepted_candidate_count"] == 1 and report["inland_water_columns"] == 48 * 48 + 256 and len(report["candidates"]) >= 1
    raw = (out / "lakes" / "lake_candidate_runs.bin").read_bytes()
    records = [struct.unpack_from("<IIiii", raw, 8 + 20 * k) for k in range((len(raw) - 8) // 20)]
    assert raw[:8] == b"LKRUNS01" and sum(r[4] - r[3] + 1 for r in records) == 48 * 48 + 256 and max(r[4] - r[3] for r in records) == 31
    assert len(list((out / "lakes").glob("lake_*.png"))) == 10


def test_lake_step_can_be_left_out(spark, tmp_path):
    folder = tmp_path / "region"
    folder.mkdir()
    (folder / "r.0.0.mca").write_bytes(anvil.region_file({i: chunk(i, 0, biome="minecraft:river") for i in range(8)}))
    how = {"sea_level": 10, "min_water_body": 100, "min_cave_body": 100}
    plain = analysis.run(spark, Options(str(tmp_path), no_lake_detection=True, **how))
    assert [(r.kind, r.column_count) for r in plain.regions.collect()] == [(1, 2048)] and plain.lakes is None


def test_arid_banks_count_for_neutral_water(spark):
    """Cells within 4 of arid land count as desert, one whose own biome is desert once."""
    biomes = biome_functions.biome_table(spark, [])
    surface = spark.createDataFrame([(0, 0, "minecraft:desert"), (0, 40, "minecraft:desert"), (0, 80, "minecraft:plains")], "cx int, cz int, biome string")
    arid = regions.dryland(surface, biomes)
    assert sorted(map(tuple, arid.collect())) == [(0, 0), (0, 40)]
    places = [(1, 4, 4, "minecraft:river"), (2, 5, 4, "minecraft:river"), (3, 1, 41, "minecraft:desert"), (4, 0, 81, "minecraft:river")]
    cells = spark.createDataFrame([(cx, cz, b, 4, 0, 0, 60, 3, False, False) for _, cx, cz, b in places], "cx int, cz int, biome string, water_cols long, ice_cols long, cave_cols long, surface_y int, depth int, coral boolean, plants boolean")
    own = spark.createDataFrame([(i, cz * 4, cx * 4, cx * 4 + 3) for i, cx, cz, _ in places], "id long, z int, x0 int, x1 int")
    desert = lambda **how: {r.id: r.desert_columns for r in regions.accumulate(own, cells, biomes, **how).collect()}
    assert desert(arid=arid) == {1: 4, 2: 0, 3: 4, 4: 0} and desert() == {1: 0, 2: 0, 3: 4, 4: 0}


def test_surface_of_a_world(spark, tmp_path):
    folder = tmp_path / "region"
    folder.mkdir()
    (folder / "r.-1.0.mca").write_bytes(anvil.region_file({31: chunk(-1, 0)}))
    rows = anvil.scan_surface(spark, str(tmp_path)).collect()
    assert sorted((r.cx, r.cz) for r in rows) == [(x, z) for x in range(-4, 0) for z in range(4)] and all(r.biome.startswith("minecraft:") for r in rows)


def test_command_line():
    assert options(["--world", "w"]).min_river_merge == 20_000
    assert options(["--world", "w", "--no-caves", "--map-scale", "4"]).map_scale == 4
