"""Region files, tags, the binary region file, images and options."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.functions import biomes
from isobath.operators import lakes
from isobath.options import LakeOptions, Options
from isobath.sinks import maps
from isobath.sources import anvil, nbt, waterfile


def pack(values, bits):
    per = 64 // bits
    values = np.concatenate([values, np.zeros(-len(values) % per, np.int64)]).reshape(-1, per)
    out = np.zeros(len(values), np.uint64)
    for k in range(per):
        out |= values[:, k].astype(np.uint64) << np.uint64(k * bits)
    return out.view(np.int64)


def chunk(cx, cz, water_y=9, status="minecraft:full", biome="minecraft:ocean"):
    """One section of stone below, water at water_y and below to 4, air above."""
    y = np.arange(16)[:, None, None] * np.ones((1, 16, 16), int)
    codes = np.where(y > water_y, 0, np.where(y > 4, 1, 2)).ravel()
    palette = [{"Name": "minecraft:air"}, {"Name": "minecraft:water"}, {"Name": "minecraft:stone"}]
    section = {"Y": 0, "block_states": {"palette": palette, "data": pack(codes, 4)}, "biomes": {"palette": [biome]}}
    tops, beds = np.full(256, water_y + 1), np.full(256, 5)
    maps_ = {"MOTION_BLOCKING": pack(tops, 9), "OCEAN_FLOOR": pack(beds, 9)}
    return nbt.write({"xPos": cx, "zPos": cz, "yPos": 0, "DataVersion": 3700, "Status": status, "Heightmaps": maps_, "sections": [section], "Other": {"deep": [1, 2]}})


def test_world_scan(spark, tmp_path):
    folder = tmp_path / "region"
    folder.mkdir()
    (folder / "r.-1.0.mca").write_bytes(anvil.region_file({0: chunk(-32, 0), 7: chunk(-25, 0), 9: chunk(-23, 0, status="empty")}))
    (folder / "r.0.0.mca").write_bytes(b"short")
    columns = anvil.scan_world(spark, str(tmp_path))
    rows = columns.collect()
    assert len(rows) == 512 and {(r.surface_y, r.floor_y, r.biome, r.covered) for r in rows} == {(9, 4, "minecraft:ocean", False)}
    assert min(r.x for r in rows) == -512 and max(r.x for r in rows) == -25 * 16 + 15
    assert anvil.scan_world(spark, str(tmp_path), min_y=10).count() == 0


def test_truncated_tags_are_refused():
    raw = chunk(0, 0)
    for n in range(0, len(raw) - 1, 97):
        with pytest.raises((nbt.NbtError, IndexError)):
            nbt.read(raw[:n])


def test_level_file(tmp_path):
    (tmp_path / "level.dat").write_bytes(gzip.compress(nbt.write({"Data": {"DataVersion": 5, "LevelName": "a", "Version": {"Name": "b"}}})))
    assert anvil.level_info(str(tmp_path)) == {"data_version": 5, "level_name": "a", "version_name": "b"}
    assert anvil.level_info(str(tmp_path / "none"))["data_version"] == 0


@pytest.mark.parametrize(("entry", "code"), [("minecraft:water", 2), ({"Name": "minecraft:water", "Properties": {"level": "3"}}, 0), ({"id": "kelp"}, 2), ({"": "oak_stairs", "Properties": {"waterlogged": "true"}}, 2), ({"Name": "water", "Properties": {"level": "x"}}, 0)])
def test_palette_shapes(entry, code):
    assert anvil.class_of(*anvil.block_entry(entry)) == code


def sample_file():
    regions = [(0, 0, 1, 2, 1, 3, 62, -70, 0, 70, 1, 145, 12, 30, 1, 2, 3, 4), (1, 2, 0, 1, 0, 0, 60, 80, 5, 82, 5, 3, 2, 4, 0, 0, 0, 0)]
    runs = [[(0, -70, 70), (1, 0, 1), (1, 5, 6)], [(5, 80, 82)]]
    return waterfile.encode(regions, runs, (-128, 0, 127, 127), sea_level=63, data_version=9)


def test_region_file_round_trip():
    raw = sample_file()
    file = waterfile.WaterFile(raw)
    assert file.sea_level == 63 and len(file.regions) == 2 and file.regions[0][11] == 145
    assert [file.region_at(*p) for p in ((-70, 0), (70, 0), (71, 0), (5, 1), (3, 1), (81, 5), (9999, 0))] == [0, 0, None, 0, None, 1, None]
    for n in range(len(raw)):
        with pytest.raises(waterfile.FormatError):
            waterfile.WaterFile(raw[:n])


def test_region_file_tables(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(sample_file())
    regions, runs = waterfile.read_file(spark, str(tmp_path / "w.bin"))
    again = tmp_path / "again.bin"
    waterfile.write_file(str(again), regions, runs, (-128, 0, 127, 127), sea_level=63, data_version=9)
    assert again.read_bytes() == sample_file()
    assert waterfile.verify(str(again), regions, runs, 63) == 2


def test_images():
    image = np.random.default_rng(1).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    assert (maps.read_png(maps.png(image)) == image).all()


def test_options(tmp_path):
    assert Options("w").height_cutoff == 10 and Options("w", no_caves=True).height_cutoff is None
    with pytest.raises(ValueError):
        Options("w", no_lake_detection=True, lake_debug=True)
    for bad in ({"core_radius": 0}, {"density_8": 1.5}, {"neck_width_ratio": 1.0}, {"min_core_area": 0}):
        with pytest.raises(ValueError):
            LakeOptions(**bad)
    (tmp_path / "o.json").write_text('{"core_radius": 5}')
    assert LakeOptions.load(str(tmp_path / "o.json")).core_radius == 5
    (tmp_path / "o.json").write_text('{"other": 5}')
    with pytest.raises(ValueError):
        LakeOptions.load(str(tmp_path / "o.json"))


def test_biome_packs(spark, tmp_path):
    place = tmp_path / "data" / "pack" / "worldgen" / "biome"
    place.mkdir(parents=True)
    (place / "ice_river.json").write_text('{"temperature": 0.1}')
    rows = {r.name: r for r in biomes.biome_table(spark, [str(tmp_path)]).collect()}
    assert len(rows) == 56 and rows["pack:ice_river"].family == 2 and rows["pack:ice_river"].water_temperature == 2
    assert rows["minecraft:mangrove_swamp"].vegetation == 3 and rows["minecraft:lukewarm_ocean"].water_temperature == 0


def disc(cx, cz, r, test=None):
    return [(x, z) for x in range(cx - r - 1, cx + r + 2) for z in range(cz - r - 1, cz + r + 2) if (x - cx) ** 2 + (z - cz) ** 2 <= r * r]


def test_lake_and_channel(spark):
    columns = sorted(set(disc(0, 0, 60)) | {(x, z) for x in range(40, 300) for z in range(-4, 5)})
    got = {(r.x, r.z): r.lake for r in lakes.separate(spark.createDataFrame(columns, "x int, z int")).collect()}
    assert got[(0, 0)] == 1 and got[(-50, 0)] == 1 and got[(250, 0)] == 0 and got[(150, 2)] == 0
    assert len(got) == len(columns)


def test_streamed_file_is_the_whole_file(spark, tmp_path):
    """Bytes written from partitions are those encoded at once, and ranged reads give the rows again."""
    own = np.random.default_rng(3)
    listed = [sorted({(int(z), int(x), int(x + n)) for z, x, n in zip(own.integers(-90, 90, 6), own.integers(-40, 40, 6) * 4, own.integers(0, 3, 6), strict=True)}) for _ in range(30)]
    rows = [(k, k % 4, k % 3, k % 4, 0, k % 32, 60, -200, -100, 200, 100, 10, 3, 5, 1, 2, 3, 4) for k in range(30)]
    bounds = (-512, -512, 511, 511)
    regions = spark.createDataFrame(rows, waterfile.REGION).repartition(3)
    runs = spark.createDataFrame([(k, *r) for k, part in enumerate(listed) for r in part], "id long, z int, x0 int, x1 int").repartition(4)
    path = tmp_path / "w.bin"
    size = waterfile.write_file(str(path), regions, runs, bounds, sea_level=62, data_version=9)
    raw = waterfile.encode(rows, listed, bounds, sea_level=62, data_version=9)
    assert path.read_bytes() == raw and size == len(raw)
    back, lines = waterfile.read_file(spark, str(path))
    assert sorted(map(tuple, back.collect())) == rows and sorted(map(tuple, lines.collect())) == sorted((k, *r) for k, part in enumerate(listed) for r in part)
    (tmp_path / "short.bin").write_bytes(raw[:-1])
    with pytest.raises(waterfile.FormatError):
        waterfile.read_file(spark, str(tmp_path / "short.bin"))


def test_shapes_of_lakes(spark):
    """Lakes and channels at named places: a closed disc, an ellipse, two discs joined by a channel, a wide river, a square with four arms."""
    box = lambda x0, x1, z0, z1: {(x, z) for x in range(x0, x1) for z in range(z0, z1)}
    shapes = {
        "disc": (set(disc(0, 0, 60)), {(0, 0): True, (58, 0): True}, 0),
        "ellipse": ({(x, z) for x in range(-160, 161) for z in range(-28, 29) if x * x / 160**2 + z * z / 28**2 <= 1}, {(0, 0): True}, 0),
        "two": (set(disc(0, 0, 60)) | set(disc(300, 0, 60)) | box(40, 270, -4, 5), {(0, 0): True, (300, 0): True, (150, 0): False}, 2),
        "river": (box(0, 600, -8, 9), {(300, 0): False}, 0),
        "arms": (box(-60, 61, -60, 61) | box(-200, 201, -4, 5) | box(-4, 5, -200, 201), {(0, 0): True, (180, 0): False, (0, -180): False}, 4),
        "diagonal": (set(disc(0, 0, 60)) | {(x + d, x) for x in range(30, 200) for d in range(-5, 6)}, {(0, 0): True, (180, 180): False}, 1),
    }
    rows, place = [], {}
    for k, (name, (columns, _, _)) in enumerate(sorted(shapes.items())):
        place[name] = 3000 * (k - 2)
        rows += [(x + place[name], z - 70_000) for x, z in columns]
    found = lakes.detect(spark.createDataFrame(rows, "x int, z int").repartition(5)).collect()
    columns = {(r.x, r.z): r for r in found if r.contact is None and r.basin is None}
    assert len(columns) == len(rows)
    for name, (own, expected, contacts) in shapes.items():
        for (x, z), lake in expected.items():
            assert (columns[x + place[name], z - 70_000].lake > 0) == lake, (name, x, z)
        seen = [r for r in found if r.contact is not None and abs(r.x - place[name]) < 700]
        assert len(seen) == contacts and all(r.contact.confirmed and r.contact.ratio <= 0.55 for r in seen), (name, seen)
        # every lake is cut off from the channels: no lake column but at a neck touches one
        mine = {p: columns[p].lake for p in ((x + place[name], z - 70_000) for x, z in own)}
        open_ = [p for p, lake in mine.items() if lake and any(mine.get((p[0] + dx, p[1] + dz)) == 0 and not columns[p[0] + dx, p[1] + dz].neck for dx, dz in lakes.SIDES)]
        assert not open_, name


def test_floods_are_those_of_a_queue():
    own = np.random.default_rng(6)
    grid = own.random((40, 50)) < 0.7
    z, x = np.nonzero(grid)
    w = lakes.Columns(x - 20, z - 33)
    beside = w.beside(lakes.SIDES)
    assert all((w.x[n] - w.x[k], w.z[n] - w.z[k]) == s for k in range(len(w.x)) for n, s in zip(beside[k], lakes.SIDES, strict=True) if n >= 0)
    marks = np.zeros(len(w.x), np.int32)
    sources = np.sort(own.choice(len(w.x), 6, replace=False))
    marks[sources] = np.arange(1, 7)
    steps, mark = lakes.spread(sources, marks, beside)
    queue, far, name = list(sources), {int(s): 0 for s in sources}, {int(s): int(marks[s]) for s in sources}
    for p in queue:
        for n in beside[p]:
            if n >= 0 and int(n) not in far:
                far[int(n)], name[int(n)] = far[int(p)] + 1, name[int(p)]
                queue.append(int(n))
    assert {k: int(v) for k, v in enumerate(steps) if v >= 0} == far and {k: int(mark[k]) for k in far} == name


def test_protected_water_keeps_leftovers_channels(spark):
    """A small leftover on one lake's bank joins it, but not beside protected water; heads tell inflow from outflow."""
    columns = {(x, z, 60) for x, z in disc(0, 0, 60)} | {(x, z, 64) for x in range(40, 200) for z in range(-4, 5) if (x, z) not in set(disc(0, 0, 60))}
    frame = spark.createDataFrame(sorted(columns), "x int, z int, surface_y int")
    sea = spark.createDataFrame([(200, z) for z in range(-4, 5)], "x int, z int")
    found = lakes.detect(frame, protected=sea).collect()
    contacts = [r.contact for r in found if r.contact is not None]
    assert [round(c.head) for c in contacts] == [4] and contacts[0].confirmed
    assert {r.lake for r in found if r.contact is None and r.basin is None and r.x > 150} == {0}


def test_mask_scores(spark, tmp_path):
    from isobath.sinks import masks

    image = np.zeros((4, 6, 3), np.uint8)
    image[:, 2:4], image[:, 4:] = (0x99, 0xCA, 0xCD), (0x64, 0xBE, 0xD3)
    other = image.copy()
    other[0, 2:] = 0
    paint = np.zeros((4, 6, 3), np.uint8)
    paint[:2, 2:4], paint[2:, 4:], paint[3, 0] = (0x3A, 0xE1, 0xCD), (0x99, 0xCA, 0xCD), (0x99, 0xCA, 0xCD)
    for name, pixels in (("reference", image), ("map", other), ("mask", paint)):
        (tmp_path / f"{name}.png").write_bytes(maps.png(pixels))
    (tmp_path / "data.bin").write_bytes(waterfile.encode([], [], (0, 0, 39, 31)))
    out = masks.report(spark, *(str(tmp_path / n) for n in ("mask.png", "reference.png", "data.bin")), [str(tmp_path / "map.png")], output=str(tmp_path / "score.json"))
    (result,) = out["results"]
    assert out["sample_count"] == 8 and out["ignored_paint_outside_inland_water"] == 1 and out["projection"]["legend_width"] == 1
    assert (result["river_recall"], result["lake_recall"], result["balanced_accuracy"], result["accuracy"], result["unavailable_predictions"]) == (0.5, 1.0, 0.75, 0.75, 2)
    assert masks.brush("#3ae1cd") == 0x3AE1CD
    with pytest.raises(ValueError):
        masks.brush("12345")


def test_sizes_and_colours(spark):
    from isobath.functions import colours
    from isobath.sinks.reports import human_size

    assert [human_size(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 40, 1 << 60)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 TiB", "1048576.0 TiB"]
    assert colours.ramp(0) == 0xC6F4FC and colours.ramp(500) == 0x081036 and abs(colours.luminance(colours.style(0, 1, 2, False)) - 0.18) < 0.02
    rows = spark.range(40).select(colours.id_color(F.col("id")).alias("c")).collect()
    assert len({r.c for r in rows}) == 40 and rows[0].c == 0x994444


def test_stream_of_region_files(spark, tmp_path):
    from isobath.streaming.incremental import run_batches, stream_columns

    folder = tmp_path / "region"
    folder.mkdir()
    raw = bytearray(anvil.region_file({0: chunk(0, 0), 1: chunk(1, 0), 2: b"kept beside"}))
    # the third chunk lies in a side file
    at = 4096 * (int.from_bytes(raw[8:11], "big"))
    raw[at + 4] |= 0x80
    (folder / "r.0.0.mca").write_bytes(raw)
    (folder / "c.2.0.mcc").write_bytes(zlib.compress(chunk(2, 0)))
    counts = []
    query = run_batches(stream_columns(spark, str(folder)), lambda batch, _: counts.append(batch.count()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sum(counts) == 768 == anvil.scan_world(spark, str(tmp_path)).count()


def test_binary_roundtrip_is_read_by_tasks(spark, monkeypatch):
    from isobath.plans import queries

    def whole(*_):
        raise AssertionError("the driver parses the whole file")

    monkeypatch.setattr(waterfile, "WaterFile", whole)
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.binary_roundtrip(spark, folder).collect()))
    assert sorted(a for _, a in got) == sorted(r.area for r in queries.component_perimeter(spark, folder).collect())
    assert [i for i, _ in got] == list(range(len(got)))
