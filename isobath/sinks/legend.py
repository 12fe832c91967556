"""Legends beside the maps: rows of headings, notes and swatches, in a small bitmap font."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import colours

#: Letters of three by five dots; a digit is one row, its bits the dots from left to right.
FONT = dict(part.split() for part in "A 25755,B 65656,C 34443,D 65556,E 74647,F 74644,G 34553,H 55755,I 72227,J 11152,K 55655,L 44447,M 57755,N 65555,O 25552,P 65644,Q 25563,R 65655,S 34216,T 72222,U 55557,V 55552,W 55775,X 55255,Y 55222,Z 71247,0 75557,1 26227,2 61247,3 61216,4 55711,5 74616,6 34757,7 71222,8 75757,9 75716,- 00700,+ 02720,/ 11244,= 07070,: 02020,. 00002,# 57575,% 51245,< 12421,> 42124".split(","))
ADVANCE, LINE = 4, 8


@dataclass(frozen=True)
class Row:
    """A line of a legend: a heading, a note, or a swatch of a colour with the texture of modifiers."""

    text: str
    color: int | None = None
    modifiers: int = 0
    heading: bool = False


def heading(text: str) -> Row:
    return Row(text, heading=True)


def scale_for(height: int, rows: int) -> int:
    """Dots a letter's dot is wide, so that all rows fit beside the map, 1 to 4."""
    return max(1, min(4, height // max(1, (rows + 2) * LINE)))


def width(rows: list[Row], scale: int) -> int:
    return scale * (max((len(r.text) for r in rows), default=0) * ADVANCE + 16)


def height(rows: list[Row], scale: int) -> int:
    return scale * LINE * (len(rows) + 1)


def write(image: np.ndarray, text: str, x: int, y: int, scale: int, color: int) -> None:
    rgb = [color >> s & 255 for s in (16, 8, 0)]
    for k, letter in enumerate(text.upper()):
        for row, bits in enumerate(FONT.get(letter, "00000")):
            for column in range(3):
                if int(bits) >> (2 - column) & 1:
                    a, b = y + row * scale, x + (k * ADVANCE + column) * scale
                    image[a : a + scale, b : b + scale] = rgb


def texture_at(modifiers: int, x: int, y: int) -> int | None:
    """The texture of colours.texture at one pixel."""
    rules = (
        (colours.CAVE, x % 5 in (2, 3) and y % 5 in (2, 3), colours.CAVE_DOT),
        (colours.CORALS, x % 6 == 2 and y % 6 == 2, colours.CORAL_DOT),
        (colours.ICE, y % 8 < 2, colours.ICE_STRIPE),
        (colours.DESERT, (x + 5 * y) % 11 < 2, colours.DESERT_DOT),
        (colours.MANGROVE, x % 7 == 3 and y % 7 == 5, colours.MANGROVE_DOT),
    )
    return next((c for bit, here, c in rules if modifiers & bit and here), None)


def draw(image: np.ndarray, rows: list[Row], margin: int, scale: int) -> None:
    """Draw a legend into the left margin pixels of an image."""
    image[:, :margin] = [colours.PANEL >> s & 255 for s in (16, 8, 0)]
    for k, row in enumerate(rows):
        y = scale * (LINE * k + 4)
        if row.color is None:
            write(image, row.text, 2 * scale, y, scale, colours.HEADING if row.heading else colours.DIM)
            continue
        for a in range(y, min(y + 6 * scale, len(image))):
            for b in range(2 * scale, 10 * scale):
                c = texture_at(row.modifiers, b, a) if row.modifiers else None
                image[a, b] = [(row.color if c is None else c) >> s & 255 for s in (16, 8, 0)]
        write(image, row.text, 12 * scale, y, scale, colours.TEXT)


def legends(counts: dict[int, int], sea_level: int, scale: int, ocean_min_area: int) -> dict[str, list[Row]]:
    """The rows of all six maps. counts: regions by kind."""
    sea, river, lake, swamp = (colours.INLAND_COLORS[k] for k in range(4))
    here = [heading("THIS MAP"), Row(f"SEA LEVEL {sea_level}"), Row(f"1 PIXEL = {scale} BLOCKS")]
    ground = [heading("BACKGROUND"), Row("LAND", colours.LAND), Row("NOT GENERATED", colours.VOID)]
    overlays = [heading("OVERLAYS"), Row("CORALS", sea, colours.CORALS), Row("ICE COVER 50%+", lake, colours.ICE), Row("CAVE WATER", lake, colours.CAVE)]
    inner = [Row("RIVER", river), Row("LAKE", lake), Row("SWAMP", swamp), Row("DESERT RIVER", colours.DESERT_RIVER), Row("DESERT LAKE", colours.DESERT_LAKE)]
    oceans = [Row(f"{t} {'0-' if not deep else ''}{colours.SHELF + deep}{'+' if deep else ''}", colours.OCEAN_COLORS[2 * k + deep]) for k, t in enumerate(("WARM", "MEDIUM", "COLD")) for deep in (0, 1)]
    patches = [Row(f"PATCHES BELOW {ocean_min_area} MERGED"), Row("ISOLATED TINY PATCHES OMITTED" if ocean_min_area else "PATCH FILTER DISABLED")]
    kinds = [Row(f"{name} {t}", colours.style(k, j, None, False)) for k, name in enumerate(("SEA", "RIVER", "LAKE", "SWAMP")) for j, t in enumerate(("WARM", "MEDIUM", "COLD"))]
    depths = [Row(name, colours.style(0, 1, d, False)) for d, name in enumerate(("SHALLOW 0-10", "NORMAL 11-30", "DEEP 31+"))]
    marks = [Row(name, sea, bit) for name, bit in (("ICE", colours.ICE), ("CORALS", colours.CORALS), ("DESERT", colours.DESERT), ("MANGROVE", colours.MANGROVE), ("CAVE", colours.CAVE))]
    total = [Row(f"{name} {counts.get(k, 0)}") for k, name in enumerate(("SEAS", "RIVERS", "LAKES", "SWAMPS"))]
    ramp = [Row("100+" if b == 100 else str(b), colours.ramp(b)) for b in (0, 5, 10, 20, 30, 45, 60, 80, 100)]
    return {
        "water_map": [heading("KIND AND TEMPERATURE"), *kinds, heading("DEPTH"), *depths, heading("MODIFIERS"), *marks, *ground, *here, *total],
        "water_regions_map": [heading("REGIONS"), Row("ONE COLOUR PER REGION"), *ground, *here, *total],
        "water_depth_map": [heading("MEASURED WATER DEPTH"), Row("PER 4X4 CELL NOT PER REGION"), heading("SCALE - BLOCKS"), *ramp, *ground, *here],
        "water_ocean_map": [heading("OCEAN ZONES"), *oceans, *patches, *ground, *here, total[0]],
        "water_inland_map": [heading("INLAND WATER"), Row("OCEAN", sea), *inner, *overlays, *ground, *here, *total[1:]],
        "water_combined_map": [heading("OCEAN AND INLAND WATER"), *oceans, *inner, *overlays, Row("OCEAN HAS PRIORITY AT COAST"), *patches, *ground, *here, *total],
    }
