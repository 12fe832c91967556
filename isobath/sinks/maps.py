"""Pixels of maps: aggregation in Spark, encoding of the bounded image on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 100_000_000


def pixel(min_x: int, min_z: int, scale: int) -> list[Column]:
    """Pixel of a column (x, z): whole division of the offset."""
    at = lambda c, low: F.expr(f"cast(({c} - ({low})) div {scale} as int)")
    return [at("x", min_x).alias("px"), at("z", min_z).alias("pz")]


def paint(rows: DataFrame, value: str, order: list[str], min_x: int, min_z: int, scale: int) -> DataFrame:
    """(px, pz, value): the last writer in the stated order wins."""
    return rows.groupBy(*pixel(min_x, min_z, scale)).agg(F.max_by(value, F.struct(*order)).alias(value))


def canvas(pixels: DataFrame, width: int, height: int, color: str = "color", background: int = 0) -> np.ndarray:
    """height x width x 3 bytes of (px, pz, 0xRRGGBB); refused above MAX_PIXELS, so what reaches the driver is bounded."""
    if width * height > MAX_PIXELS:
        raise ValueError("the map has too many pixels; take a larger scale")
    out = np.full((height, width), background, np.int64)
    rows = pixels.select("px", "pz", color).toArrow()
    out[np.array(rows["pz"]), np.array(rows["px"])] = np.array(rows[color])
    return np.stack([(out >> s & 255).astype(np.uint8) for s in (16, 8, 0)], -1)


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB file."""
    height, width, _ = image.shape

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * 3)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def read_png(raw: bytes, alpha: bool = False) -> np.ndarray:
    """Pixels of an 8-bit RGB or RGBA file without interlace; with alpha four channels, 255 where the file has none."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            body += raw[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, color, _, _, interlace = head or (0,) * 7
    if depth != 8 or color not in (2, 6) or interlace:
        raise ValueError("only 8-bit RGB or RGBA without interlace can be read")
    size = 3 if color == 2 else 4
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * size)
    out = np.zeros((height, width * size), np.int32)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(width * size, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            row = out[y]
            for i in range(width * size):
                a, c = (row[i - size], up[i - size]) if i >= size else (0, 0)
                b = up[i]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (line[i] + guess) & 255
    pixels = out.reshape(height, width, size).astype(np.uint8)
    if not alpha:
        return pixels[:, :, :3]
    return pixels if size == 4 else np.concatenate([pixels, np.full((height, width, 1), 255, np.uint8)], 2)
