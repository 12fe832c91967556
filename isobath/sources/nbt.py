"""Named binary tags, big endian: only the wanted paths are decoded, everything else is skipped by its length."""

from __future__ import annotations

import struct

import numpy as np

MAX_DEPTH = 512
# Payload sizes of the plain tags 1..6.
_SIZES = {1: 1, 2: 2, 3: 4, 4: 8, 5: 4, 6: 8}
_FORMATS = {1: ">b", 2: ">h", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}
_ARRAYS = {7: (">i1", 1), 11: (">i4", 4), 12: (">i8", 8)}


class NbtError(ValueError):
    pass


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise NbtError("the data end inside a tag")
        self.at += n
        return self.data[self.at - n : self.at]

    def plain(self, tag: int):
        return struct.unpack(_FORMATS[tag], self.take(_SIZES[tag]))[0]

    def text(self) -> str:
        return self.take(struct.unpack(">H", self.take(2))[0]).decode("utf-8", "replace")

    def count(self) -> int:
        n = struct.unpack(">i", self.take(4))[0]
        if n < 0:
            raise NbtError("a negative length")
        return n

    def skip(self, tag: int, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise NbtError("tags are nested too deeply")
        if tag in _SIZES:
            self.take(_SIZES[tag])
        elif tag in _ARRAYS:
            self.take(self.count() * _ARRAYS[tag][1])
        elif tag == 8:
            self.take(struct.unpack(">H", self.take(2))[0])
        elif tag == 9:
            inner, n = self.take(1)[0], self.count()
            if inner in _SIZES:
                self.take(n * _SIZES[inner])
            elif n:
                for _ in range(n):
                    self.skip(inner, depth + 1)
        elif tag == 10:
            while (inner := self.take(1)[0]) != 0:
                self.take(struct.unpack(">H", self.take(2))[0])
                self.skip(inner, depth + 1)
        elif tag:
            raise NbtError(f"unknown tag {tag}")

    def value(self, tag: int, want: dict | None, depth: int = 0):
        """Payload of a tag. want: names to keep of compounds, each with its own want, or None for all."""
        if depth > MAX_DEPTH:
            raise NbtError("tags are nested too deeply")
        if tag in _SIZES:
            return self.plain(tag)
        if tag in _ARRAYS:
            kind, size = _ARRAYS[tag]
            return np.frombuffer(self.take(self.count() * size), kind)
        if tag == 8:
            return self.text()
        if tag == 9:
            inner, n = self.take(1)[0], self.count()
            return [self.value(inner, want, depth + 1) for _ in range(n)] if inner else []
        if tag != 10:
            raise NbtError(f"unknown tag {tag}")
        out = {}
        while (inner := self.take(1)[0]) != 0:
            name = self.text()
            if want is None or name in want:
                out[name] = self.value(inner, None if want is None else want[name], depth + 1)
            else:
                self.skip(inner, depth + 1)
        return out


def read(data: bytes, want: dict | None = None) -> dict:
    """The root compound."""
    r = Reader(data)
    if r.take(1)[0] != 10:
        raise NbtError("the root is no compound")
    r.text()
    return r.value(10, want)


def write(value, name: str = "") -> bytes:
    """Bytes of a root compound: dict, list, str, int, float, bool and numpy arrays of 8, 32 or 64 bits (tests and generators)."""

    def kind(v) -> int:
        if isinstance(v, dict):
            return 10
        if isinstance(v, (list, tuple)):
            return 9
        if isinstance(v, str):
            return 8
        if isinstance(v, np.ndarray):
            return {1: 7, 4: 11, 8: 12}[v.dtype.itemsize]
        if isinstance(v, bool):
            return 1
        return 3 if isinstance(v, int) else 6

    def body(v) -> bytes:
        k = kind(v)
        if k == 10:
            return b"".join(bytes([kind(x)]) + text(n) + body(x) for n, x in v.items()) + b"\0"
        if k == 9:
            return bytes([kind(v[0]) if v else 0]) + struct.pack(">i", len(v)) + b"".join(map(body, v))
        if k == 8:
            return text(v)
        if k in _ARRAYS:
            return struct.pack(">i", len(v)) + v.astype(_ARRAYS[k][0]).tobytes()
        return struct.pack(_FORMATS[k], v)

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">H", len(raw)) + raw

    return b"\x0a" + text(name) + body(value)
