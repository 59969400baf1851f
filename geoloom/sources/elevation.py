"""Elevation tiles: PNG images whose red, green and blue hold metres, and which tiles an area needs."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TILES, MOST_ZOOM = 256, 15


def png_pixels(data: bytes) -> np.ndarray:
    """Rows by columns by channels of an 8-bit RGB or RGBA image without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, shape = 8, [], None
    while at < len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or colour not in (2, 6) or interlaced:
                raise ValueError("an image of another kind")
            shape = (height, width, 3 if colour == 2 else 4)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + length
    if shape is None:
        raise ValueError("an image without a header")
    height, width, depth = shape
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width, depth), np.uint8)
    above = np.zeros((width, depth), np.uint8)
    for y in range(height):
        rule, own = raw[y, 0], raw[y, 1:].reshape(width, depth)
        if rule == 0:
            row = own
        elif rule == 1:
            row = np.cumsum(own, axis=0, dtype=np.uint8)
        elif rule == 2:
            row = own + above
        else:
            row = np.zeros_like(own)
            left, corner = np.zeros(depth, np.int16), np.zeros(depth, np.int16)
            for x in range(width):
                up = above[x].astype(np.int16)
                if rule == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x] = (own[x] + guess) & 255
                left, corner = row[x].astype(np.int16), up
        out[y] = above = row
    return out


def tile_range(west: float, south: float, east: float, north: float, zoom: int) -> tuple[int, int, int, int]:
    """First and last column and row of the Web Mercator tiles that an area touches."""
    n = 2**zoom

    def place(lon: float, lat: float) -> tuple[float, float]:
        rad = math.radians(lat)
        return (lon + 180) / 360 * n, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n

    (x0, y0), (x1, y1) = place(west, north), place(east, south)
    inside = lambda v: max(0, min(n - 1, math.floor(v)))
    return inside(x0), inside(x1), inside(y0), inside(y1)


def choose_zoom(west: float, south: float, east: float, north: float, most: int = MOST_ZOOM) -> int:
    """The deepest zoom at which an area takes MOST_TILES tiles at most."""
    for zoom in range(most, 0, -1):
        x0, x1, y0, y1 = tile_range(west, south, east, north, zoom)
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= MOST_TILES:
            return zoom
    return 0


def heights(tiles: DataFrame) -> DataFrame:
    """(tile_x, tile_y, row, col, h) of tiles (tile_x, tile_y, content): red * 256 + green + blue / 256 - 32768 metres.

    A tile without content (not there) is sea level, one row by one column; so is one that can't be read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, content in zip(*(batch.column(c).to_pylist() for c in ("tile_x", "tile_y", "content")), strict=True):
                try:
                    rgb = png_pixels(content)[..., :3].astype(float) if content else np.array([[[128.0, 0.0, 0.0]]])
                except (ValueError, zlib.error, struct.error):
                    rgb = np.array([[[128.0, 0.0, 0.0]]])
                h = rgb @ np.array([256, 1, 1 / 256]) - 32768
                row, col = np.indices(h.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h.size, v, np.int64)) for v in (x, y)] + [pa.array(row.ravel()), pa.array(col.ravel()), pa.array(h.ravel())], names=["tile_x", "tile_y", "row", "col", "h"])

    return tiles.select(F.col("tile_x").cast("bigint"), F.col("tile_y").cast("bigint"), "content").mapInArrow(run, "tile_x bigint, tile_y bigint, row bigint, col bigint, h double")
