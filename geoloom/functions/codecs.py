"""Binary and text codecs as Arrow functions: well-known binary, encoded polylines, LAS points."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def wkb_rings(data: bytes | None) -> list[list[tuple[float, float]]] | None:
    """Point lists of a WKB or EWKB geometry, in order: one for a point or line, one per ring or member else. Z and M go.
    None for null, unknown, truncated or overlong bytes."""
    if data is None:
        return None
    out: list[list[tuple[float, float]]] = []

    def geometry(at: int, depth: int) -> int:
        if depth > 8:
            raise ValueError
        order = {0: ">", 1: "<"}[data[at]]
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4  # a reference system
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code & 0x1FFFFFFF
        if kind >= 1000:
            size, kind = 2 + (1, 1, 2)[kind // 1000 - 1], kind % 1000

        def points(at: int, n: int) -> int:
            if n * size * 8 > len(data) - at:
                raise ValueError
            out.append([(float(p[0]), float(p[1])) for p in np.frombuffer(data, f"{order}f8", n * size, at).reshape(n, size)])
            return at + n * size * 8

        def count(at: int) -> int:
            (n,) = struct.unpack_from(f"{order}I", data, at)
            if n > len(data):
                raise ValueError
            return n

        if kind == 1:
            return points(at, 1)
        n, at = count(at), at + 4
        if kind == 2:
            return points(at, n)
        if kind == 3:
            for _ in range(n):
                at = points(at + 4, count(at))
            return at
        if kind in (4, 5, 6, 7):
            for _ in range(n):
                at = geometry(at, depth + 1)
            return at
        raise ValueError

    try:
        return out if geometry(0, 0) == len(data) else None
    except (ValueError, KeyError, IndexError, struct.error):
        return None


@F.pandas_udf(T.ArrayType(T.ArrayType(POINT)))
def parse_wkb(data: pd.Series) -> pd.Series:
    return data.map(lambda d: (r := wkb_rings(d)) and [[{"x": x, "y": y} for x, y in ring] for ring in r])


def encoded(points: list[tuple[float, float]]) -> str:
    """(lon, lat) pairs as an encoded polyline: latitude first, differences in 1e-5 degrees, five bits a character."""
    out, last = [], (0, 0)
    for lon, lat in points:
        now = tuple(int(np.floor(v * 1e5 + 0.5)) for v in (lat, lon))
        for v, before in zip(now, last, strict=True):
            v = (v - before) << 1 if v >= before else ~((v - before) << 1)
            while v >= 0x20:
                out.append(chr((v & 0x1F | 0x20) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decoded(text: str | None) -> list[tuple[float, float]]:
    """The (lon, lat) pairs of an encoded polyline, up to the first that isn't valid."""
    out, place, at = [], [0, 0], 0
    text = text or ""
    while at < len(text):
        for k in (0, 1):
            value = shift = 0
            while True:
                if at >= len(text) or shift > 25 or not 0 <= (code := ord(text[at]) - 63) <= 63:
                    return out
                at += 1
                value |= (code & 0x1F) << shift
                shift += 5
                if code < 0x20:
                    break
            place[k] += ~(value >> 1) if value & 1 else value >> 1
        out.append((place[1] / 1e5, place[0] / 1e5))
    return out


@F.pandas_udf(T.StringType())
def encode_polyline(points: pd.Series) -> pd.Series:
    return points.map(lambda ps: None if ps is None else encoded([(p["x"], p["y"]) for p in ps]))


@F.pandas_udf(T.ArrayType(POINT))
def decode_polyline(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"x": x, "y": y} for x, y in decoded(t)])
