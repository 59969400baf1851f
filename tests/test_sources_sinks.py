"""Readers and writers on made-up bytes."""

import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import polygons
from geoloom.sinks import drawings, meshes
from geoloom.sources import elevation, returns, tracks

GPX = b"""<?xml version="1.0"?><gpx xmlns="x"><trk><name>A run</name><trkseg><trkpt lon="7.5" lat="46"/><trkpt lon="7.6" lat="46.1"><ele>5</ele></trkpt></trkseg><trkseg><trkpt lon="8" lat="47"/></trkseg></trk></gpx>"""
KML = b"""<kml xmlns:gx="g"><Placemark><name>K</name><LineString><coordinates>7.5,46,0 7.6,46.1,0</coordinates></LineString><gx:Track><gx:coord>1 2 3</gx:coord></gx:Track></Placemark></kml>"""
TCX = b"""<TrainingCenterDatabase><Lap><Track><Trackpoint><Position><LatitudeDegrees>46</LatitudeDegrees><LongitudeDegrees>7.5</LongitudeDegrees></Position></Trackpoint><Trackpoint><Time>x</Time></Trackpoint></Track></Lap></TrainingCenterDatabase>"""
JSON = json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "J"}, "geometry": {"type": "MultiLineString", "coordinates": [[[7.5, 46], [7.6, 46.1]], [[1, 2, 9]]]}}]}).encode()


def fit():
    define = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 2) + bytes([0, 4, 0x85, 1, 4, 0x85])
    part = 2**31 / 180
    rows = b"".join(bytes([0]) + struct.pack("<ii", int(lat * part), int(lon * part)) for lat, lon in ((46, 7.5), (46.1, 7.6))) + bytes([0]) + struct.pack("<ii", 0x7FFFFFFF, 0x7FFFFFFF)
    body = define + rows
    return bytes([14, 16]) + struct.pack("<HI", 0, len(body)) + b".FIT" + b"\0\0" + body + b"\0\0"


def archive(name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize(("data", "name", "sizes"), [(GPX, "A run", [2, 1]), (KML, "K", [2, 1]), (TCX, "", [1]), (JSON, "J", [2, 1]), (fit(), "", [2]), (gzip.compress(GPX), "A run", [2, 1]), (archive("doc.kml", KML), "K", [2, 1]), (GPX[:-60], "A run", [2])])
def test_tracks(data, name, sizes):
    got, lines = tracks.read_track(data)
    assert got == name and [len(x) for x in lines][: len(sizes)] == sizes
    assert lines[0][0] == pytest.approx((7.5, 46), abs=1e-6)


@pytest.mark.parametrize("data", [b"", b"hello", b"<html/>", b"{]", b'<!DOCTYPE gpx [<!ENTITY a "b">]><gpx/>', archive("a.txt", b"x")])
def test_what_is_no_track(data):
    with pytest.raises(tracks.NotATrack):
        tracks.read_track(data)


def test_track_table(spark, tmp_path):
    (tmp_path / "a.gpx").write_bytes(GPX)
    (tmp_path / "b.gpx").write_bytes(b"broken")
    rows = tracks.read_tracks(spark, str(tmp_path)).collect()
    assert sorted((r.line, r.seq) for r in rows if r.problem is None) == [(0, 0), (0, 1), (1, 0)] and sum(r.problem is not None for r in rows) == 1


def las(points, kind=1):
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, kind, 28, len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBHd", round((x - 100) * 100), round((y - 200) * 100), round(z * 100), 0, n << 3 | 1, cls, 0, 0, 0, 3e8) for x, y, z, cls, n in points)
    return bytes(head) + body


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las([(101.0, 201.0, 5.0, 2, 1), (102.5, 202.0, 9.25, 6, 3), (103.0, 203.0, 1.0, 7, 1), (109.0, 209.0, 1.0, 2, 1), (101.0, 201.0, 7.0, 2 | 0x80, 1), (101.0, 201.0, 7.0, 12, 1)]))
    rows = returns.read_las(spark, str(tmp_path))
    assert rows.count() == 6 and sorted(r.cls for r in rows.collect()) == [2, 2, 2, 6, 7, 12]
    got = sorted(tuple(r)[:5] for r in returns.normalized(rows, (100, 200, 105, 205), 2.0, 1.0).collect())
    assert got == [(101.0, 201.0, 11.0, 2, True), (102.5, 202.0, 19.5, 6, False)]
    assert rows.select(returns.capture_year(F.col("gps_time"), 2030)).first()[0] == 2021


def png(pixels, rule):
    height, width, depth = pixels.shape
    raw = b""
    for y in range(height):
        own, up = pixels[y].astype(int), (pixels[y - 1] if y else np.zeros((width, depth))).astype(int)
        left, corner = np.roll(own, 1, axis=0), np.roll(up, 1, axis=0)
        left[0], corner[0] = 0, 0
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = {0: 0 * own, 1: left, 2: up, 3: (left + up) // 2, 4: np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))}[rule]
        raw += bytes([rule]) + ((own - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("rule", range(5))
def test_png(rule):
    pixels = np.random.default_rng(rule).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (elevation.png_pixels(png(pixels, rule)) == pixels).all()


def test_heights(spark):
    pixels = np.array([[[128, 10, 128], [127, 255, 0]]], np.uint8)
    got = {(r.tile_x, r.col): r.h for r in elevation.heights(spark.createDataFrame([(1, 2, png(pixels, 0)), (3, 2, None)], "tile_x int, tile_y int, content binary")).collect()}
    assert got == {(1, 0): 10.5, (1, 1): -1.0, (3, 0): 0.0}
    assert elevation.choose_zoom(7, 46, 8, 47) == 12 and elevation.tile_range(-180, -85, 180, 85, 1) == (0, 1, 0, 1)


def test_stl(spark, tmp_path):
    corner = "struct<x:double,y:double,z:double>"
    p = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    paths = meshes.write_stl(spark.createDataFrame([("m", p), ("m", p[::-1]), ("n", p)], f"model string, corners array<{corner}>"), "model", str(tmp_path))
    data = {q.rsplit("/", 1)[1]: open(q.removeprefix("file:"), "rb").read() for q in paths}
    assert len(data["m.stl"]) == 84 + 100 and struct.unpack_from("<I", data["n.stl"], 80) == (1,)
    assert struct.unpack_from("<3f", data["n.stl"], 84) == (0, 0, 1)


def test_svg(spark):
    point = "struct<x:double,y:double>"
    rows = [(1, "a&b", 2, "red", 0.5, [(0.0, 0.0), (1.25, -0.0001)], False), (1, "a&b", 1, "red", 0.5, [(3.0, 4.0), (5.0, 6.1239)], True)]
    svg = drawings.documents(spark.createDataFrame(rows, f"sheet int, layer string, place int, colour string, stroke double, points array<{point}>, closed boolean"), 10, 20).first().svg
    assert '<g id="a&amp;b" fill="none" stroke="red" stroke-width="0.5"><path d="M3 4L5 6.124Z"/><path d="M0 0L1.25 0"/></g></svg>' in svg


def test_polygons(spark):
    point = "struct<x:double,y:double>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    got = spark.createDataFrame([(1, square)], f"id int, ring array<{point}>")
    ring = F.col("ring")
    r = got.select(polygons.signed_area(ring).alias("a"), polygons.perimeter(ring).alias("p"), polygons.strip_width(ring).alias("w"), polygons.holds(ring, F.lit(1.0), F.lit(1.0)).alias("i"), polygons.holds(ring, F.lit(5.0), F.lit(1.0)).alias("o"), polygons.bounds(ring).alias("b"), polygons.signed_area(polygons.clip_to_box(ring, (1, 1, 9, 3))).alias("c")).first()
    assert (r.a, r.p, r.w, r.i, r.o, r.b.x1, r.c) == (16.0, 16.0, 2.0, True, False, 4.0, 6.0)
    assert polygons.to_mask(got).count() == 16
    assert len(polygons.hull_points(np.array([*square, (2, 2), (2, 0)]))) == 4
    turned = np.array(square) @ np.array([[0.8, 0.6], [-0.6, 0.8]])
    area = polygons.rectangle_points(np.vstack([turned, turned.mean(axis=0)]))
    assert np.linalg.norm(area[1] - area[0]) * np.linalg.norm(area[2] - area[1]) == pytest.approx(16)


def test_fit_files_one_after_another():
    course = bytes([0x41, 0, 0]) + struct.pack("<HB", 31, 1) + bytes([5, 6, 7]) + bytes([1]) + b"Loop\0\0"
    part = 2**31 / 180
    record = lambda lat, lon: bytes([0]) + struct.pack("<ii", int(lat * part), int(lon * part))
    define = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 2) + bytes([0, 4, 0x85, 1, 4, 0x85])
    lost = bytes([0]) + struct.pack("<ii", 0x7FFFFFFF, 0x7FFFFFFF)
    body = course + define + record(46, 7) + lost + record(47, 8) + record(48, 9)
    more = bytes([12, 16]) + struct.pack("<HI", 0, len(body)) + b".FIT" + body + b"\0\0"
    name, lines = tracks.read_fit(fit() + more)
    assert name == "Loop" and [len(x) for x in lines] == [2, 1, 2]
    assert lines[2][1] == pytest.approx((9, 48), abs=1e-6)
    assert [len(x) for x in tracks.read_fit((fit() + more)[:-6])[1]] == [2, 1, 1]
