"""Recorded tracks from GPX, KML, KMZ, TCX, GeoJSON and FIT files, also gzipped, as vertex rows."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_POINTS = 50 << 20, 2_000_000
ROWS = "path string, name string, line bigint, seq bigint, lon double, lat double, problem string"
Lines = list[list[tuple[float, float]]]


class NotATrack(ValueError):
    pass


def _tags(data: bytes, start, text) -> str:
    """Calls start(tag, attributes, open tags) and text(tag, text, open tags) at each end; returns the root's tag. Prefixes go.

    No document type is allowed, so entities can't multiply."""
    parser, stack, root, held = expat.ParserCreate(), [], [], [[]]

    def begin(name: str, attributes: dict) -> None:
        stack.append(name.rpartition(":")[2])
        root[:] = root or stack
        held.append([])
        start(stack[-1], attributes, stack)

    def end(_: str) -> None:
        text(stack[-1], "".join(held.pop()), stack)
        stack.pop()

    def refuse(*_: object) -> None:
        raise NotATrack("a document type isn't allowed")

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.CharacterDataHandler = lambda s: held[-1].append(s)
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as wrong:
        if not root:
            raise NotATrack(str(wrong)) from wrong
    return root[0]


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def read_xml(data: bytes) -> tuple[str, Lines]:
    """GPX tracks and routes, KML lines and gx:Tracks, TCX laps. Cut-off files give what came before."""
    lines: Lines = []
    name: list[str] = []
    here: dict[str, float | None] = {}

    def start(tag: str, attributes: dict, stack: list[str]) -> None:
        if tag in ("trkseg", "rte", "Track", "Lap") and not (tag == "Track" and "Lap" in stack):
            lines.append([])
        if tag in ("trkpt", "rtept") and lines:
            lon, lat = _number(attributes.get("lon", "")), _number(attributes.get("lat", ""))
            if lon is not None and lat is not None:
                lines[-1].append((lon, lat))

    def text(tag: str, value: str, stack: list[str]) -> None:
        if tag == "name" and not name and value.strip():
            name.append(value.strip())
        elif tag == "coordinates" and "LineString" in stack:
            pairs = [[_number(v) for v in p.split(",")[:2]] for p in value.split()]
            lines.append([(p[0], p[1]) for p in pairs if len(p) == 2 and None not in p])
        elif tag == "coord" and lines:
            pair = [_number(v) for v in value.split()[:2]]
            if len(pair) == 2 and None not in pair:
                lines[-1].append((pair[0], pair[1]))
        elif tag in ("LongitudeDegrees", "LatitudeDegrees"):
            here[tag] = _number(value)
        elif tag == "Trackpoint" and lines:
            lon, lat = here.pop("LongitudeDegrees", None), here.pop("LatitudeDegrees", None)
            if lon is not None and lat is not None:
                lines[-1].append((lon, lat))

    root = _tags(data, start, text)
    if root not in ("gpx", "kml", "TrainingCenterDatabase"):
        raise NotATrack(f"a {root} file has no tracks")
    return (name or [""])[0], [x for x in lines if x]


def read_geojson(data: bytes) -> tuple[str, Lines]:
    lines: Lines = []
    name: list[str] = []

    def walk(node: object) -> None:
        if not isinstance(node, dict):
            return
        if isinstance(node.get("properties"), dict) and isinstance(node["properties"].get("name"), str):
            name.append(node["properties"]["name"])
        for key in ("features", "geometries"):
            for x in node.get(key) or []:
                walk(x)
        walk(node.get("geometry"))
        parts = {"LineString": lambda c: [c], "MultiLineString": lambda c: c}.get(node.get("type"), lambda c: [])(node.get("coordinates") or [])
        lines.extend([(float(p[0]), float(p[1])) for p in part if len(p) >= 2] for part in parts)

    try:
        walk(json.loads(data))
    except (ValueError, TypeError, AttributeError) as wrong:
        raise NotATrack("not GeoJSON") from wrong
    return (name or [""])[0], [x for x in lines if x]


def read_fit(data: bytes) -> tuple[str, Lines]:
    """Positions of the record messages (global number 20, fields 0 and 1, in 2 ** 31 parts of 180 degrees) of all FIT files that
    stand one after another, and the name of the first course (31, field 5). A record without a position parts lines."""
    name, lines, at = "", [], 0
    while at + 12 <= len(data) and data[at] in (12, 14) and data[at + 8 : at + 12] == b".FIT":
        end = at + data[at] + struct.unpack_from("<I", data, at + 4)[0]
        line: list[tuple[float, float]] = []
        for number, fields in _fit_messages(data, at + data[at], min(end, len(data))):
            if number == 31 and not name:
                name = fields[5][1].split(b"\0")[0].decode("utf-8", "replace") if 5 in fields else ""
            places = [struct.unpack(f"{order}i", raw)[0] for order, raw in (fields[f] for f in (1, 0) if f in fields) if len(raw) == 4]
            if number != 20 or len(places) != 2:
                continue
            if 0x7FFFFFFF not in places:
                line.append((places[0] * 180 / 2**31, places[1] * 180 / 2**31))
            elif line:
                lines.append(line)
                line = []
        lines += [line] if line else []
        at = end + 2  # its checksum
    return name, lines


def _fit_messages(data: bytes, at: int, end: int) -> Iterator[tuple[int, dict[int, tuple[str, bytes]]]]:
    """The global number of each data message of one FIT file, and the byte order and bytes of its fields."""
    kinds: dict[int, tuple[str, int, list[tuple[int, int]], int]] = {}
    while at < end:
        head = data[at]
        at += 1
        local = head >> 5 & 3 if head & 0x80 else head & 15
        if not head & 0x80 and head & 0x40:
            if at + 5 > end:
                return
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack_from(f"{order}HB", data, at + 2)
            fields = [(data[at + 5 + 3 * k], data[at + 6 + 3 * k]) for k in range(n) if at + 6 + 3 * k < end]
            at += 5 + 3 * n
            extra = 0
            if head & 0x20 and at < end:
                extra = sum(data[at + 2 + 3 * k] for k in range(data[at]) if at + 2 + 3 * k < end)
                at += 1 + 3 * data[at]
            kinds[local] = (order, number, fields, sum(s for _, s in fields) + extra)
            continue
        if local not in kinds:
            return
        order, number, fields, size = kinds[local]
        if at + size > end:
            return
        told, place = {}, at
        for field, width in fields:
            told[field] = (order, data[place : place + width])
            place += width
        yield number, told
        at += size


def read_track(data: bytes) -> tuple[str, Lines]:
    """Name and lines of a track file of any kind, told by its bytes."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = zlib.decompressobj(31).decompress(data, MOST_BYTES + 1)
        except zlib.error as wrong:
            raise NotATrack("broken gzip") from wrong
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inner = [i for i in z.infolist() if i.filename.lower().endswith((".kml", ".gpx", ".tcx", ".fit", ".geojson", ".json")) and i.file_size <= MOST_BYTES]
            if not inner:
                raise NotATrack("no track in the archive")
            found = [read_track(z.read(i)) for i in inner]
        return found[0][0], [x for _, part in found for x in part]
    if len(data) > MOST_BYTES:
        raise NotATrack("the file is too large")
    if data[8:12] == b".FIT":
        return read_fit(data)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        data = data.decode("utf-16").encode()
    start = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
    name, lines = read_geojson(data) if start in (b"{", b"[") else read_xml(data)
    if sum(map(len, lines)) > MOST_POINTS:
        raise NotATrack("the file has too many points")
    return name, lines


def track_rows(files: DataFrame) -> DataFrame:
    """Vertices of files (path, content), a file per task row. One that can't be read has a single row with its problem."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    name, lines = read_track(bytes(content))
                    rows = [(path, name, k, i, lon, lat, None) for k, line in enumerate(lines) for i, (lon, lat) in enumerate(line)]
                    rows = rows or [(path, name, None, None, None, None, "no points")]
                except (NotATrack, zipfile.BadZipFile, struct.error, IndexError, UnicodeDecodeError) as wrong:
                    rows = [(path, None, None, None, None, None, str(wrong) or type(wrong).__name__)]
                yield pd.DataFrame(rows, columns=names).astype({"line": "Int64", "seq": "Int64", "lon": "float64", "lat": "float64"})

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return track_rows(spark.read.format("binaryFile").load(path))


def on_the_globe() -> Column:
    """Rows that are places: finite, in range, and not (0, 0), which devices write without a fix."""
    lon, lat = F.col("lon"), F.col("lat")
    return lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))

