"""LiDAR returns from LAS files, and the rules by which returns become points."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, x double, y double, z double, cls smallint, return_number smallint, n_returns smallint, withheld boolean, overlap boolean, gps_time double"
#: Classes that count, under the numbers they count as.
CLASSES = {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 8: 8, 9: 9, 10: 10, 11: 11, 17: 17, 19: 19, 20: 20, 21: 21}
# Byte of the GPS time in a record of each format that has one.
_TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
_STEP = 1 << 18


def las_points(content: bytes) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the records of an uncompressed LAS 1.0 to 1.4 file, some records at a time."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = content[25]
    start, = struct.unpack_from("<I", content, 96)
    kind, size, n = struct.unpack_from("<BHI", content, 104)
    if kind & 0x80:
        raise ValueError("compressed records aren't read")
    if minor >= 4 and len(content) >= 255:
        n = struct.unpack_from("<Q", content, 247)[0] or n
    scale, offset = np.frombuffer(content, "<f8", 3, 131), np.frombuffer(content, "<f8", 3, 155)
    n = min(n, (len(content) - start) // size)
    for low in range(0, n, _STEP):
        some = min(_STEP, n - low)
        raw = np.frombuffer(content, np.uint8, some * size, start + low * size).reshape(some, size)
        place = raw[:, :12].copy().view("<i4") * scale + offset
        wide = kind >= 6
        flags = raw[:, 15] if wide else raw[:, 15] >> 5
        yield {
            "x": place[:, 0], "y": place[:, 1], "z": place[:, 2], "cls": (raw[:, 16] if wide else raw[:, 15] & 31).astype(np.int16),
            "return_number": (raw[:, 14] & (15 if wide else 7)).astype(np.int16), "n_returns": (raw[:, 14] >> 4 if wide else raw[:, 14] >> 3 & 7).astype(np.int16),
            "withheld": (flags & 4) > 0, "overlap": (flags & 8) > 0 if wide else (raw[:, 15] & 31) == 12,
            "gps_time": raw[:, _TIME_AT[kind] : _TIME_AT[kind] + 8].copy().view("<f8")[:, 0] if kind in _TIME_AT else np.full(some, np.nan),
        }


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """A row per return of the LAS files under path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for columns in las_points(content.as_py()):
                    n = len(columns["x"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(pa.array(v) for v in columns.values())], names=["path", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def class_of(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv)), code.cast("int"))


def normalized(returns: DataFrame, box: tuple[float, float, float, float], z_factor: float = 1.0, z_offset: float = 0.0) -> DataFrame:
    """Returns in the box, edges included, as points (x, y, z, cls, single): without withheld, overlapping and non-finite ones
    and those of other classes. The comparisons with the box reach the scan of a columnar source."""
    x0, y0, x1, y1 = box
    kept = returns.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & ~F.coalesce("withheld", F.lit(False)) & ~F.coalesce("overlap", F.lit(False)))
    points = kept.withColumns({"cls": class_of(F.col("cls")), "z": F.col("z") * z_factor + z_offset})
    finite = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))
    return points.where(F.col("cls").isNotNull() & finite).select("x", "y", "z", "cls", (F.col("n_returns") == 1).alias("single"), "gps_time")


def capture_year(gps_time: Column, last_year: int) -> Column:
    """Year of an adjusted GPS time (seconds less 1e9 since 1980-01-06), 1990 to last_year; null for any other number."""
    year = F.year(F.timestamp_seconds(F.lit(315964800) + 1_000_000_000 + gps_time))
    return F.when((gps_time > -1e9) & (gps_time < 4e9) & year.between(1990, last_year), year)
