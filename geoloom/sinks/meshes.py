"""Triangle meshes as binary STL, one file a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = b"geoloom mesh".ljust(80, b"\0")
_FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])


def facets(corners: np.ndarray) -> bytes:
    """STL facets of n by 3 by 3 corners; normals by the right hand, zero for a facet without area."""
    corners = np.asarray(corners, float).reshape(-1, 3, 3)
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    out = np.zeros(len(corners), _FACET)
    out["normal"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
    out["corners"] = corners
    return out.tobytes()


def stl_parts(triangles: DataFrame, model: str) -> DataFrame:
    """(model, part, n, content): facets of triangles (model, corners) as they lie in the partitions, so no model is held whole."""
    types = dict(triangles.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, len(own), facets([[[p["x"], p["y"], p["z"]] for p in t] for t in own])) for m, own in pdf.groupby(model, sort=True).corners]
            yield pd.DataFrame(rows, columns=[model, "n", "content"])

    parts = triangles.select(model, "corners").mapInPandas(run, f"{model} {types[model]}, n bigint, content binary")
    return parts.withColumn("part", F.monotonically_increasing_id())


def write_stl(triangles: DataFrame, model: str, folder: str) -> list[str]:
    """A file for each model under folder, on any file system that Spark reaches; the driver holds one part at a time."""
    from geoloom.sources.tables import cut

    spark = triangles.sparkSession
    parts = cut(stl_parts(triangles, model))
    counts = {r[model]: r["n"] for r in parts.groupBy(model).agg(F.sum("n").alias("n")).collect()}
    hadoop, paths = spark._jvm.org.apache.hadoop.fs, []
    for m, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        where = hadoop.Path(f"{folder}/{m}.stl")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(HEADER + int(n).to_bytes(4, "little")))
        for row in parts.where(F.col(model) == F.lit(m)).orderBy("part").select("content").toLocalIterator():
            out.write(bytearray(row["content"]))
        out.close()
        paths.append(where.toString())
    return paths
