"""Gridded surfaces as Structured Streaming aggregations: one pass, and state per cell only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.raster import to_grid
from geoloom.sources.tables import cut, shared_folder


def running_layers(points: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0) -> DataFrame:
    """Returns per cell and the highest of them, of a batch or a stream (output mode update or complete)."""
    return to_grid(points, x0, y0, dx).groupBy("row", "col").agg(F.count("*").alias("n_returns"), F.max("z").alias("top"))


def windowed_layers(points: DataFrame, length: str, late: str, dx: float = 1.0) -> DataFrame:
    """The same per time window of points with ts, for streams whose returns come up to `late` out of order (output mode append)."""
    gridded = to_grid(points.withWatermark("ts", late), 0.0, 0.0, dx)
    return gridded.groupBy(F.window("ts", length).alias("window"), "row", "col").agg(F.count("*").alias("n_returns"), F.max("z").alias("top"))


def replayed(points: DataFrame) -> DataFrame:
    """running_layers of points that are read as a stream of files until none is left. The last state of each cell stays."""
    spark = points.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    points.select("x", "y", "z").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("x double, y double, z double").parquet(f"{base}/in")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch replayed after a failure takes the place of what it left
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = running_layers(stream).writeStream.outputMode("complete").foreachBatch(keep)
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch")).first()[0]
    return cut(out.where(F.col("batch") == last).drop("batch"))
