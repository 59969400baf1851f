"""What several operators use: the shared folder, written tables, folds and slices of Arrow text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_NAMED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset on one machine, as in tests, one of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is read by column.

    The tables go when the driver's Python ends, for DataFrames returned to callers still read them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, parts: int, compression: str = "zstd") -> DataFrame:
    """df as written does, as a table of so many buckets by key, a file each: joins by key with what is repartitioned by that number
    don't shuffle it. Its name is in the catalog until the driver's Python ends."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    out = df.repartition(parts, key).write.option("compression", compression).option("path", path)
    out.format("parquet").bucketBy(parts, key).saveAsTable(name)
    _WRITTEN.append((spark, path))
    _NAMED.append((spark, name))
    return spark.table(name)


@atexit.register
def _forget() -> None:
    for spark, name in _NAMED:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  as below
            break
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before; its folder is then the cluster's to clean
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a shuffle of df's rows: the session's number, or more where the files are larger."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return conf if size > 1 << 60 else max(conf, -(-size // bytes_each))


def tasks_for(table: DataFrame, rows_each: int) -> int:
    """Tasks for a table, as written, of which some thousands of rows keep a task busy however few bytes they are."""
    return max(1, min(10_000, -(-table.count() // rows_each)))


def as_text(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts end to end, and the n + 1 bounds of the texts in them."""
    column = as_text(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text; a longer text is alone in its run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
