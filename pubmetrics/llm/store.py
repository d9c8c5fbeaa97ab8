"""Folders that all executors share, and sums of count blobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return qualified(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark finds it on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def made_folder(spark: SparkSession, folder: str) -> None:
    """Make a folder that tasks may leave empty, so that it can be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """A task's own access to a folder: its file system and the path there."""
    if folder.startswith(("s3a://", "s3n://")):
        folder = "s3" + folder[3:]
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


#: Rows that one file of a table of known size should have at least.
ROWS_A_FILE = 100_000


def stored(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage.

    ``most``: a bound of the rows, where one is known. A small table is then written by few tasks, not one for
    each shuffle partition, and read by as few; beyond ROWS_A_FILE rows a partition nothing changes.
    """
    return counted(df, name, most)[0]


def counted(df: DataFrame, name: str, most: int | None = None, *more: Column) -> tuple[DataFrame, dict]:
    """The stored rows, and their count ``n`` and other aggregates, taken by the tasks that write them."""
    spark = df.sparkSession
    path, seen = shared_folder(spark, name), Observation()
    if most is not None:
        files = max(1, -(-most // ROWS_A_FILE))
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    df.observe(seen, F.count(F.lit(1)).alias("n"), *more).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def put(folder: str, name: str, data: bytes | pa.Buffer, attempt: str) -> str:
    """Write one file of a task: to a name of its own first, so that a lost or repeated attempt leaves no half file."""
    files, path = file_system(folder)
    files.create_dir(path)
    with files.open_output_stream(f"{path}/_{name}.{attempt}", compression=None) as out:
        out.write(data)
    files.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")
    return f"{folder}/{name}"


def add_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum compressed int64 count blobs by (name, piece), holding one blob of each."""
    sums: dict[tuple, np.ndarray] = {}
    for b in batches:
        for name, piece, blob in zip(*(b.column(c) for c in ("name", "piece", "counts"))):
            key, counts = (name.as_py(), piece.as_py()), np.frombuffer(zstandard.decompress(blob.as_py()), np.int64)
            if key in sums:
                sums[key] += counts
            else:
                sums[key] = counts.copy()
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["name", "piece", "counts"])


BLOBS = "name string, piece int, counts binary"


def blob_rows(name: str | None, counts: np.ndarray, pieces: int) -> list[tuple]:
    """Rows of BLOBS for one count vector, cut into pieces."""
    return [(name, i, zstandard.compress(c.astype(np.int64).tobytes(), 1)) for i, c in enumerate(np.array_split(counts, pieces))]


def summed_blobs(df: DataFrame) -> dict[str | None, np.ndarray]:
    """Count vectors by name, added up in tasks; only the sums reach the driver, in one job whatever the partitions."""
    found: dict[str | None, dict[int, np.ndarray]] = {}
    for r in df.repartition("name", "piece").mapInArrow(add_blobs, BLOBS).collect():
        found.setdefault(r["name"], {})[r["piece"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64)
    return {k: np.concatenate([v[i] for i in sorted(v)]) for k, v in found.items()}
