"""Record, result and run-metric sinks (SNK1-SNK5)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pubmetrics.operators.schema import ORDER_COLUMN
from pubmetrics.sources.shared import freed_shuffles

TABLE_FORMATS = ("parquet", "csv")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system (local, HDFS or object store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_as(df: DataFrame, path: str) -> DataFrame:
    """A stored table read with the schema of what was written; an empty one has no file to infer it from."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, base: str, partition_by: str | None = None) -> DataFrame:
    """A work table written in place of any earlier one, and read again."""
    return read_as(df, write_records(df, base, "parquet", overwrite=True, partition_by=partition_by))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a path on its own file system; the folder above the new one is made."""
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there.getParent())
    if files.exists(there) or not files.rename(here, there):
        raise OSError(f"cannot move {path} to {to}")


def beside(path: str, purpose: str) -> str:
    """A new hidden name in the same folder, which readers of that folder leave out."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{purpose}-{name}-{uuid.uuid4().hex}" if folder else f"_{purpose}-{name}-{uuid.uuid4().hex}"


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished table in the place of an earlier one, which is deleted last.

    The earlier table is set aside by a rename and comes back if the new one cannot take its place.
    """
    if not path_exists(spark, path):
        return move(spark, staged, path)
    old = beside(path, "old")
    move(spark, path, old)
    try:
        move(spark, staged, path)
    except Exception:
        move(spark, old, path)
        raise
    remove(spark, old)


def staged_write(
    spark: SparkSession,
    path: str,
    write: Callable[[str], None],
    *,
    overwrite: bool = False,
    also: Sequence[str] = (),
) -> None:
    """SNK1 / SNK2: `write` a table to a hidden path beside `path`, and move it in when it is whole.

    What is written may read from `path`. Until then, and if the write fails, the table at `path` and
    those at `also`, which the new one replaces too, stay as they are. Without `overwrite`
    none of them may exist, `FileExistsError` else.
    """
    if not overwrite:
        for known in (path, *also):
            if path_exists(spark, known):
                raise FileExistsError(f"output already exists: {known}")
    staged = beside(path, "staged")
    try:
        with freed_shuffles(spark):
            write(staged)
    except BaseException:
        remove(spark, staged)
        raise
    if not overwrite and path_exists(spark, path):
        remove(spark, staged)
        raise FileExistsError(f"output was written meanwhile: {path}")
    swap_in(spark, staged, path)
    for known in also:
        if path_exists(spark, known):
            remove(spark, known)


def write_records(
    df: DataFrame,
    base: str,
    fmt: str | None = None,
    *,
    overwrite: bool = False,
    partition_by: str | None = None,
    observe: tuple[Observation, Sequence[Column]] | None = None,
    drop: Sequence[str] = (),
    order: Sequence[str] = (ORDER_COLUMN,),
) -> str:
    """SNK1 / SNK2: write `<base>.<fmt>` and return its path.

    The format is `fmt`, else the suffix of `base`, else parquet. Output existing in either
    format raises `FileExistsError` unless `overwrite`. The table is staged: the frame may read what
    it replaces, in either format, and a failed write leaves that as it was.

    `observe` takes an observation and its measures over the rows as they are written, in the tasks
    that write them, so no row is read for it and none counts twice; the columns `drop` are measured, not written.

    CSV keeps the rows in the order of the columns `order` that the frame has, and does not hold these nor `src_ord`.
    No row moves for it if the frame already lies in ranges of the first of them.
    """
    for known in TABLE_FORMATS:
        if base.endswith(f".{known}"):
            base, fmt = base[: -len(known) - 1], fmt or known
    fmt = fmt or "parquet"
    if fmt not in TABLE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}: expected one of {', '.join(TABLE_FORMATS)}")
    path = f"{base}.{fmt}"
    order = [c for c in order if c in df.columns]
    if fmt == "csv" and order:
        # Text files keep the order by position: sorted parts, read back in path order.
        df = df.orderBy(*order).drop(*order, ORDER_COLUMN)
    if fmt == "parquet" and partition_by is not None:
        df = df.hint("rebalance", F.col(partition_by))
    if observe is not None:
        df = df.observe(observe[0], *observe[1])
    df = df.drop(*drop)

    def write(staged: str) -> None:
        if fmt == "csv":
            _csv(df, staged)
        else:
            (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(staged)

    others = [f"{base}.{known}" for known in TABLE_FORMATS if known != fmt]
    staged_write(df.sparkSession, path, write, overwrite=overwrite, also=others)
    return path


def write_csv(
    df: DataFrame, path: str, *, overwrite: bool = False, single_file: bool = False
) -> None:
    """SNK3: CSV with header, readable by `read_export`, staged as `write_records` does.

    `single_file` is for tables of bounded size: annual series, top-k lists, KPI rows.
    """
    out = df.coalesce(1) if single_file else df
    if not overwrite and path_exists(df.sparkSession, path):
        return _csv(out, path)  # which Spark refuses
    staged_write(df.sparkSession, path, lambda staged: _csv(out, staged), overwrite=overwrite)


def _csv(df: DataFrame, path: str) -> None:
    # Null and '' are both written as nothing, and surrounding blanks are data.
    df.write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    """SNK5: the metric rows of a run in a JSON-lines table by `run_id`; a rerun replaces its own rows."""
    if "run_id" not in metrics.columns:
        raise ValueError("run metrics need a run_id column")
    writer = metrics.coalesce(1).write.mode("overwrite").partitionBy("run_id")
    writer.option("partitionOverwriteMode", "dynamic").json(path)
