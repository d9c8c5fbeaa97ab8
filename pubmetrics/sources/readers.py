"""Record table readers (SRC1-SRC3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pubmetrics.operators.schema import ORDER_COLUMN
from pubmetrics.sources.exports import header_names, read_split_export
from pubmetrics.sources.ordering import with_source_order

# Cell texts that a bibliographic CSV export uses for "no value".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

FORMATS = ("parquet", "csv", "json")


def load_records(
    spark: SparkSession, path: str, fmt: str | None = None, *, ordered: bool = False, **options
) -> DataFrame:
    """SRC1: a record table in an explicit format, by the path's suffix, or by what exists.

    A path without a known suffix is tried as `.parquet`, then `.csv`; neither existing raises
    `FileNotFoundError`.
    """
    if fmt is None:
        fmt = next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), None)
    if fmt is not None:
        return _read(spark, path, fmt, ordered, options)
    for candidate in ("parquet", "csv"):
        try:
            return _read(spark, f"{path}.{candidate}", candidate, ordered, options)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no parquet or csv table at base path {path}")


def _read(
    spark: SparkSession, path: str, fmt: str, ordered: bool, options: dict
) -> DataFrame:
    if fmt == "parquet":
        df = spark.read.options(**options).parquet(path)
        return with_source_order(df, row_index=True) if ordered else df
    if fmt == "csv":
        return read_export(spark, path, ordered=ordered, **options)
    if fmt == "json":
        return read_json_records(spark, path, ordered=ordered, **options)
    raise ValueError(f"unknown format {fmt!r}: expected one of {', '.join(FORMATS)}")


def read_export(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    ordered: bool = False,
    multi_line: bool | str = True,
    null_tokens: Sequence[str] = NULL_TOKENS,
    sep: str = ",",
) -> DataFrame:
    """SRC2: a CSV export, every column a string, header names trimmed.

    Quoted newlines need `multi_line`, which reads each file in one task: give many files,
    turn it off where no field holds a newline so that large files split, or give "split", which
    reads large files with quoted newlines in many tasks (`read_split_export`). Nothing is inferred;
    land the table as parquet before running more than one query on it.

    All files of a call need the same header, but for case: a task that meets another name at a
    column's place fails. `multi_line="split"` takes files of differing headers, and so does a call
    whose first header has blank or repeated names, which go to it if there are several files.
    """
    if multi_line == "split":
        return read_split_export(spark, path, ordered=ordered, null_tokens=null_tokens, sep=sep)
    options = dict(multiLine=multi_line, quote='"', escape='"', sep=sep, encoding="UTF-8")
    # Spark renames headers that differ only in case; the first row has them as written.
    header = spark.read.csv(path, header=False, **options).first()
    if header is None:
        raise ValueError(f"no header row in {path}")
    names = header_names(header)
    written = list(header)
    checked = None not in written and len({c.lower() for c in written}) == len(written)
    if not checked and len(spark.read.text(path).inputFiles()) > 1:
        return read_split_export(spark, path, ordered=ordered, null_tokens=null_tokens, sep=sep)
    fields = [f"_c{i}" for i in range(len(names))]
    schema = StructType([StructField(f, StringType()) for f in (written if checked else fields)])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=not checked, **options)
    df = df.toDF(*fields)
    order = []
    if ordered:
        df = with_source_order(df)
        order = [F.col(ORDER_COLUMN)]
    return df.select(
        *order,
        *(_blank_to_null(F.col(f), null_tokens).alias(n) for f, n in zip(fields, names)),
    )


def _blank_to_null(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~c.isin(list(tokens)), c) if tokens else c


def read_json_records(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    *,
    ordered: bool = False,
) -> DataFrame:
    """SRC3: JSON-lines records with the union of their keys, scalar values as strings.

    Pass the schema where it is known; without one Spark reads the data once more to find
    the keys.
    """
    reader = spark.read.option("primitivesAsString", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return with_source_order(df) if ordered else df


def union_records(frames: Iterable[DataFrame]) -> DataFrame:
    """SRC3 / SET1: all-string union by column name; columns a frame lacks are null."""
    texts = [
        f.select(*(f[f"`{c}`"].cast("string").alias(c) for c in f.columns)) for f in frames
    ]
    if not texts:
        raise ValueError("no frames to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)
