"""Input order of file sources, needed by every keep-first rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.operators.schema import ORDER_COLUMN


def path_order(path: Column) -> Column:
    """A text that orders files by path, but part files of a folder, which have longer names from the 100,000th on, by number."""
    name = F.substring_index(path, "/", -1)
    folder = F.left(path, F.length(path) - F.length(name))
    numbered = F.concat(folder, F.lpad(F.length(name).cast("string"), 4, "0"), F.lit("/"), name)
    return F.when(name.startswith("part-"), numbered).otherwise(path)


def with_source_order(df: DataFrame, *, row_index: bool = False) -> DataFrame:
    """Add `src_ord`, an orderable struct that follows file path and position in the file.

    Must be applied directly to a file scan. Parquet knows the row's index (`row_index`);
    text formats use the split's start and the position within the split. Both depend only
    on the files and on how they are split, so a retried task yields the same values; store
    the column with the records before splits can change. A table stored with its order keeps
    that one.
    """
    if ORDER_COLUMN in df.columns:
        return df
    if row_index:
        block, position = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        block, position = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    order = F.struct(
        path_order(F.col("_metadata.file_path")).alias("file"),
        block.alias("block"),
        position.cast("bigint").alias("position"),
    )
    return df.select(order.alias(ORDER_COLUMN), *(df[f"`{c}`"] for c in df.columns))
