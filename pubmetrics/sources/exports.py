"""CSV exports with quoted newlines, read in many tasks and under differing headers (SRC2).

A file is read as lines, split by split. Whether a line starts a record depends on all quotes
before it in its file, so the quotes are first counted per chunk of a split; sums over the chunks, one
row each, then tell every task the state a chunk starts in.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pubmetrics.operators.schema import ORDER_COLUMN
from pubmetrics.sources.ordering import path_order
from pubmetrics.sources.shared import stored

# Distinct headers that one call may read.
MAX_HEADERS = 1000
# Lines of a chunk, as a power of two, 14 at most: a split of 128 MB has few chunks, and a task holds the text of some at a time.
CHUNK_BITS = 14
# Text up to a line end outside quotes; every quantifier is possessive, so a long record takes neither stack nor steps back.
RECORD = r'(?:[^"\n]++|"[^"]*+(?:"|\z))++'


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a header row: trimmed; a blank one by its place, a repeated one numbered.

    Names that differ only in case are different names.
    """
    names: list[str] = []
    for i, cell in enumerate(cells):
        plain = (cell or "").lstrip("﻿").strip() or f"_c{i}"
        name, k = plain, 0
        while name in names:
            k += 1
            name = f"{plain}.{k}"
        names.append(name)
    return names


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, place, line, quotes): lines of the files, each in the split it begins in."""
    lines = spark.read.option("lineSep", "\n").text(list(path) if not isinstance(path, str) else path)
    start = F.col("_metadata.file_block_start")
    place = F.monotonically_increasing_id()
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), start.alias("block"), place.alias("place"), "value"
    )
    # A mark of the byte order is no part of the first cell.
    line = F.when(F.col("block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    lines = lines.select("file", "block", "place", line.alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return lines.withColumn("quotes", quotes)


def chunk_of(place: str) -> Column:
    return F.shiftright(place, CHUNK_BITS)


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, chunk, quotes, inside, head): whether a chunk of a split starts inside quotes, and where its file's header is.

    One pass that reads the lines and shuffles numbers, one row per chunk; the sums over the chunks of a
    file run in one task, on those rows. The header is the first line that is not empty.
    """
    filled = (F.col("block") == 0) & ~F.col("line").isin("", "\r")
    chunks = lines.groupBy("file", "block", chunk_of("place").alias("chunk")).agg(
        F.sum("quotes").alias("quotes"), F.min(F.when(filled, F.col("place"))).alias("first")
    )
    file = Window.partitionBy("file")
    before = file.orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    head = F.min("first").over(file)
    return chunks.select("file", "block", "chunk", "quotes", inside.alias("inside"), head.alias("head"))


def header_lines(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, header): the header row of every file that has one, as text."""
    heads = chunks.filter((F.col("block") == 0) & (F.col("chunk") == chunk_of("head")))
    heads = heads.select("file", F.col("head").alias("place"))
    return lines.filter(F.col("block") == 0).join(heads, ["file", "place"]).select("file", F.col("line").alias("header"))


def whole_records(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, block, place, record and what ``chunks`` has of the file): records of all files, without header rows and empty lines.

    The lines of a chunk come together in the task that reads them, so one row a chunk is shuffled, and its text is then
    cut at the line ends outside quotes. Only what goes on in the next chunk, or comes from the one before, two
    rows a chunk, meets again.
    """
    of_chunk = ("file", "block", "chunk")
    known = [c for c in chunks.columns if c not in (*of_chunk, "quotes", "inside", "head")]
    # Two characters in front of a line say its place in the chunk, and sort by it: far fewer bytes than a number.
    mark = F.concat(*(F.char(F.shiftright("place", shift).bitwiseAND(F.lit(127))) for shift in (7, 0)))
    texts = lines.groupBy("file", "block", chunk_of("place").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.concat(mark, "line"))).alias("lines")
    )
    texts = texts.join(chunks, list(of_chunk))
    # With the quote that opened it before the chunk, a text is cut as one that starts outside.
    text = F.concat(F.when(F.col("inside"), F.lit('"')).otherwise(F.lit("")), F.array_join(F.transform("lines", lambda x: F.substring(x, 3, 2147483647)), "\n"))
    cut = F.filter(F.regexp_extract_all(text, F.lit(RECORD), F.lit(0)), lambda r: r != "\r")
    is_head = (F.col("block") == 0) & (F.col("chunk") == chunk_of("head"))
    goes_on = (F.col("inside").cast("int") + F.col("quotes")) % 2 == 1
    parts = texts.select(*of_chunk, *known, "inside", is_head.alias("is_head"), goes_on.alias("goes_on"), cut.alias("cut"))
    parts = parts.select("*", F.size("cut").alias("n"), F.posexplode("cut").alias("i", "record")).drop("cut")
    parts = parts.filter(~F.col("is_head") | (F.col("i") > 0))
    comes = F.col("inside") & (F.col("i") == 0)
    whole = ~comes & ~(F.col("goes_on") & (F.col("i") == F.col("n") - 1))
    place = (F.shiftleft("chunk", CHUNK_BITS) + F.col("i")).alias("place")
    complete = parts.filter(whole).select("file", "block", *known, place, "record")
    # A chunk's first piece belongs to the last record begun in the chunks before it.
    rest = F.when(comes, F.substring("record", 2, 2147483647)).otherwise(F.col("record"))
    edges = parts.filter(~whole).select("file", "block", *known, place, comes.alias("comes"), rest.alias("record"))
    so_far = Window.partitionBy("file").orderBy("block", "place")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    at = F.max(F.when(~F.col("comes"), F.struct("block", "place"))).over(so_far)
    piece = F.struct("block", "place", "record")
    joined = edges.withColumn("at", at).groupBy("file", "at", *known).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces")
    )
    joined = joined.select(
        "file",
        F.col("at.block").alias("block"),
        *known,
        F.col("at.place").alias("place"),
        F.array_join("pieces.record", "\n").alias("record"),
    )
    records = complete.unionByName(joined)
    ends_at = F.regexp_replace("record", r"\r\z", "")
    return records.withColumn("record", ends_at).filter(F.col("record") != "")


def checked(record: Column, sep: str) -> Column:
    """The record, or an error where a quote stands neither around a whole cell nor doubled inside one.

    With such quotes, lines cannot be joined to records without reading the file in order.
    """
    s = rf"\Q{sep}\E"
    cell = rf'(?<=^|{s})"[^"]*+(?:""[^"]*+)*+"(?={s}|\z)'
    odd = F.regexp_replace(record, cell, "").contains('"')
    message = F.concat(F.lit("a quote inside an unquoted cell; read this file with multi_line=True: "), F.left(record, F.lit(200)))
    return F.when(record.contains('"') & odd, F.raise_error(message).cast("string")).otherwise(record)


def read_split_export(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    ordered: bool = False,
    null_tokens: Sequence[str] = (),
    sep: str = ",",
) -> DataFrame:
    """SRC2: CSV files with quoted newlines, each read by as many tasks as it has splits.

    Every column is a string. Files may have different headers: the columns are those of all
    headers by trimmed name, and a file lacks what its header lacks. A blank header cell is
    named by its place and a repeated one numbered, file by file. Headers are one line.

    The files are read once for the quotes, once for the headers and once more for the records, and their text is
    shuffled in chunks of lines. Quotes must stand around whole cells, doubled inside them, as CSV writers put them:
    a record with any other quote, or one that a file's end leaves open, fails. Lines end in \n or \r\n.
    """
    lines = text_lines(spark, path)
    # One row per chunk is kept, so both uses see the same states.
    chunks = stored(split_states(lines), "export-splits")
    heads = stored(header_lines(lines, chunks), "export-headers")
    known = heads.groupBy("header").agg(F.min("file").alias("file")).orderBy("file")
    known = known.limit(MAX_HEADERS + 1).collect()
    if not known:
        raise ValueError(f"no header row in {path}")
    if len(known) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    headers = []
    for row in known:
        text = row["header"].removesuffix("\r")
        if text.count('"') % 2:
            raise ValueError(f"the header of {row['file']} does not end in its line")
        headers.append(header_names(next(csv.reader([text], delimiter=sep))))
    names = list(dict.fromkeys(n for h in headers for n in h))
    width = max(map(len, headers))

    kinds = [(row["header"], i) for i, row in enumerate(known)]
    kinds = F.broadcast(spark.createDataFrame(kinds, "header string, kind int"))
    pairs = F.col("header").endswith("\r").alias("pairs")
    files = heads.join(kinds, "header").select("file", "kind", pairs)
    # A row per chunk says all that its lines need; files are few beside them.
    records = whole_records(lines, chunks.join(files, "file"))
    # As a reader of whole files does, where lines end in a pair of characters.
    plain = F.replace("record", F.lit("\r\n"), F.lit("\n"))
    records = records.withColumn("record", F.when(F.col("pairs"), plain).otherwise(F.col("record")))
    schema = ", ".join(f"_c{i} string" for i in range(width))
    cells = F.from_csv(checked(F.col("record"), sep), schema, dict(sep=sep, quote='"', escape='"'))
    order = F.struct(
        path_order(F.col("file")).alias("file"), "block", F.col("place").alias("position")
    )
    parsed = records.select("kind", order.alias(ORDER_COLUMN), cells.alias("cells"))
    out = [F.col(ORDER_COLUMN)] if ordered else []
    for name in names:
        places = {}
        for kind, header in enumerate(headers):
            if name in header:
                places.setdefault(header.index(name), []).append(kind)
        value = F.lit(None).cast("string")
        for at, kinds in places.items():
            cell = F.col(f"cells._c{at}")
            value = cell if len(kinds) == len(headers) else F.when(F.col("kind").isin(kinds), cell).otherwise(value)
        out.append((F.when(~value.isin(list(null_tokens)), value) if null_tokens else value).alias(name))
    return parsed.select(*out)
