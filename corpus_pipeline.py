"""Corpus pipeline: quality rules, toxicity, near duplicates, source mix, packing; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pubmetrics.llm import balance, jaccard, packing, repetition, toxicity
from pubmetrics.llm.queries import fold, table, tokenizer_path
from pubmetrics.llm.store import stored

#: The last stages' rows depend on tokenizers and fitted weights, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; a null text has no words and goes."""
    return docs.where(repetition.quality(docs["text"])["kept"])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7, by a model of the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return docs.where(toxicity.score(docs["text"], model, spark) < 0.7)


def unused(name: str, columns: list[str]) -> str:
    """The name with as many marks after it as it takes to be no column yet."""
    while name in (c.lower() for c in columns):
        name += "_"
    return name


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five words, 0.8) the one with the smallest id and text, once.

    Ids need not be unique: rows are told apart by their texts, and of rows with one id and text the first by their other
    columns stays. Null ids come last; documents without words stay.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    same, order, group = (unused(f"_{n}", docs.columns) for n in ("same", "order", "group"))
    marked = docs.withColumn(same, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = jaccard.groups(marked.select("doc_id", "text", same), carry=[same]).where("n > 0 AND key <=> component")
    first = found.select(F.col("key").alias("_id"), F.col(same).alias("_first"), F.col("group").alias(group)).distinct()
    here = marked.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col(same).alias("_same"))
    here = here.join(first, here["_doc"].eqNullSafe(first["_id"]) & (here["_same"] == first["_first"]))
    # The least row of a group is combined within tasks; other columns are compared as text, as not all types have an order.
    by = F.struct(F.col("_row.text"), F.to_json(F.struct(*(F.col(f"_row.`{c}`") for c in rest))) if rest else F.lit("")).alias(order)
    one = here.groupBy(group).agg(F.min_by("_row", by).alias("_one"))
    wordless = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return one.select(*(F.col(f"_one.`{c}`") for c in docs.columns)).unionByName(wordless)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the source mix takes; those it takes none of go."""
    row, taken, copy = (unused(f"_{n}", docs.columns) for n in ("row", "taken", "copy"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixture-rows")
    mixed = balance.mix(rows.select("doc_id", "text", "source", row), carry=[row]).where("copies > 0")
    repeated = rows.join(mixed.select(row, F.col("copies").alias(taken)), row)
    repeated = repeated.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), taken)))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 tokens, with their ids (u32, little-endian)."""
    # Executors still hold what the stages before took.
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), kept=1 << 25)
    return pieces.withColumnRenamed("key", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
