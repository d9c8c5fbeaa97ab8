"""Registered queries of this package and the SQL they are compared with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pubmetrics.llm import audit, balance, chat, fim, hosts, jaccard, langid, packing, repetition, simhash, toxicity, warc, wavelet
from pubmetrics.llm.store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int):
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


@query
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), toxicity.score(docs["text"], model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op4_repetition_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", repetition.quality(docs["text"]).alias("q")).select("doc_id", "q.*")


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    found = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), langid.predict(docs["text"], model, spark).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_wavelet_tokens(spark, sf_dir):
    folder = wavelet.new_folder(spark)
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    found = wavelet.document_ids(manifest, folder)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_simhash(spark, sf_dir):
    found = stored(simhash.with_neighbours(table(spark, sf_dir, "documents")), "simhash")
    # Every twentieth id asks for the rows within three bits, itself included, and the smallest id among them.
    asks = F.coalesce(F.col("key") % 20 == 0, F.lit(False))
    near = simhash.near_counts(found, found.where(asks), radius=3, blocks=5).withColumnsRenamed({"near": "near_rows", "least": "near_first"})
    asked = found.where(asks).join(near, "fingerprint", "left")
    rest = found.where(~asks).withColumns({c: F.lit(None).cast("long") for c in ("near_rows", "near_first")})
    return asked.unionByName(rest).select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        simhash.as_hex("fingerprint").alias("fingerprint"),
        simhash.as_hex("edited_fingerprint").alias("edited_fingerprint"),
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "near_rows",
        "near_first",
    )


@query
def op8_chat_format(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches):
        here, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if here is None or r["key"] != here["conv_id"] or r["part"] == 0:
                    done += [here] if here else []
                    here = {"conv_id": r["key"], "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
                for role, text in chat.parse(r["formatted"]):
                    here["turns"].update(f"{role}\n{text}\n".encode())
                    here["n_turns"] += 1
                for span in r["loss"]:
                    text = chat.unescape(r["formatted"][span["start"] : span["start"] + span["length"]])
                    here["loss"].update(text.encode())
                    here["loss_chars"] += len(text)
                here["formatted_chars"] += len(r["formatted"])
            if done:
                yield rows(done)
                done = []
        if here:
            yield rows([here])

    def rows(found):
        plain = [{**r, "turns_sha256": r["turns"].hexdigest(), "loss_sha256": r["loss"].hexdigest()} for r in found]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in plain])

    return chat.format_chats(turns).mapInArrow(digest, schema)


@query
def op5_source_mix(spark, sf_dir):
    mixed = balance.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op6_warc(spark, sf_dir):
    folder = warc.new_folder(spark)
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    found = warc.read(spark, folder, payloads=False).where("reason IS NULL")
    return found.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op9_jaccard_join(spark, sf_dir):
    found = jaccard.join(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


#: Host, path and verdict of each rule.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op11_link_graph(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = hosts.judge(table(spark, sf_dir, "pages"), rules)
    return found.withColumnRenamed("key", "page_id")


@query
def op12_fill_in_middle(spark, sf_dir):
    found = fim.restored(fim.outputs(table(spark, sf_dir, "documents")))
    return found.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLES["op12_fill_in_middle"] = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
numbers AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM texts
),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cuts
"""


@query
def op13_filter_audit(spark, sf_dir):
    rows = audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(rows, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


ORACLES["op13_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL
),
letters AS (SELECT substring('ABCDE', i, 1) AS f, CAST(power(2, i - 1) AS INTEGER) AS bit FROM range(1, 6) r(i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, l.f, l.bit,
    CAST(coalesce((SELECT sum(x.bit) FROM letters x WHERE contains(substring(filter_order, 1, k - 1), x.f)), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) r(k), letters l
  WHERE substring(filter_order, k, 1) = l.f
),
found AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""
