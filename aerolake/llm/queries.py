"""One query per operator, over whole tables with production parameters, in the columns the contract names."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import bpe, bytebpe, chat, decontaminate, licenses, lines, minhash, ngram, oracles, periodic, pii, prefixes, quality, warc
from aerolake.session import cut, ship_code


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_report(_read(spark, folder, "documents"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, folder, "documents"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.score_documents(_read(spark, folder, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_read(spark, folder, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *[F.col(f"q_{m}").alias(m) for m in quality.MEASURES], F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The whole texts after deletion, and how many lines went."""
    return lines.drop_repeats(_read(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("x_removed", "n_removed")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.archive_folder(spark)
    index = warc.write_archives(_read(spark, folder, "pages"), archives)
    return warc.read_records(index, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_read(spark, folder, "documents").select("doc_id", "text"), vocabulary(), with_ids=False)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_read(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(F.array_remove(F.transform("p_spans", lambda s: F.when(s["kind"] == kind, 1).otherwise(0)), 0)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.filter("p_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("p_spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.scan_documents(docs, _read(spark, folder, "benchmark"))
    return found.select("doc_id", F.col("d_n_words").alias("n_words"), F.col("d_n_hit").alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("d_items", ","), 256).alias("items_sha256"), (F.col("d_n_hit") > 0).alias("contaminated"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.format_chats(given.unionByName(probe)).withColumn("parsed", chat.parse_chat(F.col("c_text"))).withColumn("learnt", chat.learnt_text(F.col("c_segments")))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), F.length("c_text").cast("long").alias("formatted_chars"))


def rank_file() -> tuple[str, str]:
    """The byte-level rank file and the pattern that splits text before it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bytebpe.encode(_read(spark, folder, "documents").select("doc_id", "text"), *rank_file(), with_ids=False)


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of the rebuilt texts: from some word on, the text repeats a stretch of itself (a text without doc_id stays)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.collapse(_read(spark, folder, "documents").select("doc_id", "text"), arrange=repeated_words)
    rows = F.array_join(F.transform("p_runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = [F.col(f"p_best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor((F.col("p_best.length") * 1000 - F.col("p_best.length") * 1000 % F.col("p_best.period")) / F.col("p_best.period"))
    return found.select("doc_id", F.size("p_runs").cast("long").alias("n_runs"), *best, exponent.cast("long").alias("exponent_milli"),
                        F.sha2(rows, 256).alias("runs_sha256"), F.sha2("p_text", 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    given = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    members = cut(given.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    turns = cut(prefixes.turn_hashes(given))
    return prefixes.prefix_trie(*prefixes.rooted(members, turns, 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6), order=["part", "pos"])


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_near_duplicates, op3_lm_score, op4_quality_rules, op5_line_dedup, op6_warc, op7_bpe, op8_pii,
                                   op9_decontamination, op10_chat_format, op11_byte_bpe, op12_periodic_runs, op13_prefix_trie, pipeline)}
ORACLES = {"op4_quality_rules": oracles.QUALITY, "op9_decontamination": oracles.LEAKS, "op10_chat_format": oracles.CHATS, "op13_prefix_trie": oracles.TRIE}
