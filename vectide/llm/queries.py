"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe, chat, decontaminate, html, langid, licenses, pii, quality, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.adjacent_pairs(_table(spark, sf_dir, "conversations")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_langid": op2_langid,
        "op3_html": op3_html,
        "op4_decontaminate": op4_decontaminate,
        "op5_preferences": op5_preferences,
        "op6_warc": op6_warc,
        "op7_quality": op7_quality,
        "op8_bpe": op8_bpe,
        "op9_pii": op9_pii,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": decontaminate.SQL, "op5_preferences": chat.SQL, "op6_warc": warc.SQL, "op7_quality": quality.SQL}
