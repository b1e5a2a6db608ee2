"""The registered queries of the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm import (
    alignment,
    ann,
    bpe,
    exact_dedup,
    lm,
    mixing,
    phrase_index,
    quality,
    secrets,
    simhash,
    substring_dedup,
    warc,
    whitening,
)
from caudal.llm.tables import table


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, at_spaces=True))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secrets.KINDS[:3]],
        F.sha2(secrets.written("spans", only_base=True), 256).alias("base_sha256"),
        secrets.written("spans").alias("spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        (F.size("spans") > 0).alias("removed"),
    )


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, chain).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(table(spark, sf_dir, "documents"))
    return (
        plan.withColumn("taken", F.expr("aggregate(sent, 0L, (a, x) -> a + x)"))
        .orderBy(F.col("virtual_finish")[0], "doc_id")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (vocabulary(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op12_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_hnsw": op4_hnsw,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_quality": op6_line_quality,
    "op7_simhash": op7_simhash,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_lm_score": op10_lm_score,
    "op11_alignment": op11_alignment,
    "op12_phrase_index": op12_phrase_index,
    "op13_whitening": op13_whitening,
}
