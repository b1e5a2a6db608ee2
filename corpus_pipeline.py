"""A training corpus from ``documents``: quality, exact copies, near copies, mix, tokens.

Each stage takes all rows its predecessor kept, each stage's rows are a written table.
Rows travel as structs beside the columns that a stage computes, so a table may have
columns of any name. Ids may be null or repeat: where a stage has to find its rows
again, it does so by id and digest of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm import bpe, exact_dedup, mixing, quality, simhash
from caudal.llm.registered import vocabulary
from caudal.llm.tables import kept, table, whole_text

# The classifier and the components of near copies are no SQL.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """``row``, ``text`` and a key of id and text."""
    key = F.struct("doc_id", F.sha2(whole_text().cast("binary"), 256).alias("text_sha256"))
    return docs.select(F.struct("*").alias("row"), key.alias("doc_id"), "text")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a score below 0.7 go."""
    chain = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("doc_id"), "text")
    return quality.score(rows, chain).filter(F.col("score") >= quality.KEEP).select("doc_id.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the smallest id stays, once."""
    rows = _keyed(docs)
    stay = exact_dedup.duplicates(rows).filter("kept").select("doc_id")
    return rows.select("row", "doc_id").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, three words and two bits: of each group of linked texts the row with the smallest id stays."""
    rows = _keyed(docs)
    marked = simhash.near_duplicates(rows)
    stay = marked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    return rows.select("row", "doc_id").join(stay, "doc_id", "left_semi").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sources come near their targets; a row may be left out or come twice."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids of every row of the mix, and digests that show the round trip."""
    ranks = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, at_spaces=True)
    return made.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
