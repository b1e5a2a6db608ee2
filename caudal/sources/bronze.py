"""Bronze: rows as received, all columns text, plus when, in which delivery and from where.

Stored by ingest date and delivery. The same delivery again replaces itself; another
delivery on the same date is kept beside it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INGESTED_AT = "_ingested_at"
SOURCE_FILE = "_source_file"
SOURCE_MODIFIED = "_source_modified"
SOURCE_SIZE = "_source_size"
INGEST_DATE = "ingest_date"
DELIVERY = "entrega"
_FILE = (SOURCE_FILE, SOURCE_MODIFIED, SOURCE_SIZE)


def source_file() -> Column:
    return F.col("_metadata.file_path")


def to_bronze(
    raw: DataFrame,
    ingested_at: dt.datetime | Column,
    source: Column | None = None,
    delivery: str | None = None,
) -> DataFrame:
    """All source columns as text plus the ingest columns; a delivery is named by its time if by nothing else.

    With a ``source`` of the caller's the file's time and size are unknown (null).
    """
    known = source is None
    stamp = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)
    source = source_file() if source is None else source
    name = F.lit(delivery) if delivery else F.date_format(stamp.cast("timestamp"), "yyyyMMdd'T'HHmmss")
    return raw.select(
        *[F.col(c).cast("string").alias(c) for c in raw.columns],
        stamp.cast("timestamp").alias(INGESTED_AT),
        source.alias(SOURCE_FILE),
        (F.col("_metadata.file_modification_time") if known else F.lit(None)).cast("timestamp").alias(SOURCE_MODIFIED),
        (F.col("_metadata.file_size") if known else F.lit(None)).cast("long").alias(SOURCE_SIZE),
        F.to_date(stamp).alias(INGEST_DATE),
        name.alias(DELIVERY),
    )


def not_yet_stored(bronze: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of files that no other delivery has brought; a row per file is compared.

    A file is the same if its path, modification time and size are. Stored files of
    unknown time or size match none, so theirs are stored once more. A delivery that is
    repeated holds what the raw files hold by then.
    """
    if stored is None:
        return bronze
    files = stored.select(*_FILE, F.col(DELIVERY).alias("_antes")).distinct()
    other = bronze[DELIVERY] != files["_antes"]
    for column in _FILE:
        other &= bronze[column] == files[column]
    return bronze.join(files, other, "left_anti")


def write_bronze(bronze: DataFrame, path: str) -> None:
    """Write by ingest date and delivery; the same delivery again replaces just that."""
    (
        bronze.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(INGEST_DATE, DELIVERY)
        .parquet(path)
    )


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path).withColumn(DELIVERY, F.col(DELIVERY).cast("string"))


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' columns and the delivery of all rows, null in tables written without them."""
    types = ("string", "timestamp", "long", "date", "string")
    schema = ", ".join(f"{c} {t}" for c, t in zip((*_FILE, INGEST_DATE, DELIVERY), types))
    return spark.read.schema(schema).parquet(path)


def payload(bronze: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns as received, without the ingest columns but those to ``keep``."""
    return bronze.drop(*[c for c in (INGESTED_AT, *_FILE, INGEST_DATE, DELIVERY) if c not in keep])
