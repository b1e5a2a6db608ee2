"""Streaming forms: new raw files to bronze, de-duplication, hourly frequency.

State grows with the keys seen inside the watermark, never with history. Late rows
beyond the watermark leave the stream; bronze still holds them, and the batch
forms count them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caudal.session import shared_dir
from caudal.sources.bronze import DELIVERY, to_bronze, write_bronze
from caudal.sources.raw import OPTIONS, with_corrupt

LATENESS = "1 hour"  # the default; every form takes its own


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A stream's progress folder under the cluster's shared checkpoint folder."""
    base = shared_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base.rstrip('/')}/{name}"


def new_files(
    spark: SparkSession, raw_dir: str, schema: T.StructType, files_per_trigger: int = 1000, kind: str = "csv"
) -> DataFrame:
    """Rows of CSV or JSON files as they arrive in a folder; each file is read once.

    The batch reader's options: the same file gives the same rows, lines that can't be
    split included.
    """
    return (
        spark.readStream.schema(with_corrupt(schema))
        .options(**OPTIONS[kind])
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(kind)
        .load(raw_dir)
    )


def stream_to_bronze(rows: DataFrame, bronze_dir: str, checkpoint: str) -> StreamingQuery:
    """Store everything that has arrived and stop; the next run goes on from there.

    Every micro-batch is a delivery of its own, written as the batch form writes it: a
    batch that runs again replaces itself, and both may share a folder.
    """
    stamped = to_bronze(rows, F.current_timestamp())

    def store(batch: DataFrame, number: int) -> None:
        write_bronze(batch.withColumn(DELIVERY, F.lit(f"lote-{number:09d}")), bronze_dir)

    return (
        stamped.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_time(tx: DataFrame, ts: str = "timestamp_tx", lateness: str = LATENESS) -> DataFrame:
    """A watermark needs TIMESTAMP; zone-free values are taken as UTC.

    Rows later than ``lateness`` behind the newest leave the stream, so that its state
    stays bounded. They are in bronze, and the batch forms count them.
    """
    return tx.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def dedup_stream(
    tx: DataFrame, key: str = "transaccion_id", ts: str = "timestamp_tx", spread: int = 0, lateness: str = LATENESS
) -> DataFrame:
    """First row of each transaction id seen within the watermark.

    With ``spread`` copies of one id are first reduced in that many groups of input
    splits, so that an id sent a million times does not land in one task whole. It
    costs a second state and pays off only for such sources.
    """
    timed = event_time(tx, ts, lateness)
    if spread:
        timed = (
            timed.withColumn("_split", F.pmod(F.spark_partition_id(), F.lit(spread)))
            .dropDuplicatesWithinWatermark([key, "_split"])
            .drop("_split")
        )
    return timed.dropDuplicatesWithinWatermark([key])


def hourly_frequency(
    tx: DataFrame, key: str = "cuenta_id", ts: str = "timestamp_tx", lateness: str = LATENESS
) -> DataFrame:
    """Transactions per key and hour, emitted once the hour is closed."""
    return (
        event_time(tx, ts, lateness)
        .groupBy(F.window(ts, "1 hour").alias("_w"), key)
        .agg(F.count(F.lit(1)).alias("n_tx"))
        .select(key, F.col("_w.start").alias("hora"), "n_tx")
    )


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
