"""Gold that follows deliveries: partial sums per delivery, added up when read.

A delivery writes its own sums per key as one partition named after it, replacing what
an earlier attempt of the same delivery wrote. Reading adds up all partitions. Sums don't
depend on order, so deliveries may come shuffled, repeated or in pieces, and what they
add is a small table however long the history is. A correction is two signed rows: the
row it takes back with ``signo`` -1, and the new one with 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caudal.functions.values import direction, month_of

SIGN = "signo"
DELIVERY = "entrega"
_BASE = "base"
_FOLDED = "_plegadas"  # a folder that readers of the table pass over

# Gold tables kept by deltas: their keys, and the sums over signed rows.
DAYS = ("fecha", "pais", "segmento", "moneda", "cliente_id")
FLOWS = ("mes", "moneda", "tipo_cuenta")


def signed(rows: DataFrame, taken_back: DataFrame | None = None) -> DataFrame:
    """New rows with sign 1 and, of the same columns, those taken back with sign -1."""
    new = rows.withColumn(SIGN, F.lit(1))
    return new if taken_back is None else new.unionByName(taken_back.select(*rows.columns).withColumn(SIGN, F.lit(-1)))


def day_sums(rows: DataFrame) -> DataFrame:
    """What signed, enriched transactions change in the rows per client and day."""
    return _sums(
        rows.withColumn("fecha", F.to_date("timestamp_tx")),
        DAYS,
        {"n_tx": F.col(SIGN).cast("bigint"), "monto_total": F.col(SIGN) * F.col("monto")},
    )


def flow_sums(rows: DataFrame, inflow: Sequence[str]) -> DataFrame:
    """What signed, enriched transactions change in the monthly flows."""
    way = direction("tipo_tx", inflow)
    amount = F.col(SIGN) * F.col("monto")
    return _sums(
        rows.withColumn("mes", month_of("timestamp_tx")),
        FLOWS,
        {
            "n_tx": F.col(SIGN).cast("bigint"),
            "entradas": F.when(way > 0, amount).otherwise(0),
            "salidas": F.when(way < 0, amount).otherwise(0),
        },
    )


def _sums(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(v).cast("decimal(28,2)" if n != "n_tx" else "bigint").alias(n) for n, v in values.items()])


def store(sums: DataFrame, path: str, delivery: str) -> None:
    """Write a delivery's sums; the same delivery again replaces them, or changes nothing once it is folded."""
    folded = _folded(sums.sparkSession, path)
    if folded is not None and not folded.filter(F.col(DELIVERY) == delivery).isEmpty():
        return
    (
        sums.withColumn(DELIVERY, F.lit(delivery))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DELIVERY)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(DELIVERY, F.col(DELIVERY).cast("string"))


def _folded(spark: SparkSession, path: str) -> DataFrame | None:
    """The deliveries that ``compact`` has added up in the table at ``path``."""
    try:
        return spark.read.schema(f"{DELIVERY} string").parquet(f"{path}/{_FOLDED}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """All deliveries added up; keys whose rows were all taken back are gone.

    While the delivery that a correction takes back is still to come, counts may be
    negative or zero; such keys stay.
    """
    stored = _stored(spark, path)
    values = [c for c in stored.columns if c not in (*keys, DELIVERY)]
    totals = stored.groupBy(*keys).agg(*[F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in values])
    return totals.filter(" or ".join(f"{v} <> 0" for v in values))


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> None:
    """Fold all deliveries of the table at ``path`` into one, in a new table at ``target``.

    The target remembers which deliveries it holds, so one that comes again changes
    nothing there. The old table stays until the caller lets go of it: a run that fails
    half-way leaves it as it was, and the next run overwrites the target.
    """
    names = _stored(spark, path).select(DELIVERY).distinct()
    earlier = _folded(spark, path)
    names = names if earlier is None else names.unionByName(earlier)
    folded = names.filter(F.col(DELIVERY) != _BASE).distinct()
    current(spark, path, keys).withColumn(DELIVERY, F.lit(_BASE)).write.mode("overwrite").partitionBy(DELIVERY).parquet(target)
    folded.write.mode("overwrite").parquet(f"{target}/{_FOLDED}")


def follow(rows: DataFrame, paths: Mapping[str, str], inflow: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep days and flows up with a stream of signed, enriched rows (``paths``: ``days``, ``flows``).

    Each micro-batch is a delivery named by its number, so one that runs again after a
    failure replaces itself in both tables.
    """

    def add(batch: DataFrame, number: int) -> None:
        name = f"lote-{number:09d}"
        store(day_sums(batch), paths["days"], name)
        store(flow_sums(batch, inflow), paths["flows"], name)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
