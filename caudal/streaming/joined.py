"""Streams that look around themselves: the trailing hour, and accounts that come late.

Both are stream-stream joins over a bounded stretch of time, with a watermark on either
side: what can no longer match leaves the state. Rows come out once, when nothing that
may still arrive can change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.streaming.transactions import LATENESS, event_time


def trailing_hour(
    tx: DataFrame, key: str = "cliente_id", ts: str = "timestamp_tx", seconds: int = 3600, lateness: str = LATENESS
) -> DataFrame:
    """Per key and instant: ``n_tx`` there and ``n_ventana`` in [ts - seconds, ts], once the instant is closed.

    The batch form's result to the microsecond, unlike windows of fixed hours. Rows are
    counted per instant first, so an instant with a million rows is one row in the join;
    each instant then meets those of its key in the interval before it, and their counts
    are added up in a chained aggregate. State: the instants of a stretch of ``lateness``
    plus ``seconds``. Rows later than ``lateness`` leave the stream; rows without key or
    instant are left out.
    """
    timed = event_time(tx.dropna(subset=[key, ts]), ts, lateness)
    instants = timed.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n_tx"))
    now = instants.alias("ahora")
    past = instants.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col("n_tx").alias("_n")).alias("antes")
    within = F.expr(f"_k = ahora.{key} AND _t <= ahora.{ts} AND _t >= ahora.{ts} - INTERVAL {int(seconds)} SECONDS")
    return (
        now.join(past, within)
        .groupBy(F.col(f"ahora.{key}").alias(key), F.col(f"ahora.{ts}").alias(ts), F.col("ahora.n_tx").alias("n_tx"))
        .agg(F.sum("_n").alias("n_ventana"))
    )


def with_late_accounts(
    tx: DataFrame,
    cuentas: DataFrame,
    key: str = "cuenta_id",
    arrived: str = "recibida",
    wait: str = "1 hour",
    before: str = "1 hour",
    lateness: str = "0 seconds",
) -> DataFrame:
    """Each transaction with its account, if that arrives at most ``before`` earlier or ``wait`` later.

    Transactions whose account does not come in that time leave with null account columns
    and ``huerfana`` true, once ``wait`` and ``lateness`` have passed on both streams; none
    is lost or doubled. ``arrived`` is the time of arrival on both sides. Deliveries repeat
    accounts: within the time that a transaction can see, the first one counts. Accounts
    that came earlier are silver's, joined before this. Transactions need a key and a
    time; those without are for the quarantine.
    """
    spread = f"INTERVAL {before} + INTERVAL {wait}"
    seconds = int(tx.sparkSession.sql(f"select unix_timestamp(timestamp'1970-01-01' + {spread}) as s").first()["s"])
    sent = event_time(tx.dropna(subset=[key, arrived]), arrived, lateness).alias("tx")
    # Copies of an account within the stretch one transaction can see are one.
    first = event_time(cuentas.dropna(subset=[key, arrived]), arrived, f"{seconds} seconds")
    first = first.dropDuplicatesWithinWatermark([key]).withColumnsRenamed({key: "_k", arrived: "_t"})
    near = F.expr(
        f"_k = tx.{key} AND _t >= tx.{arrived} - INTERVAL {before} AND _t <= tx.{arrived} + INTERVAL {wait}"
    )
    joined = sent.join(first, near, "left_outer")
    return joined.withColumn("huerfana", F.col("_k").isNull()).drop("_k", "_t")
