"""Fraud signals and the score per client."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.joins import salted_lookup
from caudal.operators.prefix import earlier_totals
from caudal.operators.windows import trailing_totals, with_previous

_DAY = 86_400


@dataclass(frozen=True)
class Weights:
    """Share of each signal in the score."""

    amount: float = 0.4
    geo: float = 0.3
    velocity: float = 0.3


def _per_client(currency: str | None) -> list[str]:
    """Amounts of different currencies are never compared or added."""
    return ["cliente_id", currency] if currency else ["cliente_id"]


def _usual(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and number of a client's amounts, aggregated map-side first."""
    amount = F.col("monto").cast("double")
    return tx.groupBy(*keys).agg(
        F.avg(amount).alias("_media"),
        F.stddev_samp(amount).alias("_desv"),
        F.count(F.lit(1)).alias("_filas"),
    )


def _deviations(rows: DataFrame, usual: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with ``z``; clients with a single transaction or equal amounts have none.

    Joined back with the hot clients salted: a window over the client would put each
    client's whole history into one task.
    """
    z = (F.col("monto").cast("double") - F.col("_media")) / F.col("_desv")
    varied = usual.filter(F.col("_desv") > 0)
    return salted_lookup(rows, varied, keys, "_filas", spread).withColumn("z", z).drop("_media", "_desv")


def unusual_amounts(
    tx: DataFrame, threshold: float = 3.0, currency: str | None = None
) -> DataFrame:
    """Transactions whose amount lies more than ``threshold`` deviations above the client's mean."""
    keys = _per_client(currency)
    return _deviations(tx, _usual(tx, keys), keys, ["transaccion_id"]).filter(F.col("z") > F.lit(threshold))


def unusual_amounts_before(
    tx: DataFrame, threshold: float = 3.0, currency: str | None = None, at_least: int = 10
) -> DataFrame:
    """Transactions more than ``threshold`` deviations above the mean of the client's earlier ones.

    Only what happened strictly before a transaction judges it, so a verdict never
    changes when later rows come. At least ``at_least`` earlier amounts are needed.
    Counts, sums and sums of squares are whole numbers of the smallest unit, so the
    deviation is taken without cancellation whatever the size of the amounts.
    """
    keys = _per_client(currency)
    scale = tx.schema["monto"].dataType.scale
    units = (F.col("monto") * F.lit(10**scale)).cast("decimal(18,0)")
    totals = {
        "_previas": F.count("monto"),
        "_suma": F.coalesce(F.sum(units), F.lit(0)).cast("decimal(38,0)"),
        "_cuadrados": F.coalesce(F.sum(units * units), F.lit(0)).cast("decimal(38,0)"),
    }
    earlier = earlier_totals(tx, keys, "timestamp_tx", totals).filter(F.col("_previas") >= max(at_least, 2))
    n = F.col("_previas")
    spread = n.cast("decimal(12,0)") * F.col("_cuadrados") - F.col("_suma") * F.col("_suma")
    deviation = F.sqrt(spread.cast("double") / (n * (n - 1)))
    z = (units.cast("double") - F.col("_suma").cast("double") / n) / F.nullif(deviation, F.lit(0.0))
    judged = tx.filter(F.col("monto").isNotNull()).join(earlier, [*keys, "timestamp_tx"])
    return judged.withColumn("z", z).filter(F.col("z") > F.lit(threshold)).select(
        "transaccion_id", *keys, "timestamp_tx", "monto", n.alias("n_previas"), "z"
    )


def bursts(
    tx: DataFrame, seconds: int = 3600, at_least: int = 2, currency: str | None = None
) -> DataFrame:
    """Instants with at least two transactions in the trailing hour, and their sum."""
    totals = trailing_totals(tx, _per_client(currency), "timestamp_tx", "monto", seconds)
    return totals.filter(F.col("n_ventana") >= at_least)


def _frequency(tx: DataFrame, seconds: int) -> DataFrame:
    """Transactions in the trailing hour, whatever their currency; no sum of amounts."""
    return trailing_totals(tx, ["cliente_id"], "timestamp_tx", None, seconds)


def fast_sequences(tx: DataFrame, seconds: int = 3600, at_least: int = 3) -> DataFrame:
    """Instants whose trailing hour holds at least ``at_least`` transactions."""
    return _frequency(tx, seconds).filter(F.col("n_ventana") >= at_least)


def transactions_at(tx: DataFrame, flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The transactions behind flagged instants, one row each, with the instants' columns.

    ``flagged`` has one row per ``keys``; both sides are shuffles of their own, so
    adaptive execution splits an instant with very many transactions.
    """
    return tx.join(flagged.drop("n_tx"), list(keys))


def burst_transactions(tx: DataFrame, currency: str | None = None, **limits) -> DataFrame:
    keys = [*_per_client(currency), "timestamp_tx"]
    return transactions_at(tx, bursts(tx, currency=currency, **limits), keys)


def fast_transactions(tx: DataFrame, **limits) -> DataFrame:
    return transactions_at(tx, fast_sequences(tx, **limits), ["cliente_id", "timestamp_tx"])


def travel_transactions(tx: DataFrame, **limits) -> DataFrame:
    return transactions_at(tx, impossible_travel(tx, **limits), ["cuenta_id", "timestamp_tx", "pais_tx"])


def foreign_share(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """Per client: transactions, those outside the client's country, and their share.

    ``tx`` needs cuenta_id and pais_tx, ``owners`` one row per account with
    cliente_id and pais. Counted per account and country before the join.
    """
    per_account = tx.groupBy("cuenta_id", "pais_tx").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_account.join(owners.select("cuenta_id", "cliente_id", "pais"), "cuenta_id")
        .groupBy("cliente_id")
        .agg(
            F.sum("_n").alias("n_tx"),
            F.sum(F.when(F.col("pais_tx") != F.col("pais"), F.col("_n")).otherwise(0)).alias("n_fuera"),
        )
        .withColumn("proporcion_fuera", F.round(F.col("n_fuera") / F.col("n_tx"), 4))
    )


def foreign_share_of_enriched(tx: DataFrame) -> DataFrame:
    """``foreign_share`` of rows that carry their client's country: no join."""
    return (
        tx.groupBy("cliente_id")
        .agg(F.count(F.lit(1)).alias("n_tx"), F.count_if(F.col("pais_tx") != F.col("pais")).alias("n_fuera"))
        .withColumn("proporcion_fuera", F.round(F.col("n_fuera") / F.col("n_tx"), 4))
    )


def impossible_travel(tx: DataFrame, within_seconds: int = _DAY) -> DataFrame:
    """An account seen in another country than in its transaction before, too soon after.

    Rows of one account, instant and country are one point (several transactions
    at one instant are taken by country name), so a window group holds the distinct
    instants and countries of one account and week.
    """
    points = tx.groupBy("cuenta_id", "timestamp_tx", "pais_tx").agg(F.count(F.lit(1)).alias("n_tx"))
    seen = with_previous(
        points,
        "cuenta_id",
        "timestamp_tx",
        order=["timestamp_tx", "pais_tx"],
        carry=["timestamp_tx", "pais_tx"],
        within_seconds=within_seconds,
    )
    return seen.filter(F.col("pais_tx") != F.col("pais_tx_previo"))


def amount_rate(
    tx: DataFrame, threshold: float = 3.0, currency: str | None = None
) -> DataFrame:
    """Share of a client's transactions that ``unusual_amounts`` flags.

    The same mean and deviation, joined with the client's distinct amounts and their
    counts.
    """
    keys = _per_client(currency)
    usual = _usual(tx, keys)
    amounts = tx.groupBy(*keys, "monto").agg(F.count(F.lit(1)).alias("_n"))
    unusual = (
        _deviations(amounts, usual, keys, ["monto"])
        .filter(F.col("z") > F.lit(threshold))
        .groupBy("cliente_id")
        .agg(F.sum("_n").alias("_raros"))
    )
    every = usual.groupBy("cliente_id").agg(F.sum("_filas").alias("_todos"))
    return every.join(unusual, "cliente_id", "left").select(
        "cliente_id", (F.coalesce("_raros", F.lit(0)) / F.col("_todos")).alias("tasa_monto")
    )


def velocity_rate(tx: DataFrame, seconds: int = 3600, at_least: int = 3) -> DataFrame:
    """Flagged and own transactions come out of the same window result: no join back."""
    fast = F.when(F.col("n_ventana") >= at_least, F.col("n_tx")).otherwise(0)
    return (
        _frequency(tx, seconds)
        .groupBy("cliente_id")
        .agg((F.sum(fast) / F.sum("n_tx")).alias("tasa_frecuencia"))
    )


def score(
    clientes: DataFrame,
    amounts: DataFrame,
    geo: DataFrame,
    velocity: DataFrame,
    weights: Weights = Weights(),
) -> DataFrame:
    """Weighted signals per client; a client without a signal gets 0 for it.

    All frames hold one row per client.
    """
    def signal(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    rate_geo = geo.select("cliente_id", (F.col("n_fuera") / F.col("n_tx")).alias("tasa_geo"))
    joined = (
        clientes.select("cliente_id")
        .join(amounts, "cliente_id", "left")
        .join(rate_geo, "cliente_id", "left")
        .join(velocity, "cliente_id", "left")
    )
    total = (
        F.lit(weights.amount) * signal("tasa_monto")
        + F.lit(weights.geo) * signal("tasa_geo")
        + F.lit(weights.velocity) * signal("tasa_frecuencia")
    )
    return joined.select(
        "cliente_id",
        F.round(signal("tasa_monto"), 4).alias("tasa_monto"),
        F.round(signal("tasa_geo"), 4).alias("tasa_geo"),
        F.round(signal("tasa_frecuencia"), 4).alias("tasa_frecuencia"),
        F.round(total, 4).alias("score"),
    )


def top_clients(scored: DataFrame, n: int = 20) -> DataFrame:
    """The report of the n highest scores; ties go to the lower client id."""
    return scored.orderBy(F.col("score").desc(), F.col("cliente_id")).limit(n)
