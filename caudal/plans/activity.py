"""Daily activity, retention, dormant accounts, churn, segmentation, finance.

``as_of`` is a date or timestamp literal; without it the newest transaction counts
as today. Rows after it are ignored.

Metrics per client take transactions or, in their place, rows per client and day
(``as_movements``): those are what a large pipeline reads again and again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal import domain
from caudal.functions.values import direction, month_of
from caudal.operators import sketches
from caudal.operators.quantiles import QUARTILES, band, exact_quantiles

AsOf = dt.date | dt.datetime | None


def cut_off(tx: DataFrame, as_of: AsOf) -> Column:
    """The reference instant: end of the given day, the given instant, or the newest row."""
    if as_of is None:
        return tx.agg(F.max("timestamp_tx")).scalar()
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of).cast("timestamp_ntz")
    return F.lit(dt.datetime.combine(as_of, dt.time.max)).cast("timestamp_ntz")


def _today(last: DataFrame, as_of: AsOf) -> Column:
    """The reference instant, where it is not given from the maxima per key (``_ultimo``)."""
    return last.agg(F.max("_ultimo")).scalar() if as_of is None else cut_off(last, as_of)


def until(tx: DataFrame, as_of: AsOf) -> DataFrame:
    """Rows up to ``as_of``; without one all rows count and no filter is needed."""
    return tx if as_of is None else tx.filter(F.col("timestamp_tx") <= cut_off(tx, as_of))


def movements(tx: DataFrame) -> Column:
    """How many transactions a group of rows stands for."""
    return F.sum("n_tx") if "n_tx" in tx.columns else F.count(F.lit(1))


def as_movements(days: DataFrame) -> DataFrame:
    """Rows per client and day in the shape of transactions, with their number ``n_tx``."""
    return days.select(
        "cliente_id",
        F.col("fecha").cast("timestamp_ntz").alias("timestamp_tx"),
        F.col("monto_total").alias("monto"),
        "n_tx",
        *[c for c in ("moneda",) if c in days.columns],
    )


# --- daily transactions -----------------------------------------------------

def daily_by_client(
    tx: DataFrame, clientes: DataFrame, extra: Sequence[str] = ()
) -> DataFrame:
    """Per day and client, with the client's country and segment.

    Aggregated before clients are joined, so a hot client arrives at the join as
    one row per day.
    """
    days = _per_day(tx, ["cliente_id"], extra)
    return days.join(clientes.select("cliente_id", "pais", "segmento"), "cliente_id").select(
        "fecha", "pais", "segmento", *extra, "cliente_id", "n_tx", "monto_total"
    )


def _per_day(tx: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    return tx.groupBy(*keys, F.to_date("timestamp_tx").alias("fecha"), *extra).agg(
        F.count(F.lit(1)).alias("n_tx"), F.sum("monto").alias("monto_total")
    )


def daily_of_enriched(tx: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``daily_by_client`` of rows that carry their client's country and segment: no join."""
    return _per_day(tx, ["cliente_id", "pais", "segmento"], extra).select(
        "fecha", "pais", "segmento", *extra, "cliente_id", "n_tx", "monto_total"
    )


def summarise_days(by_client: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per day, country and segment, from rows per client and day.

    A client has one row per day (and ``extra``), so counting rows counts distinct
    clients and no distinct aggregate is needed.
    """
    return by_client.groupBy("fecha", "pais", "segmento", *extra).agg(
        F.sum("n_tx").alias("n_tx"),
        F.count(F.lit(1)).alias("n_clientes"),
        F.sum("monto_total").alias("monto_total"),
    )


def daily(tx: DataFrame, clientes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per day, country and segment: transactions, distinct clients, amount.

    Pass ``("moneda",)`` where amounts have a currency: currencies are never added up.
    """
    return summarise_days(daily_by_client(tx, clientes, extra), extra)


def client_sketches(tx: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct clients per day, country and segment as sketches, from rows that carry both."""
    day = F.to_date("timestamp_tx").alias("fecha")
    return sketches.distinct_sketches(tx, [day, "pais", "segmento", *extra], "cliente_id")


def monthly_clients(daily: DataFrame, by: Sequence[str] = ("pais",)) -> DataFrame:
    """Distinct clients per month (and ``by``) from the sketches per day."""
    months = sketches.united(daily, [month_of("fecha").alias("mes"), *by])
    return months.select("mes", *by, sketches.n_distinct().alias("n_clientes"))


def retained_clients(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per month: distinct clients, and those active again in the next, from the sketches per day alone.

    The last month has no successor and is dropped; a month whose next one is empty
    keeps no client.
    """
    months = sketches.united(daily, [month_of("fecha").alias("mes"), *by])
    following = months.select(
        F.add_months("mes", -1).alias("mes"), *by, F.col("distintos").alias("_despues")
    )
    again = F.coalesce(sketches.n_common("distintos", "_despues"), F.lit(0))
    return (
        months.join(following, ["mes", *by], "left")
        .filter(F.col("mes") < months.agg(F.max("mes")).scalar())
        .select("mes", *by, sketches.n_distinct().alias("n_clientes"), again.alias("n_retenidos"))
    )


def activity_rollup(by_client: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Transactions, distinct clients and amount per month, country and segment, with all subtotals.

    From rows per client and day, summed per client and month before ``rollup`` repeats
    them. A client has one country and one segment, so within a month rows are clients;
    in the grand total a client counts in its first month only. No distinct aggregate and
    one pass over the facts. ``nivel`` is the grouping id. ``extra`` (a currency) is kept
    apart at every level: its amounts are never added up, and clients count per value.
    """
    monthly = by_client.groupBy(month_of("fecha").alias("mes"), "cliente_id", "pais", "segmento", *extra).agg(
        F.sum("n_tx").alias("n_tx"), F.sum("monto_total").alias("monto")
    )
    first = F.min("mes").over(Window.partitionBy("cliente_id", *extra))  # a client's months
    counted = monthly.withColumn("_primero", (F.col("mes") == first).cast("bigint"))
    levels = ["mes", "pais", "segmento"]
    sets = [[*extra, *levels[:n]] for n in range(len(levels), -1, -1)]
    sums = counted.groupingSets([[F.col(c) for c in one] for one in sets], *extra, *levels).agg(
        F.grouping_id().cast("bigint").alias("nivel"),
        F.sum("n_tx").alias("n_tx"),
        F.count(F.lit(1)).alias("_filas"),
        F.sum("_primero").alias("_clientes"),
        F.sum("monto").alias("monto"),
    )
    clients = F.when(F.col("nivel") == 7, F.col("_clientes")).otherwise(F.col("_filas"))
    return sums.select("nivel", *extra, *levels, "n_tx", clients.alias("n_clientes"), "monto")


def amount_quartiles(monthly: DataFrame, parts: DataFrame) -> DataFrame:
    """Quartiles of the clients' monthly amounts per year, ``anio, q1, q2, q3``.

    ``monthly`` has rows per client and month (``mes, monto``), ``parts`` the stored
    quantile sketch of each month: merged into years they bracket the quartiles, so the
    year needs no sketch pass, and the cuts are exact.
    """
    rows = monthly.withColumn("anio", F.year("mes"))
    years = sketches.merged(parts.withColumn("anio", F.year("mes")), ["anio"])
    cuts = exact_quantiles(rows, ["anio"], "monto", QUARTILES, sketched=years)
    return cuts.select("anio", *[F.col("cuts")[i].alias(f"q{i + 1}") for i in range(3)])


# --- retention --------------------------------------------------------------

def retention_by_volume(tx: DataFrame, currency: str | None = None) -> DataFrame:
    """Per month and volume band: active clients and those active again next month.

    Bands 1-4 are cut at the quartiles of the clients' monthly amounts, within each
    currency where one is named; clients of equal amount share a band. A client is
    active again whatever the currency. The last month has no successor and is
    dropped.
    """
    money = [currency] if currency else []
    month = month_of("timestamp_tx")
    # The filter the joins on month would add anyway: with it all three uses of the
    # monthly sums are the same plan, and Spark shuffles them once.
    monthly = (
        tx.filter(month.isNotNull())
        .groupBy("cliente_id", month.alias("mes"), *money)
        .agg(F.sum("monto").alias("monto"))
    )
    cuts = exact_quantiles(monthly, ["mes", *money], "monto", QUARTILES)
    # A client has a row per month and currency: the calendar bounds this window.
    number = F.year("mes") * 12 + F.month("mes")
    following = Window.partitionBy("cliente_id").orderBy(number).rangeBetween(1, 1)
    last_month = monthly.agg(F.max("mes")).scalar()
    return (
        monthly.withColumn("_sigue", (F.count(F.lit(1)).over(following) > 0).cast("bigint"))
        # One row per calendar month and currency.
        .join(F.broadcast(cuts), ["mes", *money])
        .groupBy("mes", *money, band(F.col("monto"), F.col("cuts")).alias("banda"))
        .agg(
            F.count(F.lit(1)).alias("n_clientes"),
            F.sum("_sigue").alias("n_retenidos"),
            F.max("mes").alias("_mes"),
        )
        # On an aggregate, so that it is not pushed into just one of the three uses.
        .filter(F.col("_mes") < last_month)
        .drop("_mes")
        .withColumn("tasa", F.round(F.col("n_retenidos") / F.col("n_clientes"), 4))
    )


# --- dormant accounts, churn ------------------------------------------------

def dormant_accounts(
    cuentas: DataFrame,
    tx: DataFrame,
    days: int = 30,
    as_of: AsOf = None,
    states: Sequence[str] = (),
) -> DataFrame:
    """Accounts without movement for ``days`` or more, or without any at all."""
    # The join would add the filter to just one of the two uses of the maxima.
    moved = until(tx, as_of).filter(F.col("cuenta_id").isNotNull())
    last = moved.groupBy("cuenta_id").agg(F.max("timestamp_tx").alias("_ultimo"))
    accounts = cuentas.filter(F.col("estado").isin(*states)) if states else cuentas
    idle = F.datediff(F.to_date(_today(last, as_of)), F.to_date("_ultimo"))
    return (
        accounts.select("cuenta_id", "cliente_id", "estado")
        .join(last, "cuenta_id", "left")
        .withColumn("dias", idle.cast("bigint"))
        .withColumn("nunca", F.col("_ultimo").isNull())
        .filter(F.col("nunca") | (F.col("dias") >= days))
        .select(
            "cuenta_id", "cliente_id", "estado",
            F.to_date("_ultimo").alias("ultimo_movimiento"), "dias", "nunca",
        )
    )


def churn(tx: DataFrame, days: int = 90, as_of: AsOf = None) -> DataFrame:
    """Per client with transactions: last one, idle days, and whether the client left."""
    last = until(tx, as_of).groupBy("cliente_id").agg(F.max("timestamp_tx").alias("_ultimo"))
    idle = F.datediff(F.to_date(_today(last, as_of)), F.to_date("_ultimo"))
    return last.select(
        "cliente_id",
        F.to_date("_ultimo").alias("ultimo_movimiento"),
        idle.cast("bigint").alias("dias"),
        (idle >= days).alias("churn"),
    )


# --- segmentation -----------------------------------------------------------

def client_values(tx: DataFrame, as_of: AsOf = None, currency: str | None = None) -> DataFrame:
    """Per client: recency in days, number of transactions, total amount per currency."""
    moneda = F.col(currency) if currency else F.lit("")
    totals = (
        until(tx, as_of)
        .groupBy("cliente_id", *([currency] if currency else []))
        .agg(
            F.max("timestamp_tx").alias("_ultimo"),
            movements(tx).alias("frecuencia"),
            F.sum("monto").alias("monto"),
        )
        .withColumn("_m", F.struct(moneda.alias("moneda"), "monto"))
    )
    idle = F.datediff(F.to_date(_today(totals, as_of)), F.to_date(F.col("_ultimo"))).cast("bigint")
    if currency:
        # At most one element per currency.
        totals = totals.groupBy("cliente_id").agg(
            F.max("_ultimo").alias("_ultimo"),
            F.sum("frecuencia").alias("frecuencia"),
            F.array_sort(F.collect_list("_m")).alias("montos"),
        )
    else:
        totals = totals.withColumn("montos", F.array("_m"))
    return totals.select("cliente_id", idle.alias("recencia"), "frecuencia", "montos")


def segmentation(tx: DataFrame, as_of: AsOf = None, currency: str | None = None) -> DataFrame:
    """Recency, frequency and amount cut at their quartiles; 4 is the best band of each.

    Amounts are ranked within their currency; a client with several currencies has
    the best of these bands. ``montos`` lists the totals per currency; without a
    currency there is just ``monto``.
    """
    values = client_values(tx, as_of, currency)

    def metric(name: Column, value: Column) -> Column:
        return F.struct(name.alias("metrica"), value.cast("double").alias("valor"))

    def amount_metric(total: Column) -> Column:
        return F.concat(F.lit("monto "), total["moneda"])

    long = values.select(
        F.explode(
            F.concat(
                F.array(
                    metric(F.lit("recencia"), F.col("recencia")),
                    metric(F.lit("frecuencia"), F.col("frecuencia")),
                ),
                F.transform("montos", lambda total: metric(amount_metric(total), total["monto"])),
            )
        ).alias("_m")
    ).select("_m.*")
    # A row per metric (and currency), folded into one map.
    cuts = (
        exact_quantiles(long, ["metrica"], "valor", QUARTILES)
        .agg(F.map_from_entries(F.collect_list(F.struct("metrica", "cuts"))))
        .scalar()
    )

    def cut(name: str) -> Column:
        return band(F.col(name), F.col("_cortes")[name])

    banded = values.withColumn("_cortes", cuts).select(
        "cliente_id",
        "recencia",
        "frecuencia",
        "montos" if currency else F.col("montos")[0]["monto"].alias("monto"),
        (F.lit(5) - cut("recencia")).alias("r"),
        cut("frecuencia").alias("f"),
        F.array_max(
            F.transform(
                "montos", lambda total: band(total["monto"], F.col("_cortes")[amount_metric(total)])
            )
        ).alias("m"),
    )
    return banded.withColumn("segmento_rfm", F.col("r") * 100 + F.col("f") * 10 + F.col("m"))


# --- finance ----------------------------------------------------------------

def finance_monthly(
    tx: DataFrame, cuentas: DataFrame, inflow: Sequence[str] = domain.TIPOS_ENTRADA
) -> DataFrame:
    """Per month, currency and account type: money in, out and net.

    Summed per account and month before accounts are joined.
    """
    per_account = _flows(tx, ["cuenta_id"], inflow)
    return (
        per_account.join(cuentas.select("cuenta_id", "moneda", "tipo_cuenta"), "cuenta_id")
        .groupBy("mes", "moneda", "tipo_cuenta")
        .agg(
            F.sum("n_tx").alias("n_tx"),
            F.sum("entradas").alias("entradas"),
            F.sum("salidas").alias("salidas"),
        )
        .withColumn("neto", F.col("entradas") - F.col("salidas"))
    )


def _flows(tx: DataFrame, keys: Sequence[str], inflow: Sequence[str]) -> DataFrame:
    sign = direction("tipo_tx", inflow)
    return tx.groupBy(month_of("timestamp_tx").alias("mes"), *keys).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum(F.when(sign > 0, F.col("monto")).otherwise(0)).alias("entradas"),
        F.sum(F.when(sign < 0, F.col("monto")).otherwise(0)).alias("salidas"),
    )


def finance_of_enriched(tx: DataFrame, inflow: Sequence[str] = domain.TIPOS_ENTRADA) -> DataFrame:
    """``finance_monthly`` of rows that carry their account's currency and type: no join."""
    flows = _flows(tx, ["moneda", "tipo_cuenta"], inflow)
    return flows.withColumn("neto", F.col("entradas") - F.col("salidas"))


def client_features(
    clientes: DataFrame, scored: DataFrame, dormant: DataFrame, left: DataFrame, segments: DataFrame
) -> DataFrame:
    """One row per client for models: score, dormant accounts, churn and bands."""
    sleeping = dormant.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("_dormidas"))
    return (
        clientes.select("cliente_id", "pais", "segmento")
        .join(scored.select("cliente_id", "score"), "cliente_id", "left")
        .join(sleeping, "cliente_id", "left")
        .join(left.select("cliente_id", "churn"), "cliente_id", "left")
        .join(segments.drop("r", "f", "m"), "cliente_id", "left")
        .withColumn("cuentas_dormidas", F.coalesce("_dormidas", F.lit(0)))
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .drop("_dormidas")
    )
