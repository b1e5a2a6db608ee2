"""Raw files -> bronze -> silver -> gold under one base path, and backfills.

Each layer is a set of Parquet tables read back by the next one: silver is a pure
function of bronze and gold of silver, so any step can run again, and a lost
executor never has to go back further than the last written table. The base is any
path Spark can write: HDFS, ``s3a://…`` or a local folder in tests.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal import schemas
from caudal.operators import quality
from caudal.plans import activity, fraud, silver
from caudal.session import reused
from caudal.sources import bronze, jdbc, raw, seeds


@dataclass(frozen=True)
class Layout:
    """Where each layer lives."""

    base: str

    def raw(self, table: str, kind: str = "csv") -> str:
        return f"{self.base}/raw/{table}.{kind}"

    def bronze(self, table: str) -> str:
        return f"{self.base}/bronze/{table}"

    def silver(self, table: str) -> str:
        return f"{self.base}/silver/{table}"

    def gold(self, table: str) -> str:
        return f"{self.base}/gold/{table}"


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest(
    spark: SparkSession,
    layout: Layout,
    ingested_at: dt.datetime,
    formats: Mapping[str, str] | None = None,
) -> None:
    """Raw files to bronze, untouched: those that no other delivery has brought as they are now.

    The same ingest time again replaces its delivery. Tables arrive as CSV unless
    ``formats`` says ``json``.
    """
    for table, schema in schemas.TABLES.items():
        kind = (formats or {}).get(table, "csv")
        rows = bronze.to_bronze(raw.read_text(spark, layout.raw(table, kind), schema, kind), ingested_at)
        stored = _stored_or_none(spark, layout.bronze(table))
        bronze.write_bronze(bronze.not_yet_stored(rows, stored), layout.bronze(table))


def _stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return bronze.stored_files(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def build_silver(spark: SparkSession, layout: Layout) -> None:
    """Bronze to typed tables, quarantine, reconciliation and the quality report.

    Every row received is in silver, a copy of a row there, or in the quarantine; every
    transaction in silver is enriched or in the quarantine. The checked rows are a table
    of their own, so bronze is read and checked once.
    """
    cleaned = {
        table: silver.clean(
            bronze.payload(bronze.read_bronze(spark, layout.bronze(table)), keep=(bronze.INGESTED_AT,)),
            table,
            lambda checked, table=table: _stored(checked, layout.silver(f"{table}_comprobadas")),
        )
        for table in schemas.TABLES
    }
    for table, parts in cleaned.items():
        _write(parts.good, layout.silver(table))
    clientes, cuentas, tx = read_silver(spark, layout)
    written = dict(zip(schemas.TABLES, (clientes, cuentas, tx)))
    counts = [silver.reconciliation(c.checked, written[table], table) for table, c in cleaned.items()]
    aside = [
        *[c.quarantine for c in cleaned.values()],
        silver.set_aside(silver.null_amounts(tx), "transacciones", "nulo:monto"),
        silver.set_aside(
            silver.without_owner(silver.with_amount(tx), cuentas, clientes), "transacciones", "huerfana:cuenta_id"
        ),
    ]
    _write(reduce(DataFrame.unionByName, aside), layout.silver("cuarentena"))
    _write(reduce(DataFrame.unionByName, counts), layout.silver("conciliacion"))
    _write(silver.broken_rules(clientes, cuentas, tx), layout.silver("reglas_incumplidas"))
    report = silver.quality_report(
        clientes, cuentas, tx, seeds.pais_ciudad(spark), seeds.categoria_comercio(spark)
    )
    unique = silver.unique_keys({table: c.typed for table, c in cleaned.items()})
    versions = _stored(silver.account_versions(cleaned["cuentas"].checked), layout.silver("cuentas_versiones"))
    then = silver.on_account_inactive_then(tx, versions, "inactive_account_then:transacciones")
    _write(report.unionByName(unique).unionByName(then), layout.silver("calidad"))
    _write(
        silver.enrich(silver.with_amount(tx), cuentas, clientes),
        layout.silver("transacciones_enriquecidas"),
    )


def read_silver(spark: SparkSession, layout: Layout) -> tuple[DataFrame, DataFrame, DataFrame]:
    clientes, cuentas, tx = (
        spark.read.schema(schema).parquet(layout.silver(table))
        for table, schema in schemas.TABLES.items()
    )
    return clientes, cuentas, tx


class QualityError(Exception):
    """Checks of silver above their limit: gold is not built."""


def validate(spark: SparkSession, layout: Layout, limits: Mapping[str, float]) -> None:
    """Raise if a check's share of failed rows is above its limit; a few report rows reach the driver."""
    if limits:
        failed = quality.exceeding(spark.read.parquet(layout.silver("calidad")), limits).collect()
        if failed:
            raise QualityError("; ".join(f"{r['check']}: {r['n_failed']} of {r['n_rows']}" for r in failed))


def _days(of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Rows per transaction, stored by their day."""
    return lambda tx: of(tx).withColumn("fecha", F.to_date("timestamp_tx"))


# Gold by day: the metric, and how far back it looks.
DAILY: dict[str, tuple[Callable[[DataFrame], DataFrame], dt.timedelta]] = {
    "tx_diarias_cliente": (lambda tx: activity.daily_of_enriched(tx, ("moneda",)), dt.timedelta(0)),
    "clientes_bocetos": (lambda tx: activity.client_sketches(tx), dt.timedelta(0)),
    "rafagas": (_days(lambda tx: fraud.burst_transactions(tx, "moneda")), dt.timedelta(hours=1)),
    "secuencias_rapidas": (_days(fraud.fast_transactions), dt.timedelta(hours=1)),
    "viajes_imposibles": (_days(fraud.travel_transactions), dt.timedelta(days=1)),
}


def build_gold(
    spark: SparkSession,
    layout: Layout,
    as_of: activity.AsOf = None,
    days: tuple[dt.date, dt.date] | None = None,
) -> None:
    """Every metric as a table, from rows up to ``as_of``. Personal data stays in silver.

    With ``days`` (first, end exclusive) the tables by day are computed again for just
    these days; what looks at whole histories is built from them as ever.
    """
    clientes, cuentas, _ = read_silver(spark, layout)
    clientes = clientes.drop(*schemas.PERSONAL_DATA)
    tx = activity.until(spark.read.parquet(layout.silver("transacciones_enriquecidas")), as_of)

    for name, (metric, lookback) in DAILY.items():
        if days is None:
            write_days(metric(tx), layout.gold(name))
        else:
            backfill(tx, metric, *days, layout.gold(name), lookback)
    by_client = spark.read.parquet(layout.gold("tx_diarias_cliente"))
    by_day = activity.summarise_days(by_client, ("moneda",))
    if days is None:
        write_days(by_day, layout.gold("tx_diarias"))
    else:
        replace_days(by_day, *days, layout.gold("tx_diarias"))
    sketched = spark.read.parquet(layout.gold("clientes_bocetos"))
    _write(activity.retained_clients(sketched, ("pais", "segmento")), layout.gold("retencion_clientes"))
    _write(activity.activity_rollup(by_client, ("moneda",)), layout.gold("actividad_subtotales"))
    per_day = activity.as_movements(by_client)
    _write(activity.retention_by_volume(per_day, "moneda"), layout.gold("retencion"))
    _write(activity.finance_of_enriched(tx), layout.gold("finanzas"))
    _write(fraud.unusual_amounts(tx, currency="moneda"), layout.gold("montos_inusuales"))

    scored = fraud.score(
        clientes,
        fraud.amount_rate(tx, currency="moneda"),
        fraud.foreign_share_of_enriched(tx),
        fraud.velocity_rate(tx),
    )
    dormant = activity.dormant_accounts(cuentas, tx, as_of=as_of, states=("ACTIVA",))
    # One row per client or account; each is written and read again for the features.
    with (
        reused(scored) as scored,
        reused(dormant) as dormant,
        reused(activity.churn(per_day, as_of=as_of)) as left,
        reused(activity.segmentation(per_day, as_of, "moneda")) as segments,
    ):
        _write(scored, layout.gold("fraude_score"))
        _write(dormant, layout.gold("cuentas_inactivas"))
        _write(left, layout.gold("churn"))
        _write(segments, layout.gold("segmentacion"))
        _write(
            activity.client_features(clientes, scored, dormant, left, segments),
            layout.gold("cliente_features"),
        )


def publish(spark: SparkSession, layout: Layout, options: Callable[[str], Mapping[str, str]], tables: Sequence[str]) -> None:
    """Write gold tables to a database; ``options`` gives a table's connection options."""
    for table in tables:
        jdbc.write_jdbc(spark.read.parquet(layout.gold(table)), options(table))


def run_pipeline(
    spark: SparkSession,
    base: str,
    ingested_at: dt.datetime,
    as_of: activity.AsOf = None,
    formats: Mapping[str, str] | None = None,
    limits: Mapping[str, float] | None = None,
) -> None:
    """Ingest, clean, validate, build: a step that fails stops those after it.

    ``limits``: the highest share of failed rows of a quality check.
    """
    layout = Layout(base)
    ingest(spark, layout, ingested_at, formats)
    build_silver(spark, layout)
    validate(spark, layout, limits or {})
    build_gold(spark, layout, as_of)


# --- tables by day, backfill --------------------------------------------------

def _by_day(daily: DataFrame, mode: str, path: str) -> None:
    """``rebalance`` makes files of even size: small days share a task, a large one is split."""
    (
        daily.hint("rebalance", "fecha")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("fecha")
        .parquet(path)
    )


def write_days(daily: DataFrame, path: str) -> None:
    """Write a whole table by day; nothing of an earlier run stays.

    Without any day there is no file that would say the columns, so an empty one does.
    """
    _by_day(daily, "static", path)
    if daily.sparkSession.read.schema(daily.schema).parquet(path).isEmpty():
        daily.limit(0).write.mode("overwrite").parquet(path)


def replace_days(daily: DataFrame, start: dt.date, end: dt.date, path: str) -> None:
    """Replace the days [start, end) of a table by ``daily``'s.

    Other days stay untouched, and a day that no longer has any row becomes empty, so
    running it twice is the same as once. The driver sees days, never rows.
    """
    spark = daily.sparkSession
    in_range = (F.col("fecha") >= F.lit(start)) & (F.col("fecha") < F.lit(end))

    def days_of(df: DataFrame) -> set[dt.date]:
        return {row["fecha"] for row in df.filter(in_range).select("fecha").distinct().collect()}

    with reused(daily.filter(in_range)) as result:
        _by_day(result, "dynamic", path)
        written = spark.read.schema(result.schema).parquet(path)
        for day in sorted(days_of(written) - days_of(result)):
            result.drop("fecha").limit(0).write.mode("overwrite").parquet(f"{path}/fecha={day}")


def backfill(
    tx: DataFrame,
    metric: Callable[[DataFrame], DataFrame],
    start: dt.date,
    end: dt.date,
    path: str,
    lookback: dt.timedelta = dt.timedelta(0),
) -> None:
    """Compute a metric by day again for [start, end).

    ``metric`` returns rows with ``fecha``, the partition column; it sees the rows of
    these days and those up to ``lookback`` before.
    """
    first = dt.datetime.combine(start, dt.time.min) - lookback
    seen = (F.col("timestamp_tx") >= F.lit(first).cast("timestamp_ntz")) & (
        F.col("timestamp_tx") < F.lit(end).cast("timestamp_ntz")
    )
    replace_days(metric(tx.filter(seen)), start, end, path)
