"""The registered queries: every operator and metric over whole test tables.

Each function takes the session and a folder of Parquet tables. Money leaves as
double so that engines compare values alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import domain
from caudal.functions.hashing import hash_uniform, uniform_between, uniform_int, weighted_choice
from caudal.functions.values import direction, format_key, key_matches, month_of, plus_seconds, seconds_between
from caudal.operators import joins, keysets, prefix, quality, sampling, sketches
from caudal.operators.dedup import latest_by_key
from caudal.plans import activity, fraud, silver, stand_ins
from caudal.session import written
from caudal.sources.bronze import to_bronze
from caudal.sources.raw import json_fields

Query = Callable[[SparkSession, str], DataFrame]

# On lineitem amounts no client has a transaction beyond 3 deviations.
AMOUNT_THRESHOLD = 2.0
INFLOW = ("R",)


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, 32-bit integers as 64-bit ones."""
    def out(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)

    return df.select(*[out(f) for f in df.schema.fields])


# --- sources, projections, filters -------------------------------------------

def bronze_scan(spark: SparkSession, sf: str) -> DataFrame:
    raw = stand_ins.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        stand_ins.money("o_totalprice").alias("o_totalprice"), "o_orderdate", "o_orderpriority",
    )
    stamp = F.to_timestamp(F.lit("2025-01-01 06:00:00"))
    source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    bronze = to_bronze(raw, stamp, source)
    return bronze.select(*raw.columns, F.col("_source_file").alias("source_file"), "ingest_date")


def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    fields = json_fields("props", T.StructType([T.StructField("k", T.LongType())]))
    return stand_ins.table(spark, sf, "events").select("event_id", *fields)


def filter_active(spark: SparkSession, sf: str) -> DataFrame:
    active = stand_ins.cuentas(spark, sf).filter(F.col("estado") == "ACTIVA")
    return _plain(active.select("cuenta_id", "cliente_id", "tipo_cuenta", "saldo_inicial"))


def account_country(spark: SparkSession, sf: str) -> DataFrame:
    active = stand_ins.cuentas(spark, sf).filter(F.col("estado") == "ACTIVA")
    return active.join(stand_ins.clientes(spark, sf), "cliente_id").select("cuenta_id", "pais")


def filter_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    amount = stand_ins.money("o_totalprice")
    return _plain(
        stand_ins.table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 100000)
        .groupBy(F.col("o_orderpriority").alias("categoria"))
        .agg(F.sum(amount).alias("monto"))
    )


def active_tx_semi(spark: SparkSession, sf: str) -> DataFrame:
    active = stand_ins.cuentas(spark, sf).filter(F.col("estado").isin("ACTIVA"))
    tx = stand_ins.lineitem_tx(spark, sf).select("transaccion_id", "cuenta_id", "monto")
    return _plain(joins.with_children(tx, "cuenta_id", active))


def tx_direction(spark: SparkSession, sf: str) -> DataFrame:
    tx = stand_ins.lineitem_tx(spark, sf).withColumn("signo", direction("tipo_tx", INFLOW))
    return _plain(
        tx.groupBy("tipo_tx", "signo").agg(
            F.count(F.lit(1)).alias("n_tx"), F.sum(F.col("monto") * F.col("signo")).alias("flujo")
        )
    )


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = None
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
        one = stand_ins.table(spark, sf, name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("tabla"), "n_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def key_format(spark: SparkSession, sf: str) -> DataFrame:
    prefix, digits = domain.FORMATO_CLIENTE
    tx_prefix, tx_digits = domain.FORMATO_TRANSACCION
    keyed = stand_ins.table(spark, sf, "orders").select(
        "o_orderkey",
        format_key("o_custkey", prefix, digits).alias("cliente"),
        format_key(F.col("o_orderkey") * 10_000_000, tx_prefix, tx_digits).alias("transaccion"),
        F.concat(F.lit("TX"), F.col("o_orderkey")).alias("sin_relleno"),
    )
    return keyed.withColumn("cliente_ok", key_matches("cliente", prefix, digits)).withColumn(
        "transaccion_ok", key_matches("transaccion", tx_prefix, tx_digits)
    ).withColumn("sin_relleno_ok", key_matches("sin_relleno", tx_prefix, tx_digits))


def ts_arith(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.pmod(F.col("o_orderkey"), F.lit(100_000)).cast("int")
    days = F.pmod(F.col("o_orderkey"), F.lit(400)).cast("int")
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    moved = plus_seconds("o_orderdate", seconds).cast("timestamp_ntz")
    return stand_ins.table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_add(F.to_date("o_orderdate"), days).alias("fecha_mas"),
        moved.alias("ts_mas"),
        F.datediff(F.to_date("o_orderdate"), F.to_date(start)).cast("bigint").alias("dias"),
        seconds_between(start, moved).cast("bigint").alias("segundos"),
    )


# --- joins --------------------------------------------------------------------

def tx_home_country(spark: SparkSession, sf: str) -> DataFrame:
    active = stand_ins.cuentas(spark, sf).filter(F.col("estado") == "ACTIVA")
    home = silver.account_owner(active, stand_ins.clientes(spark, sf)).select("cuenta_id", "pais")
    tx = stand_ins.lineitem_tx(spark, sf).select("transaccion_id", "cuenta_id")
    return tx.join(home, "cuenta_id")


def enrich_tx(spark: SparkSession, sf: str) -> DataFrame:
    tx = stand_ins.lineitem_tx_abroad(spark, sf)
    return _plain(silver.enrich(tx, stand_ins.cuentas(spark, sf), stand_ins.clientes(spark, sf)))


def never_moved(spark: SparkSession, sf: str) -> DataFrame:
    accounts = stand_ins.cuentas(spark, sf).select("cuenta_id", "cliente_id", "estado")
    return joins.without_children(accounts, "cuenta_id", stand_ins.lineitem_tx(spark, sf))


# --- cleaning -------------------------------------------------------------------

def type_validation(spark: SparkSession, sf: str) -> DataFrame:
    spoiled = stand_ins.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("transaccion_id"),
        F.when(hash_uniform("event_id", "texto") < 0.02, F.lit("abc"))
        .when(hash_uniform("event_id", "vacio") < 0.02, F.lit(""))
        .otherwise(stand_ins.money("value").cast("string"))
        .alias("monto"),
        F.when(hash_uniform("event_id", "fecha") < 0.02, F.lit("2022-13-45"))
        .otherwise(F.to_date("ts").cast("string"))
        .alias("fecha"),
    )
    schema = T.StructType(
        [
            T.StructField("transaccion_id", T.StringType()),
            T.StructField("monto", T.DecimalType(18, 2)),
            T.StructField("fecha", T.DateType()),
        ]
    )
    checked = quality.validate_types(spoiled, schema, required=("monto",))
    return _plain(checked.withColumn(quality.REASONS, F.array_join(quality.REASONS, ",")))


def silver_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems as text, some with a bad or empty amount; order and line are the key."""
    raw = stand_ins.lineitem_tx(spark, sf).select(
        F.regexp_extract("transaccion_id", r"^\d+-\d+", 0).alias("transaccion_id"),
        F.date_format("timestamp_tx", "yyyy-MM-dd").alias("fecha"),
        F.when(hash_uniform("transaccion_id", "texto") < 0.02, F.lit("10.005"))
        .when(hash_uniform("transaccion_id", "vacio") < 0.02, F.lit(""))
        .otherwise(F.col("monto").cast("string"))
        .alias("monto"),
    )
    schema = T.StructType(
        [
            T.StructField("transaccion_id", T.StringType()),
            T.StructField("fecha", T.DateType()),
            T.StructField("monto", T.DecimalType(18, 2)),
        ]
    )
    checked = written(quality.validate_types(raw, schema, required=("transaccion_id", "monto")), "comprobadas")
    good = latest_by_key(quality.accepted(checked), ["transaccion_id"], ["fecha"])
    return silver.reconciliation(checked, good, "transacciones")


def dedup_tx(spark: SparkSession, sf: str) -> DataFrame:
    lines = stand_ins.table(spark, sf, "lineitem")
    return _plain(latest_by_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))


def _orders_without_some_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.inject_nulls(
        stand_ins.order_tx(spark, sf), "monto", "transaccion_id", "nulos", domain.PROPORCION_MONTO_NULO
    )


def quarantine_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(silver.null_amounts(_orders_without_some_amounts(spark, sf)))


def dq_not_null(spark: SparkSession, sf: str) -> DataFrame:
    tx = _orders_without_some_amounts(spark, sf)
    rules = {f"not_null:{c}": quality.is_missing(c) for c in tx.columns}
    return _plain(quality.count_failures(tx, rules))


def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    lines = stand_ins.table(spark, sf, "lineitem")
    orders = stand_ins.table(spark, sf, "orders")
    return _plain(
        quality.count_repeated(lines, ["l_orderkey", "l_linenumber"], "unique:lineitem").unionByName(
            quality.count_repeated(orders, ["o_orderkey"], "unique:orders")
        )
    )


def dq_relationships(spark: SparkSession, sf: str) -> DataFrame:
    cuentas = stand_ins.cuentas(spark, sf).select("cuenta_id", "cliente_id", "estado")
    inactive = F.col("cuenta_id").isNotNull() & ~F.col("estado").eqNullSafe(F.lit("ACTIVA"))
    of_tx = quality.count_against(
        stand_ins.lineitem_tx(spark, sf),
        ["cuenta_id"],
        [(cuentas.select("cuenta_id", "estado"), ["cuenta_id"], "_hay")],
        {
            "relationship:tx.cuenta": quality.lost(["cuenta_id"], "_hay"),
            "relationship:tx.cuenta_activa": inactive,
        },
    )
    return _plain(
        of_tx.unionByName(
            quality.count_orphans(
                cuentas, "cliente_id", stand_ins.clientes(spark, sf), "relationship:cuenta.cliente"
            )
        )
    )


def dq_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(
        silver.before_opening(
            stand_ins.lineitem_tx(spark, sf), stand_ins.cuentas(spark, sf), "temporal:tx_antes_de_apertura"
        )
    )


def dq_inactive_account_tx(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(
        silver.on_inactive_account(
            stand_ins.lineitem_tx(spark, sf), stand_ins.cuentas(spark, sf), "inactive_account_tx"
        )
    )


def dq_accepted_values(spark: SparkSession, sf: str) -> DataFrame:
    spoiled = stand_ins.cuentas(spark, sf).withColumn(
        "moneda",
        F.when(hash_uniform("cuenta_id", "moneda_mala") < 0.02, F.lit("XXX")).otherwise(F.col("moneda")),
    )
    return _plain(
        quality.count_failures(
            spoiled,
            {
                "accepted:estado": quality.not_in("estado", list(domain.ESTADOS)),
                "accepted:moneda": quality.not_in("moneda", list(domain.MONEDAS)),
                "accepted:tipo_cuenta": quality.not_in(
                    "tipo_cuenta", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
                ),
            },
        )
    )


def dq_pair_in_seed(spark: SparkSession, sf: str) -> DataFrame:
    nation = stand_ins.table(spark, sf, "nation")
    region = stand_ins.table(spark, sf, "region")
    seed = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("pais")
    )
    customer = stand_ins.table(spark, sf, "customer")
    # Two customers in a hundred are moved to the next region.
    moved = F.when(hash_uniform("c_custkey", "region") < 0.02, F.lit(1)).otherwise(F.lit(0))
    placed = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .withColumn("_r", F.pmod(F.col("n_regionkey") + moved, F.lit(5)))
        .join(region, F.col("_r") == region.r_regionkey)
        .select(F.col("r_name").alias("region"), F.col("n_name").alias("pais"))
    )
    return _plain(quality.count_pairs_outside(placed, ["region", "pais"], seed, "pair:region_pais"))


EVENT_RANGES = {
    "signup": (0.05, 300),
    "error": (0.01, 250.5),
    "view": (1, 200),
    "purchase": (5, 500),
    "click": (0.01, 100),
}


def dq_range_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rule = quality.outside_range("monto", "tipo_tx", EVENT_RANGES)
    return _plain(quality.count_failures(stand_ins.event_tx(spark, sf), {"range:monto": rule}))


def dq_conditional_null(spark: SparkSession, sf: str) -> DataFrame:
    """Only the other types carry a value; two rows in a hundred break that."""
    broken = hash_uniform("transaccion_id", "condicional") < 0.02
    is_error = F.col("tipo_tx") == "error"
    spoiled = stand_ins.event_tx(spark, sf).withColumn(
        "monto", F.when(is_error != broken, F.lit(None)).otherwise(F.col("monto"))
    )
    rule = quality.presence_breaks_rule("monto", "tipo_tx", ["signup", "view", "purchase", "click"])
    return _plain(quality.count_failures(spoiled, {"conditional_null:monto": rule}))


# --- sampling ---------------------------------------------------------------------

def weighted_choice_query(spark: SparkSession, sf: str) -> DataFrame:
    return stand_ins.table(spark, sf, "orders").select(
        "o_orderkey",
        weighted_choice("o_orderkey", "segmento", domain.SEGMENTOS).alias("segmento"),
        F.round(uniform_between("o_orderkey", "saldo", 100, 50_000), 2).alias("saldo"),
        uniform_int("o_orderkey", "dia", 0, 1460).alias("dia"),
    )


def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = stand_ins.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.sample_exact_share(orders, "o_orderkey", "muestra", domain.PROPORCION_DUPLICADOS)


def null_inject(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_orders_without_some_amounts(spark, sf))


def dup_inject(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(
        sampling.inject_copies(
            stand_ins.order_tx(spark, sf), "transaccion_id", "copias", domain.PROPORCION_DUPLICADOS
        )
    )


def assign_fk(spark: SparkSession, sf: str) -> DataFrame:
    orders = stand_ins.table(spark, sf, "orders").select("o_orderkey")
    customers = stand_ins.table(spark, sf, "customer").select("c_custkey")
    return sampling.assign_parent(orders, "o_orderkey", customers, "c_custkey", "titular")


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    customers = stand_ins.table(spark, sf, "customer").select("c_custkey")
    return sampling.fan_out(customers, "c_custkey", "cuentas", 3, "n_cuenta")


def foreign_candidates(spark: SparkSession, sf: str) -> DataFrame:
    # One array of country names: the table is a seed.
    names = stand_ins.table(spark, sf, "nation").agg(F.array_sort(F.collect_set("n_name"))).scalar()
    place = sampling.home_or_foreign(
        "cliente_id", "lugar", F.col("pais"), F.col("_paises"), domain.PROPORCION_PAIS_PROPIO
    )
    return (
        stand_ins.clientes(spark, sf)
        .withColumn("_paises", names)
        .select(
            "cliente_id",
            "pais",
            F.array_join(F.array_remove("_paises", F.col("pais")), ",").alias("candidatos"),
            place.alias("pais_tx"),
        )
    )


# --- metrics ------------------------------------------------------------------------

def daily_tx(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(activity.daily(stand_ins.order_tx(spark, sf), stand_ins.clientes(spark, sf)))


# A day within the test tables; later rows must not count.
ORDERS_AS_OF = dt.date(1999, 6, 30)
EVENTS_AS_OF = dt.date(2024, 1, 15)


def daily_tx_as_of(spark: SparkSession, sf: str) -> DataFrame:
    tx = activity.until(stand_ins.order_tx(spark, sf), ORDERS_AS_OF)
    return _plain(activity.daily(tx, stand_ins.clientes(spark, sf)))


def daily_tx_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(activity.daily_by_client(stand_ins.order_tx(spark, sf), stand_ins.clientes(spark, sf)))


def velocity_hourly(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "timestamp_tx").cast("timestamp_ntz")
    return (
        stand_ins.event_tx(spark, sf)
        .groupBy("cliente_id", hour.alias("hora"))
        .agg(F.count(F.lit(1)).alias("n_tx"))
    )


def fraud_amount(spark: SparkSession, sf: str) -> DataFrame:
    flagged = fraud.unusual_amounts(stand_ins.event_tx(spark, sf))
    return _plain(
        flagged.select("transaccion_id", "cliente_id", "monto", F.round("z", 4).alias("z"))
    )


def fraud_burst(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(fraud.bursts(stand_ins.event_tx(spark, sf)))


def fraud_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.fast_sequences(stand_ins.event_tx(spark, sf))


def fraud_burst_tx(spark: SparkSession, sf: str) -> DataFrame:
    flagged = fraud.burst_transactions(stand_ins.event_tx(spark, sf))
    return _plain(
        flagged.select("transaccion_id", "cliente_id", "timestamp_tx", "monto", "n_ventana", "suma_ventana")
    )


def fraud_velocity_tx(spark: SparkSession, sf: str) -> DataFrame:
    flagged = fraud.fast_transactions(stand_ins.event_tx(spark, sf))
    return flagged.select("transaccion_id", "cliente_id", "timestamp_tx", "n_ventana")


def fraud_travel_tx(spark: SparkSession, sf: str) -> DataFrame:
    flagged = fraud.travel_transactions(stand_ins.lineitem_tx_abroad(spark, sf))
    return flagged.select(
        "transaccion_id", "cuenta_id", "timestamp_tx", "pais_tx", "timestamp_tx_previo", "pais_tx_previo"
    )


def fraud_amount_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = fraud.amount_rate(stand_ins.event_tx(spark, sf))
    return rates.select("cliente_id", F.round("tasa_monto", 6).alias("tasa_monto"))


def fraud_geo(spark: SparkSession, sf: str) -> DataFrame:
    owners = silver.account_owner(stand_ins.cuentas(spark, sf), stand_ins.clientes(spark, sf))
    return fraud.foreign_share(stand_ins.lineitem_tx_abroad(spark, sf), owners)


def fraud_travel(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.impossible_travel(stand_ins.lineitem_tx_abroad(spark, sf))


def fraud_score(
    spark: SparkSession, sf: str, as_of: dt.date | None = None, events_as_of: dt.date | None = None
) -> DataFrame:
    clientes = stand_ins.clientes(spark, sf)
    cuentas = stand_ins.cuentas(spark, sf)
    tx = activity.until(stand_ins.lineitem_tx(spark, sf), as_of)
    owned = tx.join(cuentas.select("cuenta_id", "cliente_id"), "cuenta_id")
    owners = silver.account_owner(cuentas, clientes)
    return fraud.score(
        clientes,
        fraud.amount_rate(owned, AMOUNT_THRESHOLD),
        fraud.foreign_share(activity.until(stand_ins.lineitem_tx_abroad(spark, sf), as_of), owners),
        fraud.velocity_rate(activity.until(stand_ins.event_tx(spark, sf), events_as_of)),
    )


def fraud_score_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return fraud_score(spark, sf, ORDERS_AS_OF, EVENTS_AS_OF)


def fraud_top_clients(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.top_clients(fraud_score(spark, sf), 20).select("cliente_id", "score")


def retention_by_volume(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(activity.retention_by_volume(stand_ins.order_tx(spark, sf)))


def dormant_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.dormant_accounts(stand_ins.cuentas(spark, sf), stand_ins.lineitem_tx(spark, sf))


def churn(spark: SparkSession, sf: str) -> DataFrame:
    return activity.churn(stand_ins.order_tx(spark, sf))


def segmentation(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(activity.segmentation(stand_ins.order_tx(spark, sf)))


def finance_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(
        activity.finance_monthly(stand_ins.lineitem_tx(spark, sf), stand_ins.cuentas(spark, sf), INFLOW)
    )


def client_features(
    spark: SparkSession, sf: str, as_of: dt.date | None = None, events_as_of: dt.date | None = None
) -> DataFrame:
    orders = stand_ins.order_tx(spark, sf)
    dormant = activity.dormant_accounts(
        stand_ins.cuentas(spark, sf), stand_ins.lineitem_tx(spark, sf), as_of=as_of
    )
    return _plain(
        activity.client_features(
            stand_ins.clientes(spark, sf),
            fraud_score(spark, sf, as_of, events_as_of),
            dormant,
            activity.churn(orders, as_of=as_of),
            activity.segmentation(orders, as_of),
        )
    )


def client_features_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return client_features(spark, sf, ORDERS_AS_OF, EVENTS_AS_OF)


# --- mergeable parts, key sets, earlier rows ------------------------------------------

def _client_days(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the clients per day, country and segment."""
    owned = stand_ins.order_tx(spark, sf).join(stand_ins.clientes(spark, sf), "cliente_id")
    return activity.client_sketches(owned)


def monthly_clients_sketched(spark: SparkSession, sf: str) -> DataFrame:
    return activity.monthly_clients(_client_days(spark, sf))


def retention_sketched(spark: SparkSession, sf: str) -> DataFrame:
    return activity.retained_clients(_client_days(spark, sf))


def activity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    by_client = activity.daily_by_client(stand_ins.order_tx(spark, sf), stand_ins.clientes(spark, sf))
    return _plain(activity.activity_rollup(by_client))


def amount_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    tx = stand_ins.order_tx(spark, sf)
    monthly = tx.groupBy("cliente_id", month_of("timestamp_tx").alias("mes")).agg(F.sum("monto").alias("monto"))
    cuts = activity.amount_quartiles(monthly, sketches.quantile_sketches(monthly, ["mes"], "monto"))
    return _plain(cuts.select("anio", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")]))


def dq_unique_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    lines = keysets.dense_key(stand_ins.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    orders = stand_ins.table(spark, sf, "orders")
    return keysets.count_repeated(lines, "_clave", "unique:lineitem").unionByName(
        keysets.count_repeated(orders, "o_orderkey", "unique:orders")
    )


def dq_relationships_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    cuentas = stand_ins.cuentas(spark, sf).select("cuenta_id", "cliente_id", "estado")
    tx = stand_ins.lineitem_tx(spark, sf).select("cuenta_id")
    active = cuentas.filter(F.col("estado") == "ACTIVA")
    parts = [
        keysets.count_orphans(tx, "cuenta_id", cuentas, "relationship:tx.cuenta"),
        keysets.count_orphans(tx, "cuenta_id", active, "relationship:tx.cuenta_activa"),
        keysets.count_orphans(cuentas, "cliente_id", stand_ins.clientes(spark, sf), "relationship:cuenta.cliente"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fraud_amount_before(spark: SparkSession, sf: str) -> DataFrame:
    flagged = fraud.unusual_amounts_before(stand_ins.event_tx(spark, sf))
    return _plain(
        flagged.select("transaccion_id", "cliente_id", "monto", "n_previas", F.round("z", 4).alias("z"))
    )


def tx_state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with what was last known of their client when they happened."""
    cuentas = stand_ins.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cuenta_id"), F.col("o_custkey").alias("cliente_id"), "o_orderdate",
        F.col("o_orderstatus").alias("estado"), F.col("o_orderpriority").alias("tipo_cuenta"),
    )
    states = prefix.versions(cuentas.withColumn("ultima_cuenta", F.col("cuenta_id")), "cliente_id", "o_orderdate", ["ultima_cuenta", "estado", "tipo_cuenta"])
    tx = stand_ins.lineitem_tx(spark, sf).select("transaccion_id", "cuenta_id", "timestamp_tx")
    owned = tx.join(cuentas.select("cuenta_id", "cliente_id"), "cuenta_id")
    return prefix.as_of(owned, states, "cliente_id", "timestamp_tx", "desde", ["desde", "ultima_cuenta", "estado", "tipo_cuenta"])


QUERIES: dict[str, Query] = {
    "bronze_scan": bronze_scan,
    "json_extract": json_extract,
    "filter_active": filter_active,
    "account_country": account_country,
    "filter_group_sum": filter_group_sum,
    "active_tx_semi": active_tx_semi,
    "tx_direction": tx_direction,
    "table_counts": table_counts,
    "key_format": key_format,
    "ts_arith": ts_arith,
    "tx_home_country": tx_home_country,
    "enrich_tx": enrich_tx,
    "never_moved": never_moved,
    "type_validation": type_validation,
    "silver_reconciliation": silver_reconciliation,
    "dedup_tx": dedup_tx,
    "quarantine_nulls": quarantine_nulls,
    "dq_not_null": dq_not_null,
    "dq_unique": dq_unique,
    "dq_relationships": dq_relationships,
    "dq_temporal": dq_temporal,
    "dq_inactive_account_tx": dq_inactive_account_tx,
    "dq_accepted_values": dq_accepted_values,
    "dq_pair_in_seed": dq_pair_in_seed,
    "dq_range_by_type": dq_range_by_type,
    "dq_conditional_null": dq_conditional_null,
    "weighted_choice": weighted_choice_query,
    "sample_n": sample_n,
    "null_inject": null_inject,
    "dup_inject": dup_inject,
    "assign_fk": assign_fk,
    "fan_out": fan_out,
    "foreign_candidates": foreign_candidates,
    "daily_tx": daily_tx,
    "daily_tx_by_client": daily_tx_by_client,
    "daily_tx_as_of": daily_tx_as_of,
    "velocity_hourly": velocity_hourly,
    "fraud_amount": fraud_amount,
    "fraud_burst": fraud_burst,
    "fraud_velocity": fraud_velocity,
    "fraud_burst_tx": fraud_burst_tx,
    "fraud_velocity_tx": fraud_velocity_tx,
    "fraud_travel_tx": fraud_travel_tx,
    "fraud_amount_rate": fraud_amount_rate,
    "fraud_geo": fraud_geo,
    "fraud_travel": fraud_travel,
    "fraud_score": fraud_score,
    "fraud_score_as_of": fraud_score_as_of,
    "fraud_top_clients": fraud_top_clients,
    "retention_by_volume": retention_by_volume,
    "dormant_accounts": dormant_accounts,
    "churn": churn,
    "segmentation": segmentation,
    "finance_monthly": finance_monthly,
    "client_features": client_features,
    "client_features_as_of": client_features_as_of,
    "monthly_clients_sketched": monthly_clients_sketched,
    "retention_sketched": retention_sketched,
    "activity_rollup": activity_rollup,
    "amount_quartiles": amount_quartiles,
    "dq_unique_bitmap": dq_unique_bitmap,
    "dq_relationships_bitmap": dq_relationships_bitmap,
    "fraud_amount_before": fraud_amount_before,
    "tx_state_as_of": tx_state_as_of,
}
