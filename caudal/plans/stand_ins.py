"""Test tables seen as the three banking tables.

Accounts are orders, their owners customers, transactions either lineitems (when
country and repeated keys matter), events (time of day) or orders (client level).
Money becomes DECIMAL(18,2): sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal import domain
from caudal.functions.hashing import weighted_choice
from caudal.functions.values import by_value
from caudal.schemas import MONEY


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with its declared schema (no job to look at file footers)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast(MONEY)


def country_of(spark: SparkSession, sf_dir: str, nation_key: str) -> Column:
    """Country name of a nation key, looked up in one map of the seed table.

    The world's nations are a fixed, short list. As a column the lookup adds no
    join, so the size of clients and suppliers stays known to the planner.
    """
    names = (
        table(spark, sf_dir, "nation")
        .agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))))
        .scalar()
    )
    return F.element_at(names, F.col(nation_key))


def clientes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cliente_id"),
        country_of(spark, sf_dir, "c_nationkey").alias("pais"),
        F.col("c_mktsegment").alias("segmento"),
    )


def cuentas(spark: SparkSession, sf_dir: str) -> DataFrame:
    estado = by_value(
        "o_orderstatus",
        {"O": F.lit("ACTIVA"), "F": F.lit("CERRADA")},
        F.lit("CONGELADA"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cuenta_id"),
        F.col("o_custkey").alias("cliente_id"),
        F.col("o_orderpriority").alias("tipo_cuenta"),
        weighted_choice("o_orderkey", "moneda", domain.MONEDAS).alias("moneda"),
        F.to_date("o_orderdate").alias("fecha_apertura"),
        estado.alias("estado"),
        money("o_totalprice").alias("saldo_inicial"),
    )


def lineitem_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without country; part and supplier make the id unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaccion_id"),
        F.col("l_orderkey").alias("cuenta_id"),
        F.col("l_shipdate").alias("timestamp_tx"),
        money("l_extendedprice").alias("monto"),
        F.col("l_returnflag").alias("tipo_tx"),
        F.col("l_suppkey").alias("_proveedor"),
    )


def lineitem_tx_abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the supplier's country as the place of the transaction."""
    place = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("_proveedor"),
        country_of(spark, sf_dir, "s_nationkey").alias("pais_tx"),
    )
    return lineitem_tx(spark, sf_dir).join(place, "_proveedor").drop("_proveedor")


def event_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaccion_id"),
        F.col("user_id").alias("cliente_id"),
        F.col("ts").alias("timestamp_tx"),
        money("value").alias("monto"),
        F.col("event_type").alias("tipo_tx"),
    )


def order_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaccion_id"),
        F.col("o_custkey").alias("cliente_id"),
        F.col("o_orderdate").alias("timestamp_tx"),
        money("o_totalprice").alias("monto"),
    )
