"""Metrics on hand-made rows: boundaries, ties, nulls."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal.plans import activity, fraud

CLIENTES = [("c1", "Guatemala", "PERSONAL"), ("c2", "México", "PREMIUM")]


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def clientes(spark):
    return spark.createDataFrame(CLIENTES, "cliente_id string, pais string, segmento string")


def transactions(spark, data):
    """(client, account, instant, amount[, country[, currency]])"""
    rows = [
        (f"t{i}", c, a, at(ts), Decimal(m), *(rest + [None] * (2 - len(rest))))
        for i, (c, a, ts, m, *rest) in enumerate(data)
    ]
    return spark.createDataFrame(
        rows,
        "transaccion_id string, cliente_id string, cuenta_id string, timestamp_tx timestamp_ntz, "
        "monto decimal(18,2), pais_tx string, moneda string",
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_daily_counts_clients_once_and_keeps_currencies_apart(spark, clientes):
    tx = transactions(
        spark,
        [
            ("c1", "a1", "2022-06-01T10:00:00", "100", "Guatemala", "GTQ"),
            ("c1", "a1", "2022-06-01T23:59:59", "50", "Guatemala", "GTQ"),
            ("c1", "a2", "2022-06-01T12:00:00", "7", "Guatemala", "USD"),
            ("c2", "a3", "2022-06-02T00:00:00", "1", "México", "GTQ"),
        ],
    )
    assert rows(activity.daily(tx, clientes), "fecha", "pais", "segmento", "n_tx", "n_clientes") == [
        (dt.date(2022, 6, 1), "Guatemala", "PERSONAL", 3, 1),
        (dt.date(2022, 6, 2), "México", "PREMIUM", 1, 1),
    ]
    by_currency = activity.daily(tx, clientes, ("moneda",))
    assert rows(by_currency, "fecha", "moneda", "n_tx", "monto_total") == [
        (dt.date(2022, 6, 1), "GTQ", 2, Decimal("150.00")),
        (dt.date(2022, 6, 1), "USD", 1, Decimal("7.00")),
        (dt.date(2022, 6, 2), "GTQ", 1, Decimal("1.00")),
    ]
    assert activity.daily_by_client(tx, clientes).count() == 2


def test_dormant_boundary_and_never_moved(spark):
    cuentas = spark.createDataFrame(
        [(a, "c1", "CERRADA" if a == "closed" else "ACTIVA") for a in ("d29", "d30", "d31", "never", "closed")],
        "cuenta_id string, cliente_id string, estado string",
    )
    tx = transactions(
        spark,
        [
            ("c1", "d29", "2022-06-02T23:00:00", "1"),
            ("c1", "d30", "2022-06-01T23:00:00", "1"),
            ("c1", "d31", "2022-05-31T01:00:00", "1"),
            ("c1", "d31", "2022-07-09T00:00:00", "1"),  # after as_of: ignored
        ],
    )
    as_of = dt.date(2022, 7, 1)
    got = activity.dormant_accounts(cuentas, tx, as_of=as_of, states=("ACTIVA",))
    assert rows(got, "cuenta_id", "dias", "nunca") == [
        ("d30", 30, False), ("d31", 31, False), ("never", None, True),
    ]
    assert activity.dormant_accounts(cuentas, tx, as_of=as_of).count() == 4
    # The newest row is "today" where no date is given.
    newest = activity.dormant_accounts(cuentas, tx, states=("ACTIVA",))
    assert rows(newest, "cuenta_id", "dias") == [("d29", 37), ("d30", 38), ("never", None)]


def test_churn_counts_all_accounts_and_ignores_later_rows(spark):
    tx = transactions(
        spark,
        [
            ("gone", "a", "2022-01-01T00:00:00", "1"),
            ("gone", "a", "2022-12-01T00:00:00", "1"),
            ("stays", "b", "2022-01-01T00:00:00", "1"),
            ("stays", "b2", "2022-04-02T00:00:00", "1"),
            ("later", "d", "2022-12-01T00:00:00", "1"),
        ],
    )
    got = activity.churn(tx, 90, dt.date(2022, 4, 1))
    assert rows(got, "cliente_id", "dias", "churn") == [("gone", 90, True), ("stays", 90, True)]
    got = activity.churn(tx, 90, dt.date(2022, 4, 2))
    assert rows(got, "cliente_id", "churn") == [("gone", True), ("stays", False)]


def test_retention_drops_the_last_month_and_sees_gaps(spark):
    data = [("p", m, a) for m, a in ((1, 10), (2, 10), (4, 10))]
    data += [("q", 1, 20), ("r", 1, 30), ("r", 2, 5), ("s", 1, 40), ("s", 1, 1), ("t", 4, 1)]
    tx = transactions(spark, [(c, "a", f"2022-0{m}-15T00:00:00", str(v)) for c, m, v in data])
    got = rows(activity.retention_by_volume(tx), "mes", "banda", "n_clientes", "n_retenidos", "tasa")
    jan, feb = dt.date(2022, 1, 1), dt.date(2022, 2, 1)
    assert got == [
        (jan, 1, 1, 1, 1.0), (jan, 2, 1, 0, 0.0), (jan, 3, 1, 1, 1.0), (jan, 4, 1, 0, 0.0),
        (feb, 1, 1, 0, 0.0), (feb, 4, 1, 0, 0.0),
    ]


def test_currencies_are_never_mixed(spark):
    """Small USD amounts next to large GTQ ones of the same client."""
    data = [("c1", "g", f"2022-01-{d:02d}T00:00:00", "1000", None, "GTQ") for d in range(1, 12)]
    data += [("c1", "u", f"2022-01-{d:02d}T00:10:00", "1", None, "USD") for d in range(1, 12)]
    data += [("c1", "u", "2022-01-12T00:00:00", "90", None, "USD")]
    data += [("c2", "x", "2022-01-12T00:00:00", "2000", None, "GTQ")]
    data += [("c2", "x", "2022-02-12T00:00:00", "2000", None, "USD")]
    tx = transactions(spark, data)
    flagged = fraud.unusual_amounts(tx, currency="moneda")
    assert rows(flagged, "moneda", "monto") == [("USD", Decimal("90.00"))]
    assert dict(rows(fraud.amount_rate(tx, currency="moneda"), "cliente_id", "tasa_monto")) == {
        "c1": pytest.approx(1 / 23), "c2": 0.0,
    }
    assert fraud.bursts(tx, currency="moneda").count() == 0
    assert fraud.bursts(tx).count() == 11
    assert rows(activity.retention_by_volume(tx, "moneda"), "moneda", "banda", "n_clientes", "n_retenidos") == [
        ("GTQ", 1, 1, 1), ("GTQ", 4, 1, 0), ("USD", 1, 1, 0),
    ]
    got = {r["cliente_id"]: r for r in activity.segmentation(tx, currency="moneda").collect()}
    assert [(m["moneda"], m["monto"]) for m in got["c1"]["montos"]] == [
        ("GTQ", Decimal("11000.00")), ("USD", Decimal("101.00")),
    ]
    assert (got["c1"]["m"], got["c2"]["m"], got["c1"]["frecuencia"]) == (4, 4, 23)


def test_segmentation_bands(spark):
    data = []
    for i in range(1, 9):
        data += [(f"c{i}", "a", f"2022-01-{day:02d}T00:00:00", str(i * 10)) for day in range(1, i + 1)]
    got = {r["cliente_id"]: r for r in activity.segmentation(transactions(spark, data)).collect()}
    assert [got[f"c{i}"]["r"] for i in range(1, 9)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert [got[f"c{i}"]["f"] for i in range(1, 9)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert got["c8"]["segmento_rfm"] == 444 and got["c1"]["segmento_rfm"] == 111
    assert got["c8"]["recencia"] == 0 and got["c1"]["recencia"] == 7


def test_amount_flags(spark):
    data = [("usual", "a", f"2022-01-{d:02d}T00:00:00", "100") for d in range(1, 20)]
    data += [("usual", "a", "2022-01-20T00:00:00", "9999")]
    data += [("single", "b", "2022-01-01T00:00:00", "5")]
    data += [("equal", "d", f"2022-01-{d:02d}T00:00:00", "0.10") for d in range(1, 9)]
    tx = transactions(spark, data)
    assert rows(fraud.unusual_amounts(tx), "cliente_id", "monto") == [("usual", Decimal("9999.00"))]
    assert rows(fraud.amount_rate(tx), "cliente_id", "tasa_monto") == [
        ("equal", 0.0), ("single", 0.0), ("usual", 0.05),
    ]


def test_the_rate_agrees_with_the_flags_for_large_amounts(spark):
    data = [("c", "a", f"2022-01-{d:02d}T00:00:00", f"9000000{'00' if d % 2 else '01'}.00") for d in range(1, 31)]
    data += [("c", "a", "2022-01-31T00:00:00", "900000005.00")]
    tx = transactions(spark, data)
    assert fraud.unusual_amounts(tx).count() == 1
    assert rows(fraud.amount_rate(tx), "tasa_monto") == [(pytest.approx(1 / 31),)]


def test_bursts_and_frequency(spark):
    tx = transactions(
        spark,
        [
            ("c1", "a", "2022-01-01T00:00:00", "1"),
            ("c1", "b", "2022-01-01T01:00:00", "2"),
            ("c1", "a", "2022-01-01T01:00:01", "4"),
            ("c1", "a", "2022-01-01T01:30:00", "8"),
            ("c2", "d", "2022-01-01T01:30:00", "8"),
        ],
    )
    assert rows(fraud.bursts(tx), "timestamp_tx", "n_ventana", "suma_ventana") == [
        (at("2022-01-01T01:00:00"), 2, Decimal("3.00")),
        (at("2022-01-01T01:00:01"), 2, Decimal("6.00")),
        (at("2022-01-01T01:30:00"), 3, Decimal("14.00")),
    ]
    assert rows(fraud.fast_sequences(tx), "cliente_id", "n_ventana") == [("c1", 3)]
    assert rows(fraud.velocity_rate(tx), "cliente_id", "tasa_frecuencia") == [("c1", 0.25), ("c2", 0.0)]


def test_foreign_share_and_travel(spark):
    owners = spark.createDataFrame(
        [("a", "c1", "Guatemala"), ("b", "c1", "Guatemala")], "cuenta_id string, cliente_id string, pais string"
    )
    tx = transactions(
        spark,
        [
            ("c1", "a", "2022-01-01T10:00:00", "1", "Guatemala"),
            ("c1", "a", "2022-01-02T10:00:00", "1", "México"),  # exactly a day later
            ("c1", "a", "2022-01-03T10:00:01", "1", "Guatemala"),  # a second too late
            ("c1", "a", "2022-01-03T11:00:00", "1", "Guatemala"),
            ("c1", "b", "2022-01-03T11:30:00", "1", "México"),  # another account
        ],
    )
    assert rows(fraud.foreign_share(tx, owners), "cliente_id", "n_tx", "n_fuera", "proporcion_fuera") == [
        ("c1", 5, 2, 0.4)
    ]
    assert rows(fraud.impossible_travel(tx), "cuenta_id", "timestamp_tx", "pais_tx", "pais_tx_previo") == [
        ("a", at("2022-01-02T10:00:00"), "México", "Guatemala")
    ]


def test_score_of_clients_without_signals_is_zero(spark, clientes):
    def one(columns, *values):
        return spark.createDataFrame([("c1", *values)], f"cliente_id string, {columns}")

    scored = fraud.score(
        clientes,
        one("tasa_monto double", 0.5),
        one("n_tx bigint, n_fuera bigint", 4, 1),
        one("tasa_frecuencia double", 0.1),
    )
    assert rows(scored, "cliente_id", "score") == [("c1", 0.305), ("c2", 0.0)]
    assert [r["cliente_id"] for r in fraud.top_clients(scored, 1).collect()] == ["c1"]


def test_finance_keeps_currencies_and_directions_apart(spark):
    cuentas = spark.createDataFrame(
        [("a", "GTQ", "AHORROS"), ("b", "USD", "AHORROS")], "cuenta_id string, moneda string, tipo_cuenta string"
    )
    tx = transactions(
        spark,
        [
            ("c1", "a", "2022-01-01T10:00:00", "100"),
            ("c1", "a", "2022-01-31T10:00:00", "30"),
            ("c1", "b", "2022-01-31T10:00:00", "5"),
        ],
    ).drop("moneda").withColumn(
        "tipo_tx", F.when(F.col("monto") == 30, "RETIRO").otherwise("DEPOSITO")
    )
    got = activity.finance_monthly(tx, cuentas)
    assert rows(got, "moneda", "n_tx", "entradas", "salidas", "neto") == [
        ("GTQ", 2, Decimal("100.00"), Decimal("30.00"), Decimal("70.00")),
        ("USD", 1, Decimal("5.00"), Decimal("0.00"), Decimal("5.00")),
    ]
