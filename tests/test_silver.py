"""Cleaning and quality rules on the hand-made bank."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from bank import CLIENTES, CUENTAS, TRANSACCIONES, write_raw
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import domain, schemas
from caudal.operators import quality
from caudal.plans import silver
from caudal.sources import bronze, jdbc, raw, seeds

DAY = dt.datetime(2025, 1, 1, 6)


def frame(spark, name, data):
    """Raw text rows; an empty text is null, as the CSV reader gives it."""
    schema = schemas.as_text(schemas.TABLES[name])
    return spark.createDataFrame([[r[c] or None for c in schema.names] for r in data], schema)


@pytest.fixture(scope="module")
def bank(spark):
    return {
        "clientes": silver.clean(frame(spark, "clientes", CLIENTES), "clientes"),
        "cuentas": silver.clean(frame(spark, "cuentas", CUENTAS), "cuentas"),
        "transacciones": silver.clean(frame(spark, "transacciones", TRANSACCIONES), "transacciones"),
    }


def test_types_are_checked_and_nothing_raises(bank):
    good, bad = bank["transacciones"].good, bank["transacciones"].quarantine
    assert good.schema == schemas.TRANSACCIONES
    reasons = {
        json.loads(r["fila"])["transaccion_id"]: r["motivos"] for r in bad.collect()
    }
    assert reasons == {"TX0000000004": ["tipo:monto"], "TX0000000005": ["tipo:timestamp_tx"]}
    assert good.count() == 11
    assert [r["motivos"] for r in bank["clientes"].quarantine.collect()] == [["tipo:fecha_nacimiento"]]
    assert bank["clientes"].good.count() == 4


def test_copies_collapse_and_the_latest_is_kept(bank):
    got = {r["transaccion_id"]: r for r in bank["transacciones"].good.collect()}
    assert got["TX0000000001"]["monto"] == Decimal("100.00")
    assert got["TX0000000002"]["timestamp_tx"] == dt.datetime(2022, 6, 2, 9)
    assert got["TX0000000003"]["monto"] is None
    assert [r["transaccion_id"] for r in silver.null_amounts(bank["transacciones"].good).collect()] == [
        "TX0000000003"
    ]


def test_transactions_with_an_amount(bank):
    assert silver.with_amount(bank["transacciones"].good).count() == 10


def test_every_row_received_is_accounted_for(bank):
    for table, received in (("clientes", 5), ("cuentas", 6), ("transacciones", 15)):
        counts = {r["destino"]: r["n_filas"] for r in bank[table].counts.collect()}
        assert counts.pop("recibidas") == sum(counts.values()) == received
    assert counts == {"aceptadas": 11, "copias": 2, "tipo:monto": 1, "tipo:timestamp_tx": 1}


def test_equal_bad_rows_are_counted(spark):
    bad = frame(spark, "transacciones", [TRANSACCIONES[5]] * 3)
    rows = silver.clean(bad, "transacciones").quarantine.collect()
    assert [(r["n_filas"], r["motivos"]) for r in rows] == [(3, ["tipo:monto"])]


def test_a_client_without_mail_keeps_their_transactions(spark, bank):
    clientes = [{**c, "email": ""} if c["cliente_id"] == "CLI000001" else c for c in CLIENTES]
    cleaned = silver.clean(frame(spark, "clientes", clientes), "clientes")
    tx, cuentas = bank["transacciones"].good, bank["cuentas"].good
    assert silver.enrich(tx, cuentas, cleaned.good).count() == silver.enrich(tx, cuentas, bank["clientes"].good).count()
    missing = quality.count_failures(cleaned.good, silver.client_rules()).filter("check = 'not_null:clientes.email'")
    assert missing.first()["n_failed"] == 1


def test_rows_without_an_owner(bank):
    lost = silver.without_owner(bank["transacciones"].good, bank["cuentas"].good, bank["clientes"].good)
    assert [r["transaccion_id"] for r in lost.collect()] == ["TX0000000006"]


def test_types_are_strict(spark):
    schema = T.StructType([T.StructField("m", schemas.MONEY), T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType())])
    data = [("10.005", "2022", "2022-01"), ("10.100", "2022-01-02T00:00:00.000000", "2022-01-02"), ("1e2", "2022-1-2", "2022-01-02T03:04")]
    got = quality.validate_types(spark.createDataFrame(data, "m string, d string, t string"), schema).collect()
    assert [r["motivos"] for r in got] == [["tipo:m", "tipo:d", "tipo:t"], [], ["tipo:d"]]
    assert got[1]["m"] == Decimal("10.10") and got[2]["m"] == Decimal("100.00")


def test_quality_report(spark, bank):
    report = silver.quality_report(
        bank["clientes"].good, bank["cuentas"].good, bank["transacciones"].good,
        seeds.pais_ciudad(spark), seeds.categoria_comercio(spark),
    )
    rows = {r["check"]: (r["n_rows"], r["n_failed"]) for r in report.collect()}
    failed = {k: v[1] for k, v in rows.items() if v[1]}
    assert failed == {
        "not_null:transacciones.monto": 1,
        "range:transacciones.monto": 1,
        "conditional_null:transacciones.comercio": 1,
        "conditional_null:transacciones.categoria_comercio": 1,
        "relationship:cuentas.cliente_id": 1,
        "relationship:transacciones.cuenta_id": 1,
        "pair:clientes.pais_ciudad": 1,
        "pair:transacciones.categoria_comercio": 1,
        "temporal:transacciones.antes_de_apertura": 1,
        "temporal:cuentas.antes_de_registro": 1,
        "inactive_account:transacciones": 1,
    }
    unique = silver.unique_keys({t: c.typed for t, c in bank.items()})
    counted = {r["check"]: (r["n_rows"], r["n_failed"]) for r in unique.collect()}
    assert counted["unique:transacciones.transaccion_id"] == (13, 2)
    assert counted["unique:clientes.cliente_id"] == (4, 0)
    assert rows["relationship:transacciones.cuenta_id"] == (11, 1)
    assert len(rows) == report.count()


def test_rows_that_break_rules(bank):
    failing = quality.failing_rows(bank["transacciones"].good, silver.transaction_rules()).collect()
    broken = {r["transaccion_id"][-2:]: r["reglas"] for r in failing}
    assert broken["12"] == ["range:transacciones.monto"]
    assert set(broken) == {"03", "09", "12"}


def test_checks_above_their_limit(spark):
    report = spark.createDataFrame([("a", 100, 5), ("b", 100, 5), ("c", 0, 0)], "check string, n_rows long, n_failed long")
    assert [r["check"] for r in quality.exceeding(report, {"a": 0.04, "b": 0.05, "c": 0.0}).collect()] == ["a"]


def test_rules_over_an_empty_table(spark):
    empty = spark.createDataFrame([], schemas.TRANSACCIONES)
    rows = quality.count_failures(empty, silver.transaction_rules()).collect()
    assert {(r["n_rows"], r["n_failed"]) for r in rows} == {(0, 0)}
    assert quality.count_repeated(empty, ["transaccion_id"], "u").collect()[0]["n_failed"] == 0
    assert quality.count_orphans(empty, "cuenta_id", empty, "o").collect()[0]["n_failed"] == 0


def test_unique_counts_rows_beyond_the_first(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    assert [(r["k"], r["n_rows"]) for r in quality.repeated_keys(df, ["k"]).collect()] == [(1, 3)]
    assert quality.count_repeated(df, ["k"], "u").collect()[0]["n_failed"] == 2


def test_enriched_rows_carry_the_owner(bank):
    enriched = silver.enrich(
        bank["transacciones"].good, bank["cuentas"].good, bank["clientes"].good
    )
    row = enriched.filter("transaccion_id = 'TX0000000011'").collect()[0]
    assert (row["cliente_id"], row["pais"], row["segmento"], row["moneda"]) == (
        "CLI000002", "México", "PREMIUM", "GTQ",
    )
    assert enriched.filter("transaccion_id = 'TX0000000006'").count() == 0


def test_blank_and_padded_texts(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType())])
    df = spark.createDataFrame([(" 7 ", "2022-01-02"), ("", None), ("1e", "x")], "n string, d string")
    got = quality.validate_types(df, schema, required=("n",)).collect()
    assert [(r["n"], r["d"], r["motivos"]) for r in got] == [
        (7, dt.date(2022, 1, 2), []),
        (None, None, ["nulo:n"]),
        (None, None, ["tipo:n", "tipo:d"]),
    ]


# --- sources ---------------------------------------------------------------------

def test_raw_to_bronze_and_back(spark, tmp_path):
    write_raw(str(tmp_path))
    rows = raw.read_csv(spark, f"{tmp_path}/raw/clientes.csv", schemas.CLIENTES)
    first = rows.filter("cliente_id = 'CLI000001'").collect()[0]
    assert first["nombre_completo"] == 'Ana "Nita" Pérez, 1'
    path = f"{tmp_path}/bronze/clientes"
    for _ in range(2):  # ingesting a day again replaces it
        bronze.write_bronze(bronze.to_bronze(rows, DAY), path)
    bronze.write_bronze(bronze.to_bronze(rows, DAY + dt.timedelta(days=1)), path)
    stored = bronze.read_bronze(spark, path)
    assert stored.count() == 10
    assert stored.select("ingest_date").distinct().count() == 2
    assert stored.select("_source_file").distinct().collect()[0][0].endswith("part-0.csv")
    received = bronze.payload(stored.filter(F.col("ingest_date") == DAY.date()))
    assert received.exceptAll(rows).count() == 0 and rows.exceptAll(received).count() == 0
    assert {kind for _, kind in received.dtypes} == {"string"}


def test_unreadable_lines_are_kept_with_a_reason(spark, tmp_path):
    path = tmp_path / "c.csv"
    header = ",".join(schemas.CUENTAS.names)
    path.write_text(f"{header}\nACC00000001,CLI000001,AHORROS,GTQ,2022-01-01,ACTIVA,10.0\nACC2,broken\n")
    cleaned = silver.clean(raw.read_csv(spark, str(path), schemas.CUENTAS), "cuentas")
    assert cleaned.good.count() == 1
    bad = cleaned.quarantine.collect()
    assert len(bad) == 1 and "linea:ilegible" in bad[0]["motivos"] and "ACC2,broken" in bad[0]["fila"]


def test_a_header_in_another_order_is_an_error(spark, tmp_path):
    path = tmp_path / "c.csv"
    names = schemas.CUENTAS.names
    path.write_text(",".join([names[1], names[0], *names[2:]]) + "\nCLI000001,ACC00000001,AHORROS,GTQ,2022-01-01,ACTIVA,10.0\n")
    with pytest.raises(Exception, match="header"):
        raw.read_csv(spark, str(path), schemas.CUENTAS).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("CLI1", 'coma, comilla " y ñ', None), ("CLI2", "", "x")], "a string, b string, c string"
    )
    schema = df.schema
    raw.write_csv(df, f"{tmp_path}/out")
    back = raw.read_csv(spark, f"{tmp_path}/out", schema).drop("_corrupt")
    assert sorted(tuple(r) for r in back.collect()) == [
        ("CLI1", 'coma, comilla " y ñ', None), ("CLI2", None, "x"),
    ]


def test_json_lines_as_text(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"cuenta_id": "ACC1", "saldo_inicial": 10.5}\n{broken\n')
    df = raw.read_json(spark, str(path), schemas.CUENTAS)
    got = {r["cuenta_id"]: (r["saldo_inicial"], r["_corrupt"]) for r in df.collect()}
    assert got == {"ACC1": ("10.5", None), None: (None, "{broken")}


def test_json_column(spark):
    df = spark.createDataFrame([('{"k": 5}',), ("nope",), (None,)], "p string")
    fields = raw.json_fields("p", T.StructType([T.StructField("k", T.LongType())]))
    assert [r["k"] for r in df.select(*fields).collect()] == [5, None, None]


def test_jdbc_options():
    options = jdbc.jdbc_options(
        jdbc.postgres_url("db", 5432, "bank"), "gold.churn", "user", "secret", connections=4
    )
    assert options["url"] == "jdbc:postgresql://db:5432/bank"
    assert options["numPartitions"] == "4" and options["truncate"] == "true"


def test_seeds_and_domain(spark):
    assert seeds.pais_ciudad(spark).count() == 17
    assert seeds.categoria_comercio(spark).count() == 23
    assert set(domain.RANGOS_MONTO) == set(domain.TIPOS_TX)
