"""A small bank, written by hand: clean rows plus every defect the fixtures list."""

from __future__ import annotations

import csv
import os

from caudal import schemas


def cliente(n, pais="Guatemala", ciudad="Antigua", registro="2022-01-01", segmento="PERSONAL", **over):
    row = {
        "cliente_id": f"CLI{n:06d}",
        "nombre_completo": f'Ana "Nita" Pérez, {n}',
        "email": f"ana{n}@example.com",
        "telefono": "+502 5555 0000",
        "pais": pais,
        "ciudad": ciudad,
        "fecha_registro": f"{registro}T00:00:00.000000",
        "segmento": segmento,
        "fecha_nacimiento": "1990-05-05",
    }
    return {**row, **over}


def cuenta(n, duenio, moneda="GTQ", estado="ACTIVA", apertura="2022-02-01", tipo="AHORROS", **over):
    row = {
        "cuenta_id": f"ACC{n:08d}",
        "cliente_id": f"CLI{duenio:06d}",
        "tipo_cuenta": tipo,
        "moneda": moneda,
        "fecha_apertura": apertura,
        "estado": estado,
        "saldo_inicial": "1000.5",
    }
    return {**row, **over}


def tx(n, de, ts, monto="100.0", tipo="DEPOSITO", pais="Guatemala", ciudad="Antigua", **over):
    row = {
        "transaccion_id": f"TX{n:010d}",
        "cuenta_id": f"ACC{de:08d}",
        "timestamp_tx": f"{ts}.000000",
        "monto": monto,
        "tipo_tx": tipo,
        "comercio": "",
        "categoria_comercio": "",
        "pais_tx": pais,
        "ciudad_tx": ciudad,
        "canal": "APP",
    }
    return {**row, **over}


CLIENTES = [
    cliente(1),
    cliente(2, "México", "Monterrey", segmento="PREMIUM"),
    cliente(3, "Guatemala", "Cobán", registro="2022-03-01"),
    cliente(4, "México", "Miami"),  # wrong city
    cliente(5, fecha_nacimiento="1990-13-45"),  # bad date
]

CUENTAS = [
    cuenta(1, 1),
    cuenta(2, 1, moneda="USD"),
    cuenta(3, 2, tipo="CORRIENTE"),
    cuenta(4, 2, estado="CERRADA"),
    cuenta(5, 3),  # opened before its client registered, never moved
    cuenta(6, 99),  # owner unknown
]

TRANSACCIONES = [
    tx(1, 1, "2022-06-01T10:00:00", "100.0"),
    tx(1, 1, "2022-06-01T10:00:00", "100.0"),  # exact copy
    tx(2, 1, "2022-06-01T09:00:00", "50.0"),
    tx(2, 1, "2022-06-02T09:00:00", "70.0"),  # same id, later
    tx(3, 1, "2022-06-01T11:00:00", ""),  # no amount
    tx(4, 1, "2022-06-03T11:00:00", "abc"),  # bad number
    tx(5, 1, "2022-13-45T11:00:00", "10.0"),  # bad date
    tx(6, 77, "2022-06-01T11:00:00"),  # orphan
    tx(7, 4, "2022-06-05T11:00:00"),  # closed account
    tx(8, 3, "2022-01-15T08:00:00", "60.0"),  # before the account was opened
    tx(9, 1, "2022-06-04T08:00:00", "80.0", comercio="Shell", categoria_comercio="GASOLINERA"),
    tx(10, 2, "2022-06-01T10:30:00", "200.0"),  # other currency, same client
    tx(11, 3, "2022-07-01T10:00:00", "500.0", "PAGO_TARJETA", "Guatemala", "Cobán",
       comercio="Shell", categoria_comercio="GASOLINERA"),
    tx(12, 3, "2022-07-01T20:00:00", "9000.0", "COMPRA_ONLINE", "México", "Monterrey",
       comercio="Netflix", categoria_comercio="FARMACIA"),  # above the range, wrong category
    tx(13, 2, "2022-07-10T10:00:00", "300.0", "RETIRO"),
]


def write_raw(base: str) -> None:
    for name, rows in (
        ("clientes", CLIENTES), ("cuentas", CUENTAS), ("transacciones", TRANSACCIONES),
    ):
        folder = f"{base}/raw/{name}.csv"
        os.makedirs(folder)
        with open(f"{folder}/part-0.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, fieldnames=schemas.TABLES[name].names)
            out.writeheader()
            out.writerows(rows)
