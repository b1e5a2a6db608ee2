"""Silver: typed, de-duplicated, enriched; rows set aside keep their reason."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal import domain, schemas
from caudal.operators import prefix, quality
from caudal.operators.dedup import latest_by_key
from caudal.sources.bronze import INGESTED_AT
from caudal.sources.raw import CORRUPT


@dataclass(frozen=True)
class Cleaned:
    """Good rows, the typed rows they come from, all rows checked, and the rows set aside.

    The quarantine has rows in text form with their reasons and how often they came
    (``n_filas``); ``counts`` says where every row received went.
    """

    good: DataFrame
    typed: DataFrame
    checked: DataFrame
    quarantine: DataFrame
    counts: DataFrame


def type_check(raw: DataFrame, table: str) -> DataFrame:
    """Typed columns plus ``motivos``; a line the reader could not split is a reason too."""
    schema = schemas.TABLES[table]
    checked = quality.validate_types(raw, schema, schemas.REQUIRED[table])
    if CORRUPT in raw.columns:
        checked = checked.withColumn(
            quality.REASONS,
            F.when(
                F.col(CORRUPT).isNotNull(),
                F.array_append(quality.REASONS, F.lit("linea:ilegible")),
            ).otherwise(F.col(quality.REASONS)),
        )
    return checked


def clean(raw: DataFrame, table: str, store: Callable[[DataFrame], DataFrame] = lambda checked: checked) -> Cleaned:
    """Types checked, bad rows set aside, repeated keys reduced to one row.

    ``store`` writes the checked rows (typed columns, reasons, and the text of bad rows)
    and reads them again: then bronze is checked once, whatever is taken from it. Good
    rows are shuffled once, by their key, where copies collapse too; only the few bad
    rows are grouped as a whole.
    """
    schema = schemas.TABLES[table]
    columns = [c for c in raw.columns if c in schema.names or c == CORRUPT]
    checked = type_check(raw.withColumn("_texto", F.to_json(F.struct(*columns))), table)
    text = F.when(F.size(quality.REASONS) > 0, F.col("_texto")).alias("_texto")
    stamps = [c for c in (INGESTED_AT,) if c in raw.columns]
    checked = store(checked.select(*schema.names, *stamps, text, quality.REASONS))
    typed = quality.accepted(checked).select(*schema.names)
    bad = quality.rejected(checked).select(
        F.lit(table).alias("tabla"), F.col("_texto").alias("fila"), quality.REASONS
    )
    good = dedup(typed, table)
    return Cleaned(good, typed, checked, with_copies(bad), reconciliation(checked, good, table))


def with_copies(bad: DataFrame) -> DataFrame:
    """Equal rows once, with their number."""
    return bad.groupBy(*bad.columns).agg(F.count(F.lit(1)).alias("n_filas"))


def reconciliation(checked: DataFrame, good: DataFrame, table: str) -> DataFrame:
    """(tabla, destino, n_filas): received, accepted, copies, and a row for each set of reasons.

    Received rows are the sum of the others.
    """
    reasons = checked.groupBy(F.array_join(quality.REASONS, ",").alias("destino")).agg(
        F.count(F.lit(1)).alias("n_filas")
    )
    accepted = good.agg(F.count(F.lit(1))).scalar()
    sums = reasons.agg(
        F.coalesce(F.sum("n_filas"), F.lit(0)).alias("todas"),
        F.coalesce(F.sum(F.when(F.col("destino") == "", F.col("n_filas"))), F.lit(0)).alias("tipadas"),
    )
    parts = {"recibidas": F.col("todas"), "aceptadas": accepted, "copias": F.col("tipadas") - accepted}
    summary = sums.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("destino"), v.alias("n_filas")) for k, v in parts.items()])
        ).alias("_r")
    ).select("_r.*")
    return summary.unionByName(reasons.filter("destino <> ''")).select(
        F.lit(table).alias("tabla"), "destino", "n_filas"
    )


def dedup(typed: DataFrame, table: str) -> DataFrame:
    key, newest = {
        "clientes": ("cliente_id", ["fecha_registro"]),
        "cuentas": ("cuenta_id", ["fecha_apertura"]),
        "transacciones": ("transaccion_id", ["timestamp_tx"]),
    }[table]
    return latest_by_key(typed, [key], newest)


def null_amounts(tx: DataFrame) -> DataFrame:
    """Transactions without an amount; gold leaves them out."""
    return tx.filter(F.col("monto").isNull())


def with_amount(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("monto").isNotNull())


def account_owner(cuentas: DataFrame, clientes: DataFrame) -> DataFrame:
    """One row per account with its owner's country and segment."""
    return cuentas.join(clientes.select("cliente_id", "pais", "segmento"), "cliente_id")


def enrich(tx: DataFrame, cuentas: DataFrame, clientes: DataFrame) -> DataFrame:
    """Transactions with account and client columns.

    Accounts and clients meet first (one row per account), so the large side is
    shuffled once; both sides of that join are shuffles of their own, which lets
    adaptive execution split a hot account.
    """
    owners = account_owner(cuentas, clientes).select(
        "cuenta_id", "cliente_id", "tipo_cuenta", "moneda", "estado", "pais", "segmento"
    )
    return tx.join(owners, "cuenta_id")


def without_owner(tx: DataFrame, cuentas: DataFrame, clientes: DataFrame) -> DataFrame:
    """The transactions that ``enrich`` leaves out: unknown account, or unknown client of it."""
    return tx.join(account_owner(cuentas, clientes).select("cuenta_id"), "cuenta_id", "left_anti")


def set_aside(rows: DataFrame, table: str, reason: str) -> DataFrame:
    """Typed rows in the shape of the quarantine."""
    return rows.select(
        F.lit(table).alias("tabla"),
        F.to_json(F.struct(*rows.columns)).alias("fila"),
        F.array(F.lit(reason)).alias(quality.REASONS),
        F.lit(1).cast("bigint").alias("n_filas"),
    )


# --- rules per table --------------------------------------------------------

def _expected(table: str) -> dict:
    return {f"not_null:{table}.{c}": quality.is_missing(c) for c in schemas.EXPECTED[table]}


def client_rules() -> dict:
    prefix, digits = domain.FORMATO_CLIENTE
    return {
        **_expected("clientes"),
        "key_pattern:clientes.cliente_id": quality.bad_key("cliente_id", prefix, digits),
        "accepted:clientes.pais": quality.not_in("pais", list(domain.PAISES)),
        "accepted:clientes.segmento": quality.not_in("segmento", list(domain.SEGMENTOS)),
    }


def account_rules() -> dict:
    prefix, digits = domain.FORMATO_CUENTA
    return {
        **_expected("cuentas"),
        "key_pattern:cuentas.cuenta_id": quality.bad_key("cuenta_id", prefix, digits),
        "accepted:cuentas.tipo_cuenta": quality.not_in("tipo_cuenta", list(domain.TIPOS_CUENTA)),
        "accepted:cuentas.moneda": quality.not_in("moneda", list(domain.MONEDAS)),
        "accepted:cuentas.estado": quality.not_in("estado", list(domain.ESTADOS)),
    }


def transaction_rules() -> dict:
    prefix, digits = domain.FORMATO_TRANSACCION
    return {
        **_expected("transacciones"),
        "key_pattern:transacciones.transaccion_id": quality.bad_key("transaccion_id", prefix, digits),
        "accepted:transacciones.tipo_tx": quality.not_in("tipo_tx", list(domain.TIPOS_TX)),
        "accepted:transacciones.canal": quality.not_in("canal", list(domain.CANALES)),
        "accepted:transacciones.pais_tx": quality.not_in("pais_tx", list(domain.PAISES)),
        "accepted:transacciones.categoria_comercio": quality.not_in(
            "categoria_comercio", list(domain.COMERCIOS)
        ),
        "range:transacciones.monto": quality.outside_range("monto", "tipo_tx", domain.RANGOS_MONTO),
        "conditional_null:transacciones.comercio": quality.presence_breaks_rule(
            "comercio", "tipo_tx", domain.TIPOS_CON_COMERCIO
        ),
        "conditional_null:transacciones.categoria_comercio": quality.presence_breaks_rule(
            "categoria_comercio", "tipo_tx", domain.TIPOS_CON_COMERCIO
        ),
    }


def before_opening(tx: DataFrame, cuentas: DataFrame, check: str) -> DataFrame:
    """Transactions dated before their account was opened.

    Counted per account and day first: a hot account shrinks to its days.
    """
    days = tx.groupBy("cuenta_id", F.to_date("timestamp_tx").alias("dia")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    dated = days.join(cuentas.select("cuenta_id", "fecha_apertura"), "cuenta_id", "left")
    return quality.count_failures(dated, {check: quality.earlier_than("dia", "fecha_apertura")}, "_w")


def opened_before_registration(cuentas: DataFrame, clientes: DataFrame, check: str) -> DataFrame:
    """Accounts opened before their client was registered."""
    days = cuentas.groupBy("cliente_id", "fecha_apertura").agg(F.count(F.lit(1)).alias("_w"))
    dated = days.join(clientes.select("cliente_id", "fecha_registro"), "cliente_id", "left")
    return quality.count_failures(
        dated, {check: quality.earlier_than("fecha_apertura", "fecha_registro")}, "_w"
    )


def on_inactive_account(tx: DataFrame, cuentas: DataFrame, check: str) -> DataFrame:
    """Transactions on an account that is not active."""
    per_account = tx.groupBy("cuenta_id").agg(F.count(F.lit(1)).alias("_w"))
    stated = per_account.join(cuentas.select("cuenta_id", "estado"), "cuenta_id", "left")
    return quality.count_failures(stated, {check: quality.not_in("estado", ["ACTIVA"])}, "_w")


def account_versions(checked: DataFrame) -> DataFrame:
    """What the deliveries said of each account, and from when to when: ``desde`` to ``hasta``.

    From checked rows that carry the time of their delivery. A delivery that repeats an
    account as it was begins no version; an account that a delivery leaves out stays as
    it was.
    """
    state = [c for c in schemas.TABLES["cuentas"].names if c != "cuenta_id"]
    good = quality.accepted(checked).withColumn(INGESTED_AT, F.col(INGESTED_AT).cast("timestamp_ntz"))
    return prefix.versions(good, "cuenta_id", INGESTED_AT, state)


def with_state_then(tx: DataFrame, versions: DataFrame) -> DataFrame:
    """Transactions with their account's state as it was known when they happened (``estado_entonces``).

    Null before the first delivery that knows the account.
    """
    known = versions.select("cuenta_id", "desde", F.col("estado").alias("estado_entonces"))
    return prefix.as_of(tx, known, "cuenta_id", "timestamp_tx", "desde", ["estado_entonces"])


def on_account_inactive_then(tx: DataFrame, versions: DataFrame, check: str) -> DataFrame:
    """Transactions on an account that was known not to be active when they happened.

    Unlike the check against today's state, an account closed later does not fail its
    earlier transactions, and one opened again does not hide those in between.
    """
    stated = with_state_then(tx.select("cuenta_id", "timestamp_tx"), versions)
    return quality.count_failures(stated, {check: quality.not_in("estado_entonces", ["ACTIVA"])})


def against_accounts(tx: DataFrame, cuentas: DataFrame) -> DataFrame:
    """Rules of transactions against their account, from one count per account and day."""
    days = tx.select("cuenta_id", F.to_date("timestamp_tx").alias("dia"))
    accounts = cuentas.select("cuenta_id", "fecha_apertura", "estado")
    return quality.count_against(
        days,
        ["cuenta_id", "dia"],
        [(accounts, ["cuenta_id"], "_hay")],
        {
            "relationship:transacciones.cuenta_id": quality.lost(["cuenta_id"], "_hay"),
            "temporal:transacciones.antes_de_apertura": quality.earlier_than("dia", "fecha_apertura"),
            "inactive_account:transacciones": quality.not_in("estado", ["ACTIVA"]),
        },
    )


def against_clients(cuentas: DataFrame, clientes: DataFrame) -> DataFrame:
    """Rules of accounts against their client, from one count per client and day."""
    return quality.count_against(
        cuentas,
        ["cliente_id", "fecha_apertura"],
        [(clientes.select("cliente_id", "fecha_registro"), ["cliente_id"], "_hay")],
        {
            "relationship:cuentas.cliente_id": quality.lost(["cliente_id"], "_hay"),
            "temporal:cuentas.antes_de_registro": quality.earlier_than("fecha_apertura", "fecha_registro"),
        },
    )


def against_seeds(tx: DataFrame, ciudades: DataFrame, comercios: DataFrame) -> DataFrame:
    """Both pairs of a transaction, from one count per combination."""
    place, shop = ["pais_tx", "ciudad_tx"], ["categoria_comercio", "comercio"]
    cities = ciudades.withColumnsRenamed({"pais": "pais_tx", "ciudad": "ciudad_tx"}).select(*place)
    return quality.count_against(
        tx,
        [*place, *shop],
        [(cities, place, "_lugar"), (comercios.select(*shop), shop, "_comercio")],
        {
            "pair:transacciones.pais_ciudad": quality.lost(place, "_lugar"),
            "pair:transacciones.categoria_comercio": quality.lost(shop, "_comercio"),
        },
    )


def unique_keys(typed: Mapping[str, DataFrame]) -> DataFrame:
    """Repeated keys among the rows as they came, before copies are removed."""
    keys = {"clientes": "cliente_id", "cuentas": "cuenta_id", "transacciones": "transaccion_id"}
    parts = [quality.count_repeated(typed[t], [k], f"unique:{t}.{k}") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def broken_rules(clientes: DataFrame, cuentas: DataFrame, tx: DataFrame) -> DataFrame:
    """Rows of silver that break a rule over their own columns, in text form; they stay in silver."""
    tables = (("clientes", clientes, client_rules()), ("cuentas", cuentas, account_rules()), ("transacciones", tx, transaction_rules()))
    parts = [
        quality.failing_rows(rows, rules).select(
            F.lit(name).alias("tabla"), F.to_json(F.struct(*rows.columns)).alias("fila"), "reglas"
        )
        for name, rows, rules in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_report(
    clientes: DataFrame, cuentas: DataFrame, tx: DataFrame, ciudades: DataFrame, comercios: DataFrame
) -> DataFrame:
    """(check, n_rows, n_failed) of every rule over typed tables; transactions are read three times."""
    parts = [
        quality.count_failures(clientes, client_rules()),
        quality.count_failures(cuentas, account_rules()),
        quality.count_failures(tx, transaction_rules()),
        quality.count_pairs_outside(clientes, ["pais", "ciudad"], ciudades, "pair:clientes.pais_ciudad"),
        against_accounts(tx, cuentas),
        against_clients(cuentas, clientes),
        against_seeds(tx, ciudades, comercios),
    ]
    return reduce(DataFrame.unionByName, parts)
