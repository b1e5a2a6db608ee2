"""What follows new deliveries: joined streams, gold by deltas, tables stored by the same buckets."""

import datetime as dt
import decimal
import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import physical

from caudal.plans import activity, deltas, fraud
from caudal.sources import bucketed
from caudal.streaming import joined
from caudal.streaming.transactions import write_append

START = dt.datetime(2024, 3, 1)
TX = "transaccion_id long, cliente_id long, timestamp_tx timestamp_ntz"


def add_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


# --- the trailing hour --------------------------------------------------------

def test_trailing_hour_equals_the_batch_form(spark, tmp_path):
    """Three runs from one checkpoint, rows out of order within the lateness, a hot client, instants shared by rows."""
    draw = random.Random(1)
    rows = []
    for i in range(400):
        at = START + dt.timedelta(minutes=draw.randint(0, 360), seconds=draw.choice([0, 1]), microseconds=draw.choice([0, 1]))
        rows.append((i, 1 if i % 3 else draw.randint(2, 5), at))
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=draw.randint(0, 50)))
    rows += [(900, None, START), (901, 1, None)]
    src, out, progress = tmp_path / "tx", str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        write_append(joined.trailing_hour(stream(spark, src, TX), lateness="1 hour"), out, progress).awaitTermination(240)

    for part in range(3):
        add_file(spark, src, rows[part * 134 : (part + 1) * 134], TX)
        run()
    before = spark.read.parquet(out).count()
    add_file(spark, src, [(999, 99, START + dt.timedelta(days=2))], TX)
    run()
    tx = spark.createDataFrame(rows, TX).withColumn("monto", F.lit(1).cast("decimal(18,2)"))
    expected = fraud.fast_sequences(tx, at_least=1).select("cliente_id", "timestamp_tx", "n_tx", "n_ventana")
    made = spark.read.parquet(out).withColumn("timestamp_tx", F.col("timestamp_tx").cast("timestamp_ntz"))
    made = made.filter("cliente_id <> 99")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, expected.collect()))
    assert 0 < before < made.count()


# --- accounts that come late --------------------------------------------------

def test_late_accounts(spark, tmp_path):
    """Enriched when the account comes later, an orphan when it never does; over a restart none is lost or doubled."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    tx_schema = "transaccion_id long, cuenta_id string, recibida timestamp_ntz"
    account_schema = "cuenta_id string, recibida timestamp_ntz, estado string"
    tx_dir, account_dir = tmp_path / "tx", tmp_path / "cuentas"
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        made = joined.with_late_accounts(stream(spark, tx_dir, tx_schema), stream(spark, account_dir, account_schema))
        write_append(made.select("transaccion_id", "cuenta_id", "estado", "huerfana"), out, progress).awaitTermination(240)
        return sorted((r["transaccion_id"], r["estado"], r["huerfana"]) for r in spark.read.parquet(out).collect())

    add_file(spark, tx_dir, [(1, "a", at(0)), (2, "b", at(5)), (3, "c", at(10)), (4, "d", at(10)), (9, None, at(1))], tx_schema)
    add_file(spark, account_dir, [("a", at(-30), "ACTIVA"), ("z", at(0), "x")], account_schema)
    first = run()
    assert first == [(1, "ACTIVA", False)]
    # b comes 40 minutes after its transaction, twice; c comes too late; d never; a is delivered again.
    add_file(spark, account_dir, [("b", at(45), "ACTIVA"), ("b", at(50), "ACTIVA"), ("a", at(20), "ACTIVA"), ("c", at(90), "CERRADA")], account_schema)
    add_file(spark, tx_dir, [(5, "b", at(46))], tx_schema)
    assert run() == [(1, "ACTIVA", False), (2, "ACTIVA", False), (5, "ACTIVA", False)]
    for minutes in (600, 660):
        add_file(spark, tx_dir, [(100 + minutes, "q", at(minutes))], tx_schema)
        add_file(spark, account_dir, [("q", at(minutes), "ACTIVA")], account_schema)
        last = run()
    assert [r for r in last if r[0] < 100] == [
        (1, "ACTIVA", False), (2, "ACTIVA", False), (3, None, True), (4, None, True), (5, "ACTIVA", False),
    ]
    assert len(last) == len({r[0] for r in last})


# --- gold by deltas -----------------------------------------------------------

ENRICHED = (
    "transaccion_id long, cliente_id long, pais string, segmento string, moneda string, tipo_cuenta string, "
    "tipo_tx string, timestamp_tx timestamp_ntz, monto decimal(18,2)"
)


def enriched(draw, n, first=0):
    out = []
    for i in range(n):
        client = 1 if i % 3 == 0 else draw.randint(2, 9)
        out.append(
            (first + i, client, f"p{client % 2}", f"s{client % 3}", draw.choice(["GTQ", "USD"]), "AHORROS",
             draw.choice(["DEPOSITO", "RETIRO"]), START + dt.timedelta(hours=draw.randint(0, 2000)),
             decimal.Decimal(draw.randint(1, 10**6)) / 100)
        )
    return out


def rebuilt(rows):
    days = activity.daily_of_enriched(rows, ("moneda",)).select(*deltas.DAYS, "n_tx", "monto_total")
    flows = activity.finance_of_enriched(rows, ("DEPOSITO",)).select(*deltas.FLOWS, "n_tx", "entradas", "salidas")
    return days, flows


def same(made, expected):
    assert sorted(map(tuple, made.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_deltas_equal_a_rebuild(spark, tmp_path):
    """Deliveries shuffled, repeated after a failure, corrected and taken back."""
    draw = random.Random(5)
    parts = [enriched(draw, 120, 1000 * d) for d in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, ENRICHED)
    # Delivery 4 corrects amounts of delivery 1 and takes back all of client 9.
    fixed = [(*r[:-1], r[-1] + 5) for r in parts[1][:30]]
    gone = [r for part in parts for r in part if r[1] == 9]
    deliveries = {f"d{i}": deltas.signed(frame(p)) for i, p in enumerate(parts)}
    deliveries["d4"] = deltas.signed(frame(fixed), frame([*parts[1][:30], *[r for r in gone if r not in parts[1][:30]]]))
    days, flows = str(tmp_path / "days"), str(tmp_path / "flows")
    order = ["d4", "d2", "d0", "d2", "d3", "d1", "d4", "d0"]
    for name in order:
        deltas.store(deltas.day_sums(deliveries[name]), days, name)
        deltas.store(deltas.flow_sums(deliveries[name], ("DEPOSITO",)), flows, name)
    final = [r for i, p in enumerate(parts) for r in (p[30:] if i == 1 else p) if r[1] != 9] + fixed
    expected_days, expected_flows = rebuilt(frame(final))
    made = deltas.current(spark, days, deltas.DAYS)
    same(made, expected_days)
    same(deltas.current(spark, flows, deltas.FLOWS), expected_flows)
    same(activity.summarise_days(made, ("moneda",)), activity.summarise_days(expected_days, ("moneda",)))


def test_compacted_deltas(spark, tmp_path):
    """Folded between deliveries, twice: repeats of folded ones change nothing, a correction may come before what it corrects."""
    draw = random.Random(8)
    rows = enriched(draw, 90)
    frame = lambda part: spark.createDataFrame(part, ENRICHED)
    fixed = [(*r[:-1], r[-1] * 2) for r in rows[60:75]]
    deliveries = {
        "a": deltas.signed(frame(rows[:30])), "b": deltas.signed(frame(rows[30:60])),
        "c": deltas.signed(frame(rows[60:])), "2024": deltas.signed(frame(fixed), frame(rows[60:75])),
    }
    path = str(tmp_path / "days0")
    for step, names in enumerate((["2024", "a"], ["a", "b", "2024"], ["c", "b", "a", "c"])):
        for name in names:
            deltas.store(deltas.day_sums(deliveries[name]), path, name)
        target = str(tmp_path / f"days{step + 1}")
        deltas.compact(spark, path, target, deltas.DAYS)
        path = target
    expected, _ = rebuilt(frame(rows[:60] + fixed + rows[75:]))
    same(deltas.current(spark, path, deltas.DAYS), expected)
    assert spark.read.parquet(path).select("entrega").distinct().count() == 1


def test_deltas_follow_a_stream(spark, tmp_path):
    draw = random.Random(6)
    schema = f"{ENRICHED}, signo int"
    src, paths = tmp_path / "in", {"days": str(tmp_path / "days"), "flows": str(tmp_path / "flows")}
    rows = enriched(draw, 200)

    def run():
        deltas.follow(stream(spark, src, schema), paths, ("DEPOSITO",), str(tmp_path / "progress")).awaitTermination(240)

    add_file(spark, src, [(*r, 1) for r in rows[:100]], schema)
    run()
    add_file(spark, src, [(*r, 1) for r in rows[100:]], schema)
    add_file(spark, src, [(*r, -1) for r in rows[:10]], schema)
    run()
    run()  # nothing new
    expected_days, expected_flows = rebuilt(spark.createDataFrame(rows[10:], ENRICHED))
    same(deltas.current(spark, paths["days"], deltas.DAYS), expected_days)
    same(deltas.current(spark, paths["flows"], deltas.FLOWS), expected_flows)


# --- stored by the same buckets -----------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left"])
def test_co_partitioned_tables_join_without_a_shuffle(spark, tmp_path, how):
    facts = spark.range(3000).select(
        F.col("id").alias("transaccion_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 200).alias("cuenta_id"),
    )
    lookup = spark.range(150).select(F.col("id").alias("cuenta_id"), F.concat(F.lit("p"), "id").alias("pais"))
    tag = uuid.uuid4().hex[:8]
    tables = (f"tx_{tag}", f"cuentas_{tag}")
    bucketed.write_together(
        facts, lookup, "cuenta_id", ["transaccion_id"], tables, tuple(str(tmp_path / t) for t in tables), buckets=8, share=0.05
    )
    made = bucketed.join_together(spark, tables, "cuenta_id", how)
    plan = physical(made)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    expected = facts.join(lookup, "cuenta_id", how)
    assert sorted(map(repr, made.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
    sizes = spark.table(tables[0]).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 1000  # the hot account's 1,000 rows are spread
    for t in tables:
        spark.sql(f"drop table {t}")
