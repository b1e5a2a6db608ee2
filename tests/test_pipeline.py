"""The whole pipeline, replays, backfills and the streaming forms."""

import csv
import datetime as dt
import json
import os
import shutil

import pytest
from bank import TRANSACCIONES
from bank import tx as tx_row
from bank import write_raw
from pyspark.sql import functions as F

from caudal import schemas
from caudal.plans import activity, pipeline
from caudal.sources import bronze, raw
from caudal.streaming import transactions as streams

DAY = dt.datetime(2025, 1, 1, 6)


def contents(spark, path):
    return sorted(map(repr, spark.read.parquet(path).collect()))


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bank"))
    write_raw(base)
    pipeline.run_pipeline(spark, base, DAY, dt.date(2022, 7, 31))
    return pipeline.Layout(base)


def test_layers(spark, bank):
    assert spark.read.parquet(bank.bronze("transacciones")).count() == 15
    assert spark.read.parquet(bank.silver("transacciones")).count() == 11
    assert spark.read.parquet(bank.silver("transacciones_enriquecidas")).count() == 9
    reasons = sorted(r["motivos"][0] for r in spark.read.parquet(bank.silver("cuarentena")).collect())
    assert reasons == ["huerfana:cuenta_id", "nulo:monto", "tipo:fecha_nacimiento", "tipo:monto", "tipo:timestamp_tx"]
    counts = spark.read.parquet(bank.silver("conciliacion")).groupBy("destino").sum("n_filas").collect()
    counts = {r[0]: r[1] for r in counts}
    assert counts.pop("recibidas") == sum(counts.values()) == 26
    quality = {r["check"]: r["n_failed"] for r in spark.read.parquet(bank.silver("calidad")).collect()}
    assert quality["unique:transacciones.transaccion_id"] == 2
    assert spark.read.parquet(bank.silver("reglas_incumplidas")).count() == 3


def test_gold(spark, bank):
    daily = spark.read.parquet(bank.gold("tx_diarias"))
    june = daily.filter("fecha = date'2022-06-01'").select("moneda", "n_tx").collect()
    assert sorted(map(tuple, june)) == [("GTQ", 1), ("USD", 1)]
    features = spark.read.parquet(bank.gold("cliente_features"))
    assert features.count() == 4
    assert not set(schemas.PERSONAL_DATA) & set(features.columns)
    dormant = spark.read.parquet(bank.gold("cuentas_inactivas"))
    assert {(r["cuenta_id"], r["nunca"]) for r in dormant.collect()} == {
        ("ACC00000001", False), ("ACC00000003", False), ("ACC00000005", True), ("ACC00000006", True),
    }
    travel = spark.read.parquet(bank.gold("viajes_imposibles")).collect()
    assert [(r["cuenta_id"], r["pais_tx"]) for r in travel] == [("ACC00000003", "México")]


def test_replay_gives_the_same_silver(spark, bank):
    before = {t: contents(spark, bank.silver(t)) for t in (*schemas.TABLES, "calidad", "cuarentena")}
    with open(f"{bank.raw('clientes')}/part-0.csv", encoding="utf-8") as f:
        assert len(f.readlines()) == 6
    pipeline.ingest(spark, bank, DAY)  # the same day again
    pipeline.build_silver(spark, bank)
    assert before == {t: contents(spark, bank.silver(t)) for t in before}


def test_json_and_csv_raw_files_give_the_same_silver(spark, bank, tmp_path):
    base = str(tmp_path)
    write_raw(base)
    layout = pipeline.Layout(base)
    os.makedirs(layout.raw("transacciones", "json"))
    with open(f"{layout.raw('transacciones', 'json')}/part-0.json", "w", encoding="utf-8") as f:
        for row in TRANSACCIONES:
            f.write(json.dumps({k: v for k, v in row.items() if v != ""}) + "\n")
    pipeline.ingest(spark, layout, DAY, {"transacciones": "json"})
    pipeline.build_silver(spark, layout)
    for table in ("transacciones", "calidad"):
        assert contents(spark, layout.silver(table)) == contents(spark, bank.silver(table))


def gold_tables(spark, layout):
    names = sorted(os.listdir(f"{layout.base}/gold"))
    out = {}
    for name in names:
        rows = spark.read.parquet(layout.gold(name))
        out[name] = sorted(map(repr, rows.select(*sorted(rows.columns)).collect()))
    return out


def test_gold_ends_at_the_day(spark, bank, tmp_path):
    """Rows after ``as_of`` change no table."""
    shutil.copytree(f"{bank.base}/silver", tmp_path / "one" / "silver")
    layout = pipeline.Layout(str(tmp_path / "one"))
    pipeline.build_gold(spark, layout, dt.date(2022, 6, 30))
    for name in ("tx_diarias", "tx_diarias_cliente"):
        assert spark.read.parquet(layout.gold(name)).agg(F.max("fecha")).first()[0] <= dt.date(2022, 6, 30)
    cut = pipeline.Layout(str(tmp_path / "two"))
    shutil.copytree(f"{bank.base}/silver", tmp_path / "two" / "silver")
    enriched = spark.read.parquet(layout.silver("transacciones_enriquecidas")).filter("timestamp_tx < '2022-07-01'")
    enriched.write.mode("overwrite").parquet(cut.silver("transacciones_enriquecidas"))
    pipeline.build_gold(spark, cut, dt.date(2022, 6, 30))
    assert gold_tables(spark, layout) == gold_tables(spark, cut)


def test_backfill_of_gold_equals_a_rebuild(spark, bank, tmp_path):
    layout, whole = (pipeline.Layout(str(tmp_path / n)) for n in ("days", "whole"))
    for target in (layout, whole):
        shutil.copytree(f"{bank.base}/silver", f"{target.base}/silver")
    pipeline.build_gold(spark, layout)
    path = layout.silver("transacciones_enriquecidas")
    rows = spark.read.parquet(path)
    # 1 June loses its rows but one, 2 June gets a second one just after midnight.
    changed = rows.filter("date(timestamp_tx) <> '2022-06-01' or cuenta_id = 'ACC00000002'")
    late = rows.filter("date(timestamp_tx) = '2022-06-02'").withColumns(
        {"transaccion_id": F.lit("TX0000000099"), "timestamp_tx": F.lit(dt.datetime(2022, 6, 2, 9, 30)).cast("timestamp_ntz"), "pais_tx": F.lit("México")}
    )
    changed.unionByName(late).write.parquet(f"{tmp_path}/changed")
    for target in (layout, whole):
        spark.read.parquet(f"{tmp_path}/changed").write.mode("overwrite").parquet(target.silver("transacciones_enriquecidas"))
    for _ in range(2):
        pipeline.build_gold(spark, layout, days=(dt.date(2022, 6, 1), dt.date(2022, 6, 4)))
    pipeline.build_gold(spark, whole)
    assert gold_tables(spark, layout) == gold_tables(spark, whole)
    assert any("TX0000000099" in r for r in gold_tables(spark, layout)["rafagas"])


def test_a_failed_check_stops_before_gold(spark, tmp_path):
    write_raw(str(tmp_path))
    with pytest.raises(pipeline.QualityError, match="unique:transacciones"):
        pipeline.run_pipeline(spark, str(tmp_path), DAY, limits={"unique:transacciones.transaccion_id": 0.1})
    assert not os.path.exists(f"{tmp_path}/gold")


def test_deliveries_of_one_day_are_kept_and_old_files_are_not_stored_again(spark, tmp_path):
    write_raw(str(tmp_path))
    layout = pipeline.Layout(str(tmp_path))
    pipeline.ingest(spark, layout, DAY)
    drop_file(layout.raw("transacciones"), "part-1.csv", [tx_row(90, 1, "2022-06-09T10:00:00")])
    for _ in range(2):
        pipeline.ingest(spark, layout, DAY + dt.timedelta(hours=2))
    stored = spark.read.parquet(layout.bronze("transacciones"))
    assert stored.count() == 16 and stored.select("entrega").distinct().count() == 2
    pipeline.ingest(spark, layout, DAY)
    assert spark.read.parquet(layout.bronze("transacciones")).count() == 16


def test_a_file_of_the_same_name_with_new_content_is_stored(spark, tmp_path):
    write_raw(str(tmp_path))
    layout = pipeline.Layout(str(tmp_path))
    pipeline.ingest(spark, layout, DAY)
    drop_file(layout.raw("transacciones"), "part-0.csv", [tx_row(91, 1, "2022-06-09T10:00:00")])
    for _ in range(2):
        pipeline.ingest(spark, layout, DAY + dt.timedelta(days=1))
    pipeline.ingest(spark, layout, DAY + dt.timedelta(days=2))  # nothing new
    stored = spark.read.parquet(layout.bronze("transacciones"))
    assert stored.count() == 16 and stored.filter("transaccion_id = 'TX0000000091'").count() == 1
    assert spark.read.parquet(layout.bronze("clientes")).select("entrega").distinct().count() == 1


def test_files_stored_without_time_and_size_are_stored_once_more(spark, tmp_path):
    write_raw(str(tmp_path))
    layout, path = pipeline.Layout(str(tmp_path)), str(tmp_path / "old")
    rows = raw.read_text(spark, layout.raw("transacciones"), schemas.TRANSACCIONES)
    old = bronze.to_bronze(rows, DAY).drop("_source_modified", "_source_size")
    old.write.partitionBy("ingest_date", "entrega").parquet(path)
    for n, expected in ((1, 15), (2, 0)):
        new = bronze.to_bronze(rows, DAY + dt.timedelta(days=n))
        new = bronze.not_yet_stored(new, bronze.stored_files(spark, path))
        assert new.count() == expected
        bronze.write_bronze(new, path)


def test_publishing_gold_gives_each_table_its_options(spark, bank, monkeypatch):
    sent = {}
    monkeypatch.setattr(pipeline.jdbc, "write_jdbc", lambda df, options: sent.update({options["dbtable"]: df.count()}))
    pipeline.publish(spark, bank, lambda t: {"dbtable": f"gold.{t}"}, ["churn", "cliente_features"])
    assert set(sent) == {"gold.churn", "gold.cliente_features"} and sent["gold.cliente_features"] == 4


def test_backfill_twice_is_once_and_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "days")
    tx = spark.createDataFrame(
        [("c1", dt.datetime(2022, 6, d, 12)) for d in (1, 1, 2, 3)],
        "cliente_id string, timestamp_tx timestamp_ntz",
    )

    def metric(days):
        return days.groupBy(F.to_date("timestamp_tx").alias("fecha")).agg(F.count("*").alias("n"))

    pipeline.backfill(tx, metric, dt.date(2022, 6, 1), dt.date(2022, 6, 4), path)
    first = contents(spark, path)
    more = tx.unionByName(tx.filter("timestamp_tx >= '2022-06-02'"))
    for _ in range(2):
        pipeline.backfill(more, metric, dt.date(2022, 6, 2), dt.date(2022, 6, 3), path)
    assert len(first) == 3
    got = {str(r["fecha"]): r["n"] for r in spark.read.parquet(path).collect()}
    assert got == {"2022-06-01": 2, "2022-06-02": 2, "2022-06-03": 1}
    # A day that lost its rows becomes empty.
    for _ in range(2):
        pipeline.backfill(
            more.filter("timestamp_tx < '2022-06-03'"), metric, dt.date(2022, 6, 2), dt.date(2022, 6, 9), path
        )
    got = {str(r["fecha"]): r["n"] for r in spark.read.parquet(path).collect()}
    assert got == {"2022-06-01": 2, "2022-06-02": 2}


# --- streaming --------------------------------------------------------------------

def drop_file(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=schemas.TRANSACCIONES.names)
        out.writeheader()
        out.writerows(rows)


def test_each_raw_file_is_read_once(spark, tmp_path):
    raw_dir, out, progress = (str(tmp_path / n) for n in ("raw", "bronze", "progress"))

    def run():
        rows = streams.new_files(spark, raw_dir, schemas.TRANSACCIONES)
        streams.stream_to_bronze(rows, out, progress).awaitTermination(120)

    drop_file(raw_dir, "one.csv", [tx_row(1, 1, "2022-06-01T10:00:00"), tx_row(2, 1, "2022-06-01T11:00:00")])
    run()
    assert spark.read.parquet(out).count() == 2
    drop_file(raw_dir, "two.csv", [tx_row(3, 1, "2022-06-01T12:00:00")])
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted(r["transaccion_id"][-1] for r in got.collect()) == ["1", "2", "3"]
    assert got.select("_source_file").distinct().count() == 2


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_stream_and_batch_read_a_dirty_file_alike(spark, tmp_path, kind):
    folder = tmp_path / "raw"
    os.makedirs(folder)
    good = tx_row(1, 1, "2022-06-01T10:00:00", comercio='Tienda ""A"", centro')
    if kind == "csv":
        drop_file(str(folder), "a.csv", [good, tx_row(2, 1, "2022-06-01T11:00:00")])
        with open(folder / "a.csv", "a", encoding="utf-8") as f:
            f.write("TX3,short\n")
    else:
        (folder / "a.json").write_text(json.dumps(good) + "\n{broken\n", encoding="utf-8")
    rows = streams.new_files(spark, str(folder), schemas.TRANSACCIONES, kind=kind)
    streams.stream_to_bronze(rows, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = raw.read_text(spark, str(folder), schemas.TRANSACCIONES, kind)
    columns = [*schemas.TRANSACCIONES.names, raw.CORRUPT]
    assert sorted(map(repr, streamed.select(*columns).collect())) == sorted(map(repr, batch.select(*columns).collect()))
    assert streamed.filter("_corrupt is not null").count() == 1


def parquet_stream(spark, folder):
    return spark.readStream.schema(
        "transaccion_id string, cuenta_id string, timestamp_tx timestamp_ntz"
    ).parquet(folder)


def put(spark, folder, data):
    rows = [(i, a, dt.datetime.fromisoformat(t)) for i, a, t in data]
    spark.createDataFrame(
        rows, "transaccion_id string, cuenta_id string, timestamp_tx timestamp_ntz"
    ).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("spread", [0, 3])
def test_stream_dedup_within_the_watermark(spark, tmp_path, spread):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))

    def run():
        streams.write_append(
            streams.dedup_stream(parquet_stream(spark, src), spread=spread), out, progress
        ).awaitTermination(120)

    put(spark, src, [("t1", "a", "2022-01-01T10:00:00"), ("t1", "a", "2022-01-01T10:00:00")])
    run()
    put(spark, src, [("t1", "a", "2022-01-01T10:00:00"), ("t2", "a", "2022-01-01T10:30:00")])
    run()
    assert sorted(r["transaccion_id"] for r in spark.read.parquet(out).collect()) == ["t1", "t2"]


def test_stream_hourly_frequency_equals_batch_for_closed_hours(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))

    def run():
        streams.write_append(
            streams.hourly_frequency(parquet_stream(spark, src)), out, progress
        ).awaitTermination(120)

    put(spark, src, [("t1", "a", "2022-01-01T10:05:00"), ("t2", "a", "2022-01-01T10:55:00"),
                     ("t3", "b", "2022-01-01T10:10:00")])
    run()
    put(spark, src, [("t4", "a", "2022-01-01T15:00:00")])
    run()
    put(spark, src, [("late", "a", "2022-01-01T10:59:00"), ("t5", "a", "2022-01-01T15:30:00")])
    run()
    got = sorted((r["cuenta_id"], r["hora"].hour, r["n_tx"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 10, 2), ("b", 10, 1)]


def test_checkpoint_path_is_the_clusters(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        with pytest.raises(ValueError):
            streams.checkpoint_path(spark, "x")
    else:
        assert streams.checkpoint_path(spark, "x") == f"{shared.rstrip('/')}/x"


def test_as_of_forms(spark):
    tx = spark.createDataFrame(
        [("c1", dt.datetime(2022, 6, d, 12)) for d in (1, 2, 3)],
        "cliente_id string, timestamp_tx timestamp_ntz",
    )
    assert activity.until(tx, None).count() == 3
    assert activity.until(tx, dt.date(2022, 6, 2)).count() == 2
    assert activity.until(tx, dt.datetime(2022, 6, 2, 12)).count() == 2
    assert activity.until(tx, dt.datetime(2022, 6, 2, 11)).count() == 1
