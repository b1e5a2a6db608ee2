"""Mergeable sketches, key bitmaps, totals of earlier rows and state as of a row, on hand-made and skewed rows."""

import datetime as dt
import decimal
import random
import re
import statistics

import pytest
from compare import connect
from pyspark.sql import functions as F
from test_plans import physical, scans

from caudal.operators import keysets, prefix, quality, sketches
from caudal.operators.quantiles import QUARTILES, exact_quantiles
from caudal.plans import activity, fraud, silver
from caudal.plans.registered import QUERIES

START = dt.datetime(2024, 1, 1)


# --- sketches -----------------------------------------------------------------

@pytest.fixture(scope="module")
def visits(spark):
    """300,000 rows of 60,000 clients; a third of all rows is one client; a day each."""
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(60_000))).alias("cliente_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).cast("int")).alias("fecha"),
    )
    return rows.withColumn("mes", F.trunc("fecha", "month"))


def test_united_days_are_within_the_bound(visits):
    daily = sketches.distinct_sketches(visits, ["mes", "fecha"], "cliente_id")
    months = {r["mes"]: r["n"] for r in sketches.united(daily, ["mes"]).select("mes", sketches.n_distinct().alias("n")).collect()}
    exact = {r["mes"]: r["n"] for r in visits.groupBy("mes").agg(F.countDistinct("cliente_id").alias("n")).collect()}
    assert set(months) == set(exact) and all(n > 20_000 for n in exact.values())
    for month, n in exact.items():
        assert abs(months[month] / n - 1) <= sketches.relative_error(deviations=3)


def test_overlap_of_months_is_within_the_bound(spark, visits):
    daily = sketches.distinct_sketches(visits.withColumn("pais", F.lit("x")), ["fecha", "pais"], "cliente_id")
    made = activity.retained_clients(daily).collect()
    january, february = (visits.filter(F.month("mes") == m).select("cliente_id").distinct() for m in (1, 2))
    common, union = january.intersect(february).count(), january.union(february).distinct().count()
    assert [r["mes"] for r in made] == [dt.date(2024, 1, 1)]
    assert abs(made[0]["n_retenidos"] - common) <= sketches.relative_error(deviations=3) * union


def test_merging_order_and_copies_change_nothing(visits):
    daily = sketches.distinct_sketches(visits, ["fecha"], "cliente_id")
    once = sketches.united(daily, []).select(sketches.n_distinct()).first()[0]
    again = sketches.united(daily.unionByName(daily).orderBy(F.rand(1)), []).select(sketches.n_distinct()).first()[0]
    assert once == again


def test_small_groups_are_exact_and_nulls_do_not_count(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", None)], "g string, v long")
    made = sketches.distinct_sketches(rows, ["g"], "v").select("g", sketches.n_distinct().alias("n")).collect()
    assert {r["g"]: r["n"] for r in made} == {"a": 2, "b": 0}


def test_quantiles_from_stored_sketches_equal_those_of_the_rows(spark, visits):
    """Brackets from merged sketches of days: the same exact cuts, without a sketch pass over the rows."""
    rows = visits.withColumn("v", F.pmod(F.xxhash64("cliente_id", "fecha"), F.lit(10_007)).cast("double"))
    stored = sketches.quantile_sketches(rows, ["mes", "fecha"], "v")
    expected = exact_quantiles(rows, ["mes"], "v", QUARTILES).collect()
    made = exact_quantiles(rows, ["mes"], "v", QUARTILES, sketched=sketches.merged(stored, ["mes"]))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, expected))
    assert "percentile_approx" not in physical(made)


def test_subtotals_read_the_facts_once(spark):
    plan = physical(QUERIES["activity_rollup"](spark, "/root/testdata/sf0.001"))
    assert scans(plan, "orders") == 1 and plan.count("Expand") == 1


# --- key sets -----------------------------------------------------------------

def test_bitmaps_equal_the_row_wise_checks(spark):
    draw = random.Random(1)
    children = [draw.choice([5, 32_768, 32_769, 70_000, 0, -1, -32_768, -32_769, 10**12]) for _ in range(300)]
    children += [77] * 400 + [None] * 9 + list(range(100, 300))
    child = spark.createDataFrame([(k,) for k in children], "clave_hija long")
    parent = spark.createDataFrame([(k,) for k in [5, 32_769, 77, -32_768, 10**12, *range(150, 400)]], "id long")
    lost = {r["clave"] for r in keysets.orphan_keys(keysets.key_sets(child, "clave_hija"), keysets.key_sets(parent, "id")).collect()}
    known = {r["id"] for r in parent.collect()}
    assert lost == {k for k in children if k is not None and k not in known}
    made = keysets.count_orphans(child, "clave_hija", parent, "c", "id").collect()
    assert made == quality.count_orphans(child, "clave_hija", parent, "c", "id").collect()
    assert keysets.count_repeated(child, "clave_hija", "u").collect() == quality.count_repeated(child, ["clave_hija"], "u").collect()


def test_folded_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0), (1, 7), (1, 7), (2, 0), (0, 9), (0, 9), (0, 9)], "a long, b int")
    made = keysets.count_repeated(keysets.dense_key(rows, ["a", "b"]), "_clave", "u").first()
    assert (made["n_rows"], made["n_failed"]) == (7, 3)
    none = rows.limit(0)
    assert tuple(keysets.count_repeated(none, "a", "u").first()) == ("u", 0, 0)
    assert tuple(keysets.count_orphans(none, "a", rows, "o").first()) == ("o", 0, 0)
    assert tuple(keysets.count_orphans(rows, "a", none, "o").first()) == ("o", 7, 7)


# --- earlier rows -------------------------------------------------------------

def transactions(spark, rows):
    schema = "transaccion_id long, cliente_id long, timestamp_tx timestamp_ntz, monto decimal(18,2)"
    return spark.createDataFrame([(i, c, t, None if m is None else decimal.Decimal(m)) for i, (c, t, m) in enumerate(rows)], schema)


def test_only_earlier_amounts_judge(spark):
    """A hot client over days, seconds and microseconds; ties at one instant don't judge each other."""
    draw = random.Random(2)
    rows = []
    for i in range(900):
        client = 1 if i % 3 == 0 else draw.randint(2, 6)
        at = START + dt.timedelta(days=draw.randint(0, 3), seconds=draw.choice([0, 1, 5, 86_399]), microseconds=draw.choice([0, 1, 999_999]))
        rows.append((client, at, None if draw.random() < 0.03 else f"{draw.choice([10, 1000, 99_999_999])}.{draw.randint(0, 99):02d}"))
    made = {r["transaccion_id"]: r for r in fraud.unusual_amounts_before(transactions(spark, rows), 1.0, at_least=3).collect()}
    expected = {}
    for i, (client, at, amount) in enumerate(rows):
        earlier = [float(m) for c, t, m in rows if c == client and t < at and m is not None]
        if amount is not None and len(earlier) >= 3 and statistics.stdev(earlier) > 0:
            z = (float(amount) - statistics.mean(earlier)) / statistics.stdev(earlier)
            if z > 1:
                expected[i] = (len(earlier), z)
    assert set(made) == set(expected) and len(expected) > 50
    for i, (n, z) in expected.items():
        assert made[i]["n_previas"] == n and made[i]["z"] == pytest.approx(z, rel=1e-9)


def test_large_equal_amounts_have_no_deviation(spark):
    """Sums of squares of 1e15 cents cancel exactly: no spurious deviation."""
    rows = [(1, START + dt.timedelta(seconds=i), "9999999999999.99") for i in range(40)]
    assert fraud.unusual_amounts_before(transactions(spark, rows), 0.0).collect() == []


def test_no_window_over_a_whole_key(spark):
    """Rows meet windows per day of a key and finer; only a key's days are scanned as one."""
    plan = QUERIES["fraud_amount_before"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    groups = {tuple(sorted(c.split("#")[0] for c in g.split(", "))) for g in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)}
    assert groups == {("cliente_id",), ("_d", "cliente_id"), ("_s", "cliente_id")}


# --- state as of a row --------------------------------------------------------

def test_as_of_a_hot_account(spark):
    draw = random.Random(3)
    known = {}
    for i in range(120):
        key = 1 if i % 3 == 0 else draw.randint(2, 9)
        known[key, START + dt.timedelta(minutes=draw.randint(0, 3000))] = f"s{i}"
    facts = [(i, 1 if i % 3 else draw.randint(2, 12), START + dt.timedelta(minutes=draw.randint(-100, 6000))) for i in range(600)]
    facts += [(900, None, START), (901, 1, None), (902, None, None)]
    facts += [(1000 + i, k, t) for i, (k, t) in enumerate(known)]  # at the instant of the state itself
    tx = spark.createDataFrame(facts, "id long, cuenta long, cuando timestamp_ntz")
    states = spark.createDataFrame([(k, t, s, "x") for (k, t), s in known.items()], "cuenta long, desde timestamp_ntz, estado string, cuando string")
    made = {r["id"]: (r["desde"], r["estado"]) for r in prefix.as_of(tx, states, "cuenta", "cuando", "desde", ["desde", "estado"]).collect()}
    for i, key, at in facts:
        past = [(t, s) for (k, t), s in known.items() if k == key and at is not None and t <= at]
        assert made[i] == (max(past) if past else (None, None))
    assert len(made) == len(facts)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_as_of_by_run_or_bucket(spark, share):
    """All keys, only the hot one, or no key cut into buckets: the same states; keys of two widths; facts without key or instant."""
    draw = random.Random(4)
    known = {}
    for i in range(200):
        key = 1 if i % 3 == 0 else draw.randint(2, 40)
        known[key, START + dt.timedelta(minutes=draw.randint(-9000, 3000))] = f"s{i}"
    facts = [(i, 1 if i % 3 == 0 else draw.randint(2, 50), START + dt.timedelta(minutes=draw.randint(-9500, 6000))) for i in range(900)]
    facts += [(1000 + i, k, t) for i, (k, t) in enumerate(known)]
    facts += [(2000 + i, None, START) for i in range(300)] + [(3000 + i, 1, None) for i in range(300)] + [(4000, None, None), (4001, 9, None)]
    facts += [(i, k, t) for i, k, t in facts[:50]]  # equal rows stay apart
    tx = spark.createDataFrame(facts, "id long, cuenta int, cuando timestamp_ntz")
    states = spark.createDataFrame([(k, t, s) for (k, t), s in known.items()], "cuenta long, desde timestamp_ntz, estado string")
    made = prefix.as_of(tx, states, "cuenta", "cuando", "desde", ["desde", "estado"], share=share)
    assert made.schema["cuenta"].dataType.simpleString() == "int"
    expected = []
    for i, key, at in facts:
        past = [(t, s) for (k, t), s in known.items() if k == key and at is not None and t <= at]
        expected.append((i, key, at, *(max(past) if past else (None, None))))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)


def test_as_of_nothing(spark):
    tx = spark.createDataFrame([], "id long, cuenta long, cuando timestamp_ntz")
    states = spark.createDataFrame([(1, START, "x")], "cuenta long, desde timestamp_ntz, estado string")
    assert prefix.as_of(tx, states, "cuenta", "cuando", "desde", ["estado"]).collect() == []
    assert prefix.as_of(tx, states.limit(0), "cuenta", "cuando", "desde", ["estado"]).collect() == []
    alone = prefix.as_of(states, states.limit(0), "cuenta", "desde", "desde", []).collect()
    assert [tuple(r) for r in alone] == [(1, START, "x")]


def shuffled_rows(df):
    """Rows that the shuffles of a finished query wrote, those of its subqueries left out."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (found.get().value() if found.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_cold_keys_meet_their_states_in_one_shuffle(spark):
    """No key is hot: facts and states once for the run, orders at most twice for their versions, and no other pass."""
    sf = "/root/testdata/sf0.01"
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert lines < shuffled_rows(QUERIES["tx_state_as_of"](spark, sf)) <= lines + 3 * orders


def test_undated_facts_come_with_the_others(spark):
    """The facts are scanned whole once, not a second time for those without key or instant."""
    plan = QUERIES["tx_state_as_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1


def test_versions(spark):
    day = lambda n: START + dt.timedelta(days=n)
    said = [("a", day(0), "ACTIVA"), ("a", day(1), "ACTIVA"), ("a", day(2), "CERRADA"), ("a", day(3), None), ("a", day(4), None),
            ("b", day(1), "ACTIVA"), ("b", day(1), "ACTIVA"), (None, day(1), "x")]
    made = prefix.versions(spark.createDataFrame(said, "cuenta string, en timestamp_ntz, estado string"), "cuenta", "en", ["estado"])
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(
        [("a", day(0), day(2), "ACTIVA"), ("a", day(2), day(3), "CERRADA"), ("a", day(3), None, None), ("b", day(1), None, "ACTIVA")], key=repr
    )


def test_as_of_without_range_join(spark):
    plan = physical(QUERIES["tx_state_as_of"](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sketches_at_a_larger_size(spark):
    """sf0.1: estimates of the registered queries against exact counts."""
    sf = "/root/testdata/sf0.1"
    con = connect(sf)
    exact = dict(con.sql("select cast(date_trunc('month', o_orderdate) as date), count(distinct o_custkey) from orders group by 1").fetchall())
    for r in QUERIES["retention_sketched"](spark, sf).collect():
        assert abs(r["n_clientes"] / exact[r["mes"]] - 1) <= sketches.relative_error(deviations=3)


def test_account_state_when_the_transaction_happened(spark):
    """Closed on the second day, open again on the fourth: only what lies between fails."""
    schema = "cuenta_id string, cliente_id string, tipo_cuenta string, moneda string, fecha_apertura string, estado string, saldo_inicial string, _ingested_at timestamp"
    day = lambda n: START + dt.timedelta(days=n)
    row = lambda key, state, n: (key, "CLI000001", "AHORROS", "GTQ", "2022-01-01", state, "10.00", day(n))
    said = [row("ACC00000001", s, n) for n, s in enumerate(["ACTIVA", "ACTIVA", "CERRADA", "CERRADA", "ACTIVA"])]
    said += [row("ACC00000002", "ACTIVA", 1), row("ACC00000003", "CERRADA", 1), (*row("ACC00000003", "ACTIVA", 3)[:6], "abc", day(3))]
    cleaned = silver.clean(spark.createDataFrame(said, schema), "cuentas")
    versions = silver.account_versions(cleaned.checked)
    spans = sorted((r["cuenta_id"], r["desde"], r["hasta"], r["estado"]) for r in versions.select("cuenta_id", "desde", "hasta", "estado").collect())
    assert spans == [
        ("ACC00000001", day(0), day(2), "ACTIVA"), ("ACC00000001", day(2), day(4), "CERRADA"),
        ("ACC00000001", day(4), None, "ACTIVA"), ("ACC00000002", day(1), None, "ACTIVA"), ("ACC00000003", day(1), None, "CERRADA"),
    ]
    facts = [("ACC00000001", day(n) + dt.timedelta(hours=h)) for n in range(-1, 6) for h in (0, 23)] + [("ACC00000002", day(0)), (None, day(1))]
    tx = spark.createDataFrame(facts, "cuenta_id string, timestamp_tx timestamp_ntz")
    made = silver.on_account_inactive_then(tx, versions, "c").first()
    assert (made["n_rows"], made["n_failed"]) == (len(facts), 4)
    assert "_ingested_at" not in cleaned.good.columns
