"""Operators on hand-made rows, with expected output written by hand."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal import domain
from caudal.functions.hashing import hash_uniform, pick, uniform_int, weighted_choice
from caudal.functions.values import direction, format_key, key_matches
from caudal.operators import joins, sampling
from caudal.operators.dedup import drop_copies, latest_by_key
from caudal.operators.quantiles import band, exact_quantiles
from caudal.operators.windows import trailing_totals, with_previous


def at(text):
    return dt.datetime.fromisoformat(text)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- values -------------------------------------------------------------------

def test_keys_wider_than_the_padding_stay_whole(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "n bigint")
    keyed = df.select(format_key("n", "CLI", 6).alias("k"))
    assert rows(keyed, "k") == [("CLI000007",), ("CLI1234567",)]
    assert keyed.filter(key_matches("k", "CLI", 6)).count() == 2
    assert df.select(F.lit("CLI12345").alias("k")).filter(key_matches("k", "CLI", 6)).count() == 0


def test_only_deposits_bring_money_in(spark):
    df = spark.createDataFrame([(t,) for t in domain.TIPOS_TX], "t string")
    signs = dict(rows(df.withColumn("s", direction("t")), "t", "s"))
    assert {t for t, s in signs.items() if s == 1} == {"DEPOSITO"}


# --- draws ----------------------------------------------------------------------

def test_draws_depend_on_key_and_salt_only(spark):
    few = spark.range(1000, numPartitions=1).select("id", hash_uniform("id", "a").alias("u"))
    many = spark.range(1000, numPartitions=7).select("id", hash_uniform("id", "a").alias("u"))
    other = spark.range(1000).select("id", hash_uniform("id", "b").alias("u"))
    assert rows(few, "id", "u") == rows(many, "id", "u") != rows(other, "id", "u")


def test_weighted_choice_keeps_the_shares(spark):
    n = 20_000
    for weights in (domain.SEGMENTOS, domain.MONEDAS):
        assert sum(weights.values()) == pytest.approx(1.0)
        drawn = spark.range(n).select(weighted_choice("id", "w", weights).alias("v"))
        counts = {r["v"]: r["count"] for r in drawn.groupBy("v").count().collect()}
        for value, weight in weights.items():
            assert counts[value] / n == pytest.approx(weight, abs=0.015)


def test_uniform_int_and_pick_reach_both_ends(spark):
    df = spark.range(2000).select(
        uniform_int("id", "i", 3, 5).alias("i"), pick(["a", "b"], "id", "p").alias("p")
    )
    assert {r["i"] for r in df.collect()} == {3, 4, 5}
    assert {r["p"] for r in df.collect()} == {"a", "b"}


@pytest.mark.parametrize("n", [0, 1, 17, 500, 1000, 5000])
def test_sample_n_is_exact_and_the_smallest_hashes(spark, n):
    df = spark.range(1000, numPartitions=5)
    got = [r["id"] for r in sampling.sample_n(df, "id", "s", n).collect()]
    ordered = [r["id"] for r in df.orderBy(hash_uniform("id", "s"), "id").collect()]
    assert sorted(got) == sorted(ordered[:n])


def test_dense_index_has_no_gaps(spark):
    df = spark.range(777, numPartitions=4)
    indexed = sampling.dense_index(df, "id", "d", "i")
    ordered = [r["id"] for r in df.orderBy(hash_uniform("id", "d"), "id").collect()]
    assert [r["id"] for r in indexed.orderBy("i").collect()] == ordered
    assert [r["i"] for r in indexed.orderBy("i").collect()] == list(range(777))


def test_every_child_gets_one_parent_about_evenly(spark):
    children = spark.range(5000)
    parents = spark.range(10).withColumnRenamed("id", "p")
    counts = Counter(
        r["p"] for r in sampling.assign_parent(children, "id", parents, "p", "s").collect()
    )
    assert sum(counts.values()) == 5000 and len(counts) == 10
    assert min(counts.values()) > 350


def test_fan_out_numbers_one_to_three_children(spark):
    out = sampling.fan_out(spark.range(600), "id", "f", 3, "n")
    per_parent = {}
    for r in out.collect():
        per_parent.setdefault(r["id"], []).append(r["n"])
    assert len(per_parent) == 600
    assert {tuple(sorted(v)) for v in per_parent.values()} == {(1,), (1, 2), (1, 2, 3)}


def test_home_or_foreign_never_picks_home_as_foreign(spark):
    countries = list(domain.PAISES)
    df = spark.range(6000).select(
        "id",
        sampling.home_or_foreign(
            "id", "x", F.lit("México"), F.array(*[F.lit(c) for c in countries]), 0.95
        ).alias("p"),
    )
    counts = Counter(r["p"] for r in df.collect())
    assert set(counts) == set(countries)
    assert counts["México"] / 6000 == pytest.approx(0.95, abs=0.02)


def test_injected_defects_are_removed_again(spark):
    clean = spark.range(4000).select(
        "id", F.col("id").cast("decimal(18,2)").alias("monto"),
        F.lit(at("2022-01-01")).cast("timestamp_ntz").alias("ts"),
    )
    nulled = sampling.inject_nulls(clean, "monto", "id", "n", 0.02)
    dirty = sampling.inject_copies(nulled, "id", "c", 0.01)
    n_null, n_copies = nulled.filter("monto is null").count(), dirty.count() - 4000
    assert 40 < n_null < 130 and 15 < n_copies < 80
    back = latest_by_key(dirty, ["id"], ["ts"])
    assert back.count() == 4000
    assert rows(back.filter("monto is not null"), "id", "monto") == rows(
        nulled.filter("monto is not null"), "id", "monto"
    )


def test_exact_defects_have_exact_numbers(spark):
    """n rows and floor(n/100) copies, each id twice at most; floor(n/50) empty amounts."""
    n = 5_050
    clean = spark.range(n).select("id", F.col("id").cast("decimal(18,2)").alias("monto"))
    nulled = sampling.inject_nulls_exact(clean, "monto", "id", "n", domain.PROPORCION_MONTO_NULO)
    assert nulled.columns == clean.columns
    assert nulled.count() == n and nulled.filter("monto is null").count() == 101
    dirty = sampling.inject_copies_exact(nulled, "id", "c", domain.PROPORCION_DUPLICADOS)
    per_id = dirty.groupBy("id").count()
    assert dirty.count() == n + 50 and per_id.count() == n
    assert per_id.agg(F.max("count")).collect()[0][0] == 2
    assert drop_copies(dirty).count() == n


# --- dedup ------------------------------------------------------------------------

def test_copies_collapse_and_the_latest_row_stays(spark):
    df = spark.createDataFrame(
        [
            ("a", at("2022-01-01T00:00:00"), 1),
            ("a", at("2022-01-01T00:00:00"), 1),
            ("b", at("2022-01-01T00:00:00"), 9),
            ("b", at("2022-01-02T00:00:00"), 2),
            ("c", at("2022-01-01T00:00:00"), None),
            ("c", at("2022-01-01T00:00:00"), 5),
        ],
        "id string, ts timestamp_ntz, v int",
    )
    assert rows(latest_by_key(df, ["id"], ["ts"]), "id", "v") == [("a", 1), ("b", 2), ("c", 5)]
    assert drop_copies(df).count() == 5


# --- joins ------------------------------------------------------------------------

def test_salted_lookup_equals_the_plain_join(spark):
    """A third of the rows on one key, one key without lookup row, null keys."""
    facts = spark.range(9000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(-1))
        .when(F.col("id") % 1000 == 1, F.lit(None))
        .otherwise(F.col("id") % 50)
        .alias("k"),
    )
    lookup = facts.filter("k < 49").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    assert joins.salted_lookup(facts.filter("id < 0"), lookup, ["k"], "n", ["id"]).count() == 0
    assert joins.salted_lookup(facts, lookup.filter("n < 0"), ["k"], "n", ["id"], "left").count() == 9000
    for how in ("inner", "left"):
        salted = joins.salted_lookup(facts, lookup, ["k"], "n", ["id"], how, share=0.1, splits=7)
        plain = facts.join(lookup.drop("n"), "k", how)
        assert salted.count() == plain.count()
        assert salted.exceptAll(plain.select(*salted.columns)).count() == 0
    with pytest.raises(ValueError):
        joins.salted_lookup(facts, lookup, ["k"], "n", ["id"], "full")


def test_hot_rows_are_spread_over_the_salts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(8000).select("id", F.lit(1).alias("k"))
        lookup = spark.createDataFrame([(1, "x", 8000)], "k int, v string, n long")
        joined = joins.salted_lookup(facts, lookup, ["k"], "n", ["id"], splits=64)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def fixed_partitions(spark):
    """Shuffle partitions as planned: nothing merged at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_one_key_with_all_rows_is_spread_over_the_tasks(spark, fixed_partitions):
    start = F.lit("2022-01-01").cast("timestamp").cast("bigint")
    tx = spark.range(20_000).select(
        F.lit("hot").alias("k"),
        F.timestamp_seconds(start + F.col("id") * 300).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 5).alias("v"),
        "id",
    )
    assert largest_share(trailing_totals(tx, ["k"], "ts", "v")) < 0.3
    assert largest_share(with_previous(tx, "k", "ts", ["ts"], ["v"], 86_400)) < 0.5
    assert largest_share(sampling.dense_index(tx, "id", "s", "i")) < 0.3
    copies = tx.withColumn("id", F.lit(1)).unionByName(tx)
    assert latest_by_key(copies, ["id"], ["ts"]).count() == 20_000


def test_orphans_and_parents_without_children(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    assert rows(joins.orphans(child, "k", parent), "k", "n_rows") == [(3, 2)]
    assert rows(joins.without_children(parent, "k", child), "k") == [(2,)]
    assert joins.with_children(child, "k", parent).count() == 1


# --- windows ----------------------------------------------------------------------

def brute_trailing(points, seconds):
    """points: (key, ts, value); per key and instant the trailing count and sum."""
    out = set()
    for key, ts, _ in points:
        inside = [
            v for k, t, v in points
            if k == key and ts - dt.timedelta(seconds=seconds) <= t <= ts
        ]
        same = sum(1 for k, t, _ in points if k == key and t == ts)
        out.add((key, ts, same, len(inside), sum(inside)))
    return sorted(out)


def trailing(spark, points, seconds):
    df = spark.createDataFrame(points, "k string, ts timestamp_ntz, v decimal(18,2)")
    got = trailing_totals(df, ["k"], "ts", "v", seconds)
    return rows(got, "k", "ts", "n_tx", "n_ventana", "suma_ventana")


def test_trailing_hour_includes_exactly_one_hour(spark):
    points = [
        ("a", at(f"2022-01-01T{t}"), Decimal(v))
        for t, v in (("00:00:00", 1), ("01:00:00", 2), ("01:00:01", 4))
    ]
    got = trailing(spark, points, 3600)
    assert [r[3] for r in got] == [1, 2, 2]
    assert [r[4] for r in got] == [1, 3, 6]


@pytest.mark.parametrize("seconds", [2, 5, 3600, 100_000])
@pytest.mark.parametrize("subsecond", [False, True])
def test_trailing_totals_equal_brute_force(spark, seconds, subsecond):
    draw = random.Random(seconds)
    start = at("2021-12-31T23:59:50")
    points = []
    for _ in range(400):
        offset = draw.randrange(40 * seconds) * 500_000 if subsecond else draw.randrange(20 * seconds) * 10**6
        points.append(
            (draw.choice("aab"), start + dt.timedelta(microseconds=offset), Decimal(draw.randrange(1, 500)))
        )
    assert trailing(spark, points, seconds) == brute_trailing(points, seconds)


def test_instants_of_one_second_are_kept_apart(spark):
    points = [("a", at(f"2022-01-01T{t}"), Decimal(1)) for t in ("10:00:00.900000", "10:00:00.100000", "11:00:00.500000")]
    assert [r[2:] for r in trailing(spark, points, 3600)] == [(1, 1, 1), (1, 2, 2), (1, 2, 2)]


def test_trailing_totals_before_the_epoch_and_null_values(spark):
    points = [("a", at("1969-12-31T23:59:59"), Decimal(3)), ("a", at("1970-01-01T00:00:01"), None)]
    assert [r[2:] for r in trailing(spark, points, 3600)] == [(1, 1, 3), (1, 2, 3)]


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_previous_point_within_a_day(spark, buckets):
    draw = random.Random(buckets)
    points = {
        (draw.choice("ab"), at("2021-12-25") + dt.timedelta(hours=draw.randrange(900))): draw.choice("xyz")
        for _ in range(120)
    }
    first = at("2021-12-25")
    points.update({("a", first + dt.timedelta(days=60 + d)): "x" for d in (0, 1, 2)})  # exactly a day
    df = spark.createDataFrame(
        [(k, t, p) for (k, t), p in points.items()], "k string, ts timestamp_ntz, p string"
    )
    got = rows(
        with_previous(df, "k", "ts", ["ts"], ["ts", "p"], 86_400, buckets), "k", "ts", "ts_previo", "p_previo"
    )
    expected = []
    for key in "ab":
        times = sorted(t for k, t in points if k == key)
        for before, now in zip([None, *times], times):
            if before is None or now - before > dt.timedelta(days=1):
                before = None
            expected.append((key, now, before, points.get((key, before))))
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(expected, key=key)


# --- quantiles ----------------------------------------------------------------------

def interpolated(values, p):
    values = sorted(values)
    pos = p * (len(values) - 1)
    low = int(pos)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (pos - low)


@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_quantiles_equal_a_full_sort(spark, accuracy):
    """However coarse the sketch."""
    draw = random.Random(3)
    groups = {
        "uniform": [draw.random() * 1e6 for _ in range(6000)],
        "ties": [5.0] * 2500 + [float(draw.randrange(10)) for _ in range(2500)],
        "constant": [7.0] * 4000,
        "skewed": [draw.paretovariate(1.1) for _ in range(7000)],
    }
    df = spark.createDataFrame(
        [(g, v) for g, values in groups.items() for v in values], "g string, v double"
    ).repartition(6)
    got = {r["g"]: r["cuts"] for r in exact_quantiles(df, ["g"], "v", accuracy=accuracy).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx([interpolated(values, p) for p in (0.25, 0.5, 0.75)], rel=1e-12)


def test_quantiles_of_few_values_and_nulls(spark):
    df = spark.createDataFrame(
        [("one", 4.0), ("two", 1.0), ("two", 2.0), ("two", None), ("none", None)], "g string, v double"
    )
    got = {r["g"]: r["cuts"] for r in exact_quantiles(df, ["g"], "v").collect()}
    assert got == {"one": [4.0, 4.0, 4.0], "two": [1.25, 1.5, 1.75]}


def test_equal_values_share_a_band(spark):
    df = spark.createDataFrame([(v,) for v in (1, 5, 6, 9, 10)], "v int")
    banded = df.withColumn("b", band(F.col("v"), F.array(F.lit(5.0), F.lit(6.0), F.lit(9.0))))
    assert rows(banded, "v", "b") == [(1, 1), (5, 1), (6, 2), (9, 3), (10, 4)]
