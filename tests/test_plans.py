"""Plans of the registered queries: what a large cluster would run."""

import re

import pytest

from caudal import schemas
from caudal.operators import quality
from caudal.plans import activity, fraud, silver
from caudal.plans.registered import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans without broadcasts chosen by size, as for tables too large for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        return {name: physical(query(spark, SF_DIR)) for name, query in QUERIES.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxPlanStringLength")


def test_no_python_in_any_plan(plans):
    for name, plan in plans.items():
        assert not re.search(r"Python|ArrowEval|MapInPandas", plan), name


def test_no_cross_join_and_no_unpartitioned_window(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
        # A window over everything is fed by a single-partition exchange and sort.
        assert not re.search(r"Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan), name


def test_only_bounded_sides_are_broadcast(plans):
    """Hot keys, bucket offsets and quantile brackets; never a table."""
    allowed = {
        "fraud_amount", "fraud_amount_rate", "fraud_score", "fraud_score_as_of", "fraud_top_clients", "sample_n",
        "assign_fk", "retention_by_volume", "segmentation", "client_features", "client_features_as_of", "amount_quartiles",
    }
    assert {name for name, plan in plans.items() if "BroadcastHashJoin" in plan} <= allowed


def test_scans_read_only_the_columns_they_need(plans):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans["daily_tx"])
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {
        "o_custkey", "o_orderdate", "o_totalprice", "c_custkey", "c_nationkey", "c_mktsegment",
        "n_nationkey", "n_name",
    }


def test_filters_reach_the_scan(plans):
    assert "EqualTo(o_orderstatus,O)" in plans["filter_active"] or "o_orderstatus" in re.search(
        r"DataFilters: \[[^\]]*\]", plans["filter_active"]
    ).group(0)
    assert "GreaterThan(o_totalprice,100000.0)" in plans["filter_group_sum"]


def test_the_daily_report_aggregates_before_it_joins(plans):
    plan = plans["daily_tx"]
    join = plan.index("SortMergeJoin")
    assert plan.count("partial_count") >= 1 and plan.rindex("partial_sum(monto") > join


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet[^\n]*Location: [^\n]*/{table}\.parquet", plan))


@pytest.mark.parametrize("name, lineitem, orders", [("dq_relationships", 1, 2), ("finance_monthly", 1, 1), ("daily_tx", 0, 1)])
def test_facts_are_scanned_once(plans, name, lineitem, orders):
    assert (scans(plans[name], "lineitem"), scans(plans[name], "orders")) == (lineitem, orders)


@pytest.mark.parametrize("name", ["churn", "dormant_accounts", "sample_n"])
def test_a_second_use_of_an_aggregate_reads_its_shuffle(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        df = QUERIES[name](spark, SF_DIR)
        df.collect()
        assert "ReusedExchange" in physical(df)
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")


def test_enriched_rows_need_no_join(spark):
    tx = spark.createDataFrame(
        [], "cliente_id string, pais string, pais_tx string, segmento string, moneda string, tipo_cuenta string, "
        "timestamp_tx timestamp_ntz, monto decimal(18,2), tipo_tx string",
    )
    for frame in (
        activity.finance_of_enriched(tx), activity.daily_of_enriched(tx, ("moneda",)), fraud.foreign_share_of_enriched(tx),
    ):
        assert "Join" not in physical(frame)


def test_type_checks_stay_in_generated_code(spark, tmp_path):
    """Each text is parsed once for the typed rows, and the filter on reasons is generated code."""
    schema = schemas.TABLES["transacciones"]
    raw = spark.createDataFrame([], ", ".join(f"{f.name} string" for f in schema.fields))
    raw.write.parquet(str(tmp_path / "raw"))
    checked = silver.type_check(spark.read.parquet(str(tmp_path / "raw")), "transacciones")
    plan = physical(checked)
    assert plan.count("try_cast(trim(") == 0  # parsed from the trimmed column, not trimmed again
    for one in (quality.accepted(checked), quality.rejected(checked)):
        assert re.search(r"\*\(\d+\) Filter", physical(one)) and not re.search(r"[+:]- Filter", physical(one))


def test_silver_reads_bronze_once_for_everything(spark, tmp_path):
    """Good rows, quarantine and counts all read the written checked rows."""
    schema = schemas.TABLES["cuentas"]
    raw = spark.createDataFrame([], ", ".join(f"{f.name} string" for f in schema.fields))
    raw.write.parquet(str(tmp_path / "bronze"))

    def store(checked):
        checked.write.parquet(str(tmp_path / "checked"))
        return spark.read.parquet(str(tmp_path / "checked"))

    cleaned = silver.clean(spark.read.parquet(str(tmp_path / "bronze")), "cuentas", store)
    for part in (cleaned.good, cleaned.typed, cleaned.quarantine, cleaned.counts):
        files = part.inputFiles()
        assert files and all("/checked/" in f for f in files)
