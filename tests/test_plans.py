"""Plans that the queries should have: filters and columns at the scan, limits before windows, no needless exchange."""

import re
from pathlib import Path

import pytest

from tidemill.operators.dedup import mark_duplicates
from tidemill.operators.lineage import plan_text
from tidemill.plans import registries
from tidemill.session import discard, materialize
from tidemill.sources import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
QUERIES = {n: f for r in registries() for n, f in r.queries.items()}


def plan(spark, name):
    return plan_text(QUERIES[name](spark, FOLDER))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "incremental_extract")
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>", text)
    flagship = plan(spark, "flagship_user_sales")
    assert "l_shipdate" not in flagship and "p_brand" not in flagship and "c_acctbal" not in flagship


def test_limits_come_before_windows(spark):
    assert "WindowGroupLimit" in plan(spark, "top_per_group") and "WindowGroupLimit" in plan(spark, "monthly_top_user")
    assert "TakeOrderedAndProject" in plan(spark, "global_top10") and "TakeOrderedAndProject" in plan(spark, "federated_join")


def test_no_python_and_no_products_where_spark_has_the_operator(spark):
    for name in ("p4_found", "p6_found", "flagship_user_sales", "cdc_changelog", "scd2_customer", "k_anonymity_cells", "psi_segments", "jaccard_match_exact", "dq_report", "contract_validate"):
        text = plan(spark, name)
        assert not re.search("InPandas|BatchEvalPython|ArrowEvalPython|CartesianProduct", text), name


def test_duplicates_are_found_by_hash_aggregation(spark):
    rows = table(spark, FOLDER, "orders_microbatch_window_raw").select("delivery_no", "ID", "ingest_ts")
    text = plan_text(mark_duplicates(rows, "ID", "ingest_ts", "delivery_no"))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text


def test_a_rollup_reads_no_more_columns_than_it_needs(spark):
    text = plan(spark, "multi_grain_rollup")
    read = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    assert read and all("props" not in r and "event_id" not in r for r in read) and len(read) <= 3


def test_no_plan_gathers_a_large_table_in_one_task(spark):
    for name in ("psi_segments", "p6_found", "p2_found", "semantic_unified", "k_anonymity_exact"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and not re.search(r"Window \(\d+\)\s+on codegen.*SinglePartition", text), name


def test_scratch_tables_can_be_dropped(spark):
    df = materialize(spark.range(3), "x")
    assert df.count() == 3
    discard(df)
    discard(spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.scratch_path).count()
