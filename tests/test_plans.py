"""Physical plans: what must not appear over fact-sized inputs, and what must."""

import re

import pytest

from pyspark.sql import functions as F

from orderloom.operators import assign, clean, costs, delivery, demand, fulfil, prefix, readout, slotting
from orderloom.sources import sample

FACT_PLANS = {
    "classified": lambda r: clean.classified(r.txn),
    "tracked": lambda r: r.sales.groupBy("stock_code").count(),
    "in window": lambda r: demand.sales_in_window(r.sales, r.items, r.weeks, 200),
    "lines": lambda r: demand.invoice_lines(r.sales, r.items, r.weeks, 200),
    "descriptions": lambda r: demand.modal_description(r.sales, r.items, 200),
    "velocity": lambda r: slotting.velocity(r.lines, r.items),
    "evaluate": lambda r: slotting.evaluate(r.lines, r.slotting, r.slots),
    "orders": lambda r: fulfil.orders(r.quantities, r.picks),
    "customers": lambda r: assign.customer_lookup(r.sales),
    "revenue": lambda r: costs.window_revenue_lines(r.sales, r.items, r.window),
    "per invoice": lambda r: costs.per_invoice(r.log, r.revenue_lines, r.delivery_daily, r.window),
    "per day": lambda r: delivery.per_day(r.route_lengths, r.shipments),
    "routes": lambda r: delivery.savings_routes(r.nodes),
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(FACT_PLANS))
def test_no_cross_join_and_no_single_task_window(name, run):
    plan = plan_of(FACT_PLANS[name](run))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"Window \[.*?\n", plan):
        assert re.search(r"\], \[[a-z_]+#\d+", spec), spec  # partition columns present


def test_sales_read_only_their_folder_and_columns(run):
    plan = plan_of(run.sales.select("stock_code", "revenue"))
    assert "PartitionFilters: [isnotnull(step_no" in plan
    assert "ReadSchema: struct<stock_code:string,quantity:bigint,price:double>" in plan


def test_filters_of_the_direct_path_run_before_the_shuffle(run):
    plan = plan_of(clean.sales_lines(run.txn).select("invoice"))
    above, below = plan.rsplit("Exchange hashpartitioning(invoice", 1)
    assert "StartsWith" in below and "StartsWith" not in above


def test_line_items_read_five_columns(run):
    columns = re.search(r"FileScan parquet \[(l_orderkey[^\]]*)\]", plan_of(run.txn)).group(1)
    assert re.sub(r"#\d+L?", "", columns) == "l_orderkey,l_partkey,l_quantity,l_extendedprice,l_returnflag"


def test_lookup_tables_are_broadcast_and_tours_take_one_shuffle(run):
    plan = plan_of(slotting.evaluate(run.lines, run.slotting, run.slots))
    assert "BroadcastHashJoin" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(invoice", plan)) == 1


def test_customers_fold_by_hash_before_any_sort(run):
    plan = plan_of(assign.customer_lookup(run.sales))
    scan = plan[plan.rindex("HashAggregate(keys=[invoice") :]
    assert "SortAggregate" not in scan and "Sort [" not in scan


def test_rows_of_a_hot_day_are_not_shuffled_by_day(run, monkeypatch):
    monkeypatch.setattr(prefix, "ONE_TASK_ROWS", 0)
    plan = plan_of(prefix.rank_in_group(run.log.select("day", "invoice"), ["day"], [F.col("invoice")], 10))
    by_day = [line for line in plan.splitlines() if "Exchange hashpartitioning(day" in line]
    assert len(by_day) <= 1  # the summary of ranges; rows are joined by range and day


def test_what_ifs_do_not_read_the_tours_again(run):
    what_if = run.shocks
    layouts = run.checks.filter(F.col("name").startswith("(g)"))
    checks = run.checks_for(what_if.ledger, what_if.forecasts, what_if.plans, layouts, ["base"])
    assert not [f for f in checks.inputFiles() if "/evaluated/" in f]


def test_samples_are_top_n(run):
    assert "TakeOrderedAndProject" in plan_of(sample.stratified_sample(run.classified))


def test_ranks_are_read_from_a_written_layout(run):
    plan = plan_of(readout.by_cost(run.economics))
    assert "Scan ExistingRDD" in plan and "BroadcastExchange" in plan
